"""Schemas and request types."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import types as T

S = T.StringType()
DOCUMENT = T.StructType(
    [T.StructField(n, S, False) for n in ("logical_key", "bundle_path", "concept_path", "file_path", "doc_id", "type_name")]
    + [T.StructField(n, S) for n in ("title", "description", "resource", "timestamp")]
    + [T.StructField("tags", T.ArrayType(S), False), T.StructField("body", S, False), T.StructField("searchable_text", S, False)]
)
#: What a source gives for each file: paths, the six known front-matter values, body.
RAW = T.StructType([T.StructField("bundle_path", S, False), T.StructField("file_path", S, False), T.StructField("type", S), T.StructField("title", S), T.StructField("description", S), T.StructField("resource", S), T.StructField("timestamp", S), T.StructField("tags", T.ArrayType(S)), T.StructField("body", S)])


class SearchMode(str, Enum):
    LEXICAL, VECTOR, HYBRID = "lexical", "vector", "hybrid"

    @classmethod
    def lenient(cls, name: str | None) -> SearchMode:
        """For the command line: anything unknown is hybrid."""
        return cls(name) if name in [m.value for m in cls] else cls.HYBRID


class SearchError(Exception):
    """An index can't do what it was asked for."""


@dataclass
class DocumentInput:
    bundle_path: str
    file_path: str
    frontmatter: dict[str, Any] = field(default_factory=dict)
    body: str = ""


@dataclass
class SearchRequest:
    query: str
    mode: SearchMode = SearchMode.HYBRID
    top_k: int = 10


@dataclass
class DeleteRequest:
    doc_ids: list[str] = field(default_factory=list)
    logical_keys: list[str] = field(default_factory=list)
