"""Documents from front matter and body: normalisation, and rows given in memory or as JSON."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions import text
from findery.plans.model import DOCUMENT, RAW, DocumentInput


def known_values(frontmatter: dict[str, Any]) -> tuple:
    """type, title, description, resource, timestamp (strings only, else None) and the strings of a tag list."""
    one = [v if isinstance(v := frontmatter.get(k), str) else None for k in ("type", "title", "description", "resource", "timestamp")]
    tags = frontmatter.get("tags")
    return (*one, [t for t in tags if isinstance(t, str)] if isinstance(tags, list) else [])


def normalized(raw: DataFrame) -> DataFrame:
    """Documents from rows of RAW's columns: defaults, paths, searchable text and identity."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    body = F.coalesce("body", F.lit(""))
    out = raw.withColumn("tags", F.filter(tags, lambda t: t.isNotNull())).withColumn("body", body)
    out = out.withColumn("concept_path", text.concept_path("bundle_path", "file_path")).withColumn("type_name", F.coalesce("type", F.lit("Unknown")))
    out = out.withColumn("logical_key", text.logical_key("bundle_path", "concept_path")).withColumn("doc_id", text.doc_id("bundle_path", "file_path", "body"))
    out = out.withColumn("searchable_text", text.searchable_text("title", "description", "tags", "body"))
    return out.select(*DOCUMENT.names)


def from_inputs(spark: SparkSession, inputs: list[DocumentInput]) -> DataFrame:
    return normalized(spark.createDataFrame([(d.bundle_path, d.file_path, *known_values(d.frontmatter), d.body) for d in inputs], RAW))
