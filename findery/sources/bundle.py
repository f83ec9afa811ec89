"""Markdown bundles: directories of .md files with YAML front matter.

Spark's own file sources skip names that begin with a dot or an underscore, which a bundle keeps, so the paths are
listed on the driver; files are read and parsed in tasks. A store that only Spark reads goes through binaryFile.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.plans.model import RAW, SearchError
from findery.sources.documents import known_values, normalized


class CoreLoader(yaml.SafeLoader):
    """YAML 1.2 core scalars only: dates, yes and no, and 12:30 stay strings; a repeated key is an error."""

    yaml_implicit_resolvers: dict = {}

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if len({(type(k), str(k)) for k in keys}) < len(keys):
            raise yaml.constructor.ConstructorError("while reading a mapping", node.start_mark, "found a repeated key", node.start_mark)
        return {k: self.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value) if k.__hash__}


for _tag, _pattern, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", [*"tTfF"]),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", [*"-+0123456789"]),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", [*"-+0123456789."]),
):
    CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)
CoreLoader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(v, 0) if re.match("0[ox]", v := loader.construct_scalar(node)) else int(v))


def plain(value: Any) -> Any:
    """JSON-like values: booleans, numbers, strings and lists; mappings, null and numbers that aren't finite become None."""
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, (bool, int, float, str)) else None


def split_frontmatter(content: str) -> tuple[dict[str, Any], str]:
    """Front matter and body. A file that doesn't begin with a line of three dashes is all body."""
    if not content.startswith("---\n"):
        return {}, content
    lines = content[4:].split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    close = next((i for i, line in enumerate(lines) if line.strip() == "---"), len(lines))
    body = "\n".join(line.removesuffix("\r") for line in lines[close + 1 :])
    parsed = yaml.load("\n".join(lines[:close]), CoreLoader)
    return {k: plain(v) for k, v in parsed.items() if isinstance(k, str)} if isinstance(parsed, dict) else {}, body


def markdown_files(bundle: str) -> list[str]:
    """Paths of regular files that end in .md, hidden ones too; links aren't followed."""
    found = []
    for folder, _, names in os.walk(bundle):
        found += [p for n in names if n.endswith(".md") and n != ".md" and os.path.isfile(p := os.path.join(folder, n)) and not os.path.islink(p)]
    return sorted(found)


def parsed(batches: Iterator[pa.RecordBatch], bundle: str, skip: bool) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            try:
                data = row["content"] if "content" in row else open(row["path"], "rb").read()
                front, body = split_frontmatter(data.decode())
            except (UnicodeDecodeError, yaml.YAMLError, OSError) as e:
                if skip:
                    continue
                raise SearchError(f"{row['path']}: {e}") from e
            rows.append(dict(zip(RAW.names, (bundle, row["path"], *known_values(front), body))))
        yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(RAW))


def load_bundle(spark: SparkSession, bundle: str, on_error: str = "fail") -> DataFrame:
    """Documents of a bundle. A malformed file fails the load, or is skipped with on_error="skip"."""
    skip = on_error == "skip"
    if "://" in bundle:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(bundle).select("path", "content")
    else:
        paths = markdown_files(bundle)
        files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths) // 64 + 1, 10_000)))
    return normalized(files.mapInArrow(lambda it: parsed(it, bundle, skip), RAW))
