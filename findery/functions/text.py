"""Column expressions of documents: tokens, searchable text, identity, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"
SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_ELSE = 40, 80, 160


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """Runs of letters and digits of any script, each lower-cased; null text has none. Lower-cased after the cut, as that can make marks that would cut; all in generated code."""
    runs = F.lower(F.regexp_replace(F.coalesce(_col(text), F.lit("")), NOT_WORD, " "))
    return F.array_remove(F.split(runs, " "), "")


def searchable_text(title: Column | str, description: Column | str, tags: Column | str, body: Column | str) -> Column:
    """Title, description and tags, as far as there are any, and the body, on lines of their own."""
    tags = _col(tags)
    return F.concat_ws("\n", _col(title), _col(description), F.when(F.size(tags) > 0, F.concat_ws(" ", tags)), F.coalesce(_col(body), F.lit("")))


def doc_id(bundle_path: Column | str, file_path: Column | str, body: Column | str) -> Column:
    return F.sha2(F.concat_ws("\0", _col(bundle_path), _col(file_path), _col(body)), 256)


def concept_path(bundle_path: Column | str, file_path: Column | str) -> Column:
    """The file's path below its bundle, without leading separators and trailing .md; the prefix is taken by whole components."""
    bundle, file = F.regexp_replace(_col(bundle_path), "/+$", ""), _col(file_path)
    inside = F.when((bundle != "") & file.startswith(F.concat(bundle, F.lit("/"))), file.substr(F.length(bundle) + 1, F.length(file))).otherwise(file)
    return F.replace(F.regexp_replace(F.regexp_replace(inside, r"^[/\\]+", ""), r"(\.md)+$", ""), F.lit("\\"), F.lit("/"))


def logical_key(bundle_path: Column | str, concept: Column | str) -> Column:
    return F.concat(_col(bundle_path), F.lit("::"), F.replace(_col(concept), F.lit("\\"), F.lit("/")))


def snippet(body: Column | str, query: Column) -> Column:
    """The first match of the whole query, whatever the case, with what stands around it; else the body's beginning. In characters."""
    body, low = _col(body), F.lower(query)
    at = F.when(low == "", F.lit(0)).otherwise(F.instr(F.lower(body), low) - 1)
    start = F.greatest(at - SNIPPET_BEFORE, F.lit(0))
    end = F.least(at + F.length(low) + SNIPPET_AFTER, F.length(body))
    return F.when(at >= 0, body.substr(start + 1, end - start)).otherwise(body.substr(F.lit(1), F.lit(SNIPPET_ELSE)))
