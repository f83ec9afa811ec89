"""Inverted index and BM25 as joins and groupings.

Tables: postings (segment_id, term, doc_id, tf, dl) and segment_stats (segment_id, n, avgdl). The length travels with the
posting, so scoring needs no join for it. Statistics are by segment and count dead documents until compaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.functions import scoring
from findery.functions.text import tokenize
from findery.operators.fusion import checkpointed

SMALL_QUERIES = 100_000


def tokens(docs: DataFrame, text: str = "searchable_text", also: tuple[str, ...] = ()) -> DataFrame:
    """(segment_id, doc_id, tokens, dl) for each row, and the columns named in also."""
    return docs.select("segment_id", "doc_id", tokenize(text).alias("tokens"), *also).withColumn("dl", F.size("tokens").cast("long"))


def counted(docs: DataFrame, text: str = "searchable_text", terms: list[str] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(segment_id, doc_id, dl, found): for each row its terms and their tf, counted within the row, so that no token is shuffled. With terms, only those. Columns named in also are kept.

    Tokens are sorted; where one is unlike the one before it, a term begins. The last mark is the end.
    """
    own = F.sort_array("tokens" if terms is None else F.filter("tokens", lambda t: t.isin(terms)))
    rows = tokens(docs, text, also).select("segment_id", "doc_id", "dl", own.alias("own"), *also)
    marks = F.zip_with("own", F.concat(F.array(F.lit(None).cast("string")), "own"), lambda x, before: ~x.eqNullSafe(before))
    starts = F.filter(F.transform(marks, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    rows = rows.select("segment_id", "doc_id", "dl", F.array_distinct("own").alias("term"), starts.alias("at"), *also)
    tf = F.transform(F.arrays_zip("at", F.slice("at", 2, F.size("term")).alias("end")), lambda x: (x["end"] - x["at"]).cast("long"))
    rows = rows.select("segment_id", "doc_id", "dl", "term", F.slice(tf, 1, F.size("term")).alias("tf"), *also)
    return rows.select("segment_id", "doc_id", "dl", F.arrays_zip("term", "tf").alias("found"), *also)


def opened(counted: DataFrame) -> DataFrame:
    """Postings (segment_id, term, doc_id, tf, dl) of counted rows. Outer, as Spark would else put a test of the whole array, so all its work once more, before it."""
    return counted.select("segment_id", "doc_id", "dl", F.inline_outer("found")).filter(F.col("term").isNotNull()).select("segment_id", "term", "doc_id", "tf", "dl")


def parted(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of documents that are in a segment once, and of those that are there again; ids alone are grouped for it."""
    again = docs.groupBy(F.col("segment_id").alias("__segment"), F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    if not (n := again.count()):
        return docs, None
    again = F.broadcast(again) if n <= SMALL_QUERIES else again
    same = docs["segment_id"].eqNullSafe(F.col("__segment")) & docs["doc_id"].eqNullSafe(F.col("__id"))
    return docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")


def postings(docs: DataFrame, text: str = "searchable_text", terms: list[str] | None = None) -> DataFrame:
    """tf of each term by segment and document; rows that repeat a document in a segment add up, with one length. Only those are shuffled."""
    once, again = parted(docs)
    out = opened(counted(once, text, terms))
    return out if again is None else out.unionByName(met(opened(counted(again, text, terms))))


def met(postings: DataFrame) -> DataFrame:
    """Postings of repeated rows, added up."""
    return postings.groupBy("segment_id", "term", "doc_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))


def distinct_terms(queries: DataFrame) -> list[str]:
    """The terms of a few queries."""
    return [r["term"] for r in query_terms(queries).select("term").distinct().collect()]


def saved_counts(docs: DataFrame, terms: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """counted(docs, terms=terms), kept in the shared folder: a narrow table that gives statistics, frequencies and scores."""
    return checkpointed(counted(docs, terms=terms, also=also))


def of_counts(counts: DataFrame) -> DataFrame:
    """postings() of counted rows."""
    once, again = parted(counts)
    return opened(once) if again is None else opened(once).unionByName(met(opened(again)))


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """segment_stats() of counted rows."""
    of = counts.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
    return of.select("segment_id", "n", F.coalesce(F.col("total").cast("double") / F.col("n"), F.lit(0.0)).alias("avgdl"))


def segment_stats(docs: DataFrame, text: str = "searchable_text") -> DataFrame:
    """Rows, also those without tokens, and mean length."""
    return stats_of_counts(tokens(docs, text))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("segment_id", "term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, query)."""
    return queries.select("query_id", F.explode(tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def term_values(postings: DataFrame, stats: DataFrame, terms: DataFrame, dead: DataFrame | None = None, k1: float = scoring.K1, b: float = scoring.B, few: bool = True) -> DataFrame:
    """(doc_id, term, value): what each of the terms (term) gives to each live document of each segment.

    Only postings of these terms are read on; their df counts dead documents, which are dropped after. few says that the
    caller has counted the terms (at most SMALL_QUERIES): then they are broadcast, else joined by shuffle.
    """
    hit = postings.join(F.broadcast(terms) if few else terms, "term", "left_semi")
    weights = document_frequency(hit).join(F.broadcast(stats), "segment_id").withColumn("weight", scoring.idf(F.col("n"), F.col("df"))).select("segment_id", "term", "weight", "avgdl")
    keys = [] if dead is None else ["segment_id", "doc_id"] if "segment_id" in dead.columns else ["doc_id"]
    live = hit.join(dead.select(*keys), keys, "left_anti") if keys else hit
    per_term = live.join(F.broadcast(weights) if few else weights, ["segment_id", "term"])
    return per_term.select("doc_id", "term", scoring.bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("weight"), k1, b).alias("value"))


def scores(postings: DataFrame, stats: DataFrame, queries: DataFrame, dead: DataFrame | None = None, k1: float = scoring.K1, b: float = scoring.B, few_queries: bool = False) -> DataFrame:
    """(query_id, doc_id, score): BM25 summed over terms, as often as the query has them, and segments. few_queries: as few in term_values."""
    asked = query_terms(queries)
    per_term = term_values(postings, stats, asked.select("term").distinct(), dead, k1, b, few_queries)
    matched = per_term.join(F.broadcast(asked) if few_queries else asked, "term")
    return matched.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("value")).alias("score"))
