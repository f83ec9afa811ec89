"""Ranks, reciprocal rank fusion, and result rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findery.functions import scoring

ONE_TASK_ROWS = 2_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names; a local one is set where there is none and all runs on one machine."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def ranked(scores: DataFrame, rows: int | None = None, score: str = "score", rank: str = "rank", digits: int | None = scoring.DIGITS) -> DataFrame:
    """Adds rank (from 1) by falling score, rounded to `digits`, and then doc_id, for each query.

    Lists that are known to have at most ONE_TASK_ROWS rows together are ranked in one task for each query. Others are
    sorted in ranges over all tasks: a row's rank is its place in its range and the lengths of the ranges before it.
    """
    if digits is not None:
        scores = scores.withColumn(score, scoring.rounded(F.col(score), digits))
    order = [F.desc(score), F.asc("doc_id")]
    if rows is not None and rows <= ONE_TASK_ROWS:
        return scores.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    parts = max(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // ONE_TASK_ROWS))
    dealt = checkpointed(scores.repartitionByRange(parts, F.asc("query_id"), *order).withColumn("range", F.spark_partition_id()))
    lengths = dealt.groupBy("query_id", "range").agg(F.count(F.lit(1)).alias("length"))
    before = F.coalesce(F.sum("length").over(Window.partitionBy("query_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("query_id", "range").orderBy(*order))
    placed = dealt.withColumn("place", place).join(lengths.withColumn("before", before).drop("length"), ["query_id", "range"])
    return placed.withColumn(rank, (F.col("place") + F.col("before")).cast("long")).drop("range", "place", "before")


def rrf(lexical: DataFrame, vector: DataFrame, k: int = scoring.RRF_K) -> DataFrame:
    """Full outer join of ranked lists; fused_score adds what each list gives for the rank."""
    a = lexical.select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.col("rank").alias("lexical_rank"))
    b = vector.select("query_id", "doc_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    fused = scoring.reciprocal_rank(F.col("lexical_rank"), k) + scoring.reciprocal_rank(F.col("vector_rank"), k)
    return a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("fused_score", fused)


def top(rows: DataFrame, k: int, score: str = "fused_score") -> DataFrame:
    """The k best of each query with their rank; Spark cuts lists before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("doc_id"))
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def without(rows: DataFrame, gone: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """The rows whose keys aren't in gone, which is broadcast where the caller knows that they are few. No anti join, as Spark would put it before what rows computes, so that whole texts would be shuffled for it."""
    marked = gone.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct().withColumn("__gone", F.lit(True))
    marked = F.broadcast(marked) if few else marked
    same = [rows[k] == F.col(f"__{k}") for k in keys]
    return rows.join(marked, same, "left").filter(F.col("__gone").isNull()).select(*(rows[c] for c in rows.columns))


def last_wins(docs: DataFrame) -> DataFrame:
    """One row per doc_id: that of the last segment, and there the last row (segment_ord, ord)."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("segment_ord"), F.desc("ord"))
    return docs.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
