"""Corpus clean-up in five stages: quality, near copies, repeated passages, secrets, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. run() writes what a stage returns to the shared folder and reads it back for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm import jaccard_join, packing, quality_lm, secret_scan, substring_dedup
from findery.llm.common import discard, fits_broadcast, hot_keys, replicated, salted, saved, small_batches, table


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def _listed(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents whose (doc_id, key) is in the saved rows, or isn't. rows lists the fewer, so that it may be small enough to spare the texts a shuffle."""
    listed = (F.broadcast(rows) if fits_broadcast(rows, 32) else rows).select(F.col("doc_id").alias("__id"), F.col("key").alias("__listed"))
    docs = _key(docs)
    return docs.join(listed, (docs["__key"] == F.col("__listed")) & docs["doc_id"].eqNullSafe(F.col("__id")), how)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the Kneser-Ney classifier rejects, and those without words. An empty table stays empty."""
    small_batches(spark)
    judged = quality_lm.classify(docs, table(spark, sf_dir, "labels"))
    rejected = saved(judged.filter("not kept").select("doc_id", "key").distinct())
    discard(judged)
    return _listed(docs, rejected, "left_anti").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays; repeated rows are copies."""
    small_batches(spark)
    found = jaccard_join.ngram_jaccard_join(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = saved(found.withColumn("class_key", F.coalesce("class_key", "key")).groupBy("class_key", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")))
    first = classes.groupBy("class_key").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first")).filter("rows > 1")
    first = saved(first.select("class_key", "rows", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key")))
    hot, salts = hot_keys(first.select("class_key", F.col("rows").alias("n")), "class_key")
    grouped = salted(classes, "class_key", "key", hot, salts).join(replicated(first, "class_key", hot, salts), ["class_key", "__salt"])
    later = saved(grouped.filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))).select("doc_id", "key"))
    repeated = saved(classes.filter("n > 1").select("doc_id", "key"))
    discard(found, classes, first)
    kept = _listed(docs, later, "left_anti").drop("__key")
    once, rows = _listed(kept, repeated, "left_anti"), _listed(kept, repeated, "left_semi")
    return once.unionByName(rows.dropDuplicates(["doc_id", "__key"])).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a document of which nothing is left goes."""
    small_batches(spark)
    cut = substring_dedup.remove_repeated_spans(docs).filter("n_removed = 0 or trim(text) <> ''")
    return _counted(cut.select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets that the forest confirms."""
    small_batches(spark)
    return _counted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row per piece."""
    small_batches(spark)
    return packing.with_crc(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("substring dedup", passages), ("secret scans", secrets), ("packing", pack)]
ORACLE_SQL = None  # models and token ids can't be said in SQL; the tests run each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
