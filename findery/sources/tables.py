"""Parquet tables of a folder."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNEVEN = 3  # times its share of the rows that the largest task may have
TASK_ROWS, MOST_TASKS = 5000, 200
PARTS, MANY_ROWS = 4, 20_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealing(df: DataFrame, key: str | None = None) -> tuple[int, str, int] | None:
    """Over how many tasks the table is to be dealt, by which key (the first column named for an id, or else the first), and its rows. None where its row groups are even.

    How many rows each task has comes from the files' footers alone. How many tasks there should be follows from the rows
    and not from the cores alone: while executors still register, Spark counts two. Rows that are dealt by a key, unlike
    those dealt in turn, needn't be sorted (and spilled) before.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows, most = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).head()
    tasks = max(cores, min(MOST_TASKS, (rows or 0) // TASK_ROWS))
    if not rows or most * tasks <= UNEVEN * rows:
        return None
    return tasks, key or next((c for c in df.columns if c.endswith("_id")), df.columns[0]), rows


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """The table as it is where its row groups are dealt out; else, as a row group is one task, its rows dealt by their key."""
    deal = dealing(df, key)
    return df.repartition(*deal[:2]) if deal else df


def parts(df: DataFrame, key: str | None = None) -> list[DataFrame]:
    """spread(df), in PARTS where it is a large table that has to be dealt: for who stores one after the other and lets go of it, so that a part alone, and not the table, stands in shuffle files. Each reads the table again; rows with the same key are in the same part."""
    deal = dealing(df, key)
    if not deal:
        return [df]
    tasks, key, rows = deal
    if rows <= MANY_ROWS:
        return [df.repartition(tasks, key)]
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(PARTS)) == i).repartition(-(-tasks // PARTS), key) for i in range(PARTS)]


def release(df: DataFrame) -> None:
    """Shuffle files go when the driver's JVM finds their plans gone; between the phases of a large job it is asked to look, once for the plans and once for what they held."""
    for _ in range(2):
        gc.collect()
        df.sparkSession._jvm.System.gc()
        time.sleep(0.3)
