"""Helpers that several operators share: reading, materialising, hashing, streaming groups."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.sources.tables import spread

SHINGLE_WORDS = 5
SIMILARITY = 0.8
MOST_HOT, LEAST_HOT = 10_000, 1_000
BROADCAST_BYTES = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; one of fewer files than cores is dealt out over them, as a file of one row group is one task."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python 1,000 rows at a time, so that the workers of several stages fit beside the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Sets one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor costs no recomputation."""
    at = shared_dir(df.sparkSession)
    df.write.parquet(at, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._saved_at = (at,)
    return out


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads these saved tables: to discard it is to discard them."""
    df._saved_at = tuple(at for t in tables for at in t._saved_at)
    return df


def discard(*tables: DataFrame | None) -> None:
    """Removes the folders of saved tables that nothing reads any more. Others are left alone; after an error all stay."""
    for df in tables:
        for at in getattr(df, "_saved_at", ()):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


Batches = Iterator[pa.RecordBatch]


def tidy(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """f for mapInArrow. When a task ends, its worker, which later stages use again, hands freed memory back to the system."""

    @functools.wraps(f)
    def run(batches: Batches) -> Batches:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps up to 64 MB otherwise
                trim(0)

    return run


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased words of all texts in one run, dictionary-coded, and each text's offset in it (nulls: no words)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    words, offsets = lists.flatten(), np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    keep = np.asarray(pc.not_equal(words, "").to_numpy(zero_copy_only=False), bool)
    if not keep.all():
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        words = words.filter(pa.array(keep))
    return words.dictionary_encode(), offsets


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words and each text's offset, as in words_of."""
    coded, offsets = words_of(texts)
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, n: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Per text its sorted distinct hashes of n consecutive words; a shorter text has one shingle of all its words, an empty one none."""
    words, offsets = word_hashes(texts)
    with np.errstate(over="ignore"):
        power = np.uint64(0x9E3779B97F4A7C15)
        run = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            run = run * power + words[k : k + len(run)]
        run = mix(run)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= n:
                yield np.unique(run[a : b - n + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = whole * power + w
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of equal keys from batches sorted by them, one at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not part.num_rows:
            continue
        change = np.zeros(part.num_rows, bool)
        for k in keys:
            v = part.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        bounds = [0, *np.flatnonzero(change), part.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            key = tuple(part.column(k)[int(a)].as_py() for k in keys)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def fits_broadcast(table: DataFrame, row_bytes: int) -> bool:
    """Whether a saved table's rows fit in BROADCAST_BYTES; where not, joins go by shuffle."""
    return table.count() * row_bytes <= BROADCAST_BYTES


def hot_keys(counts: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Of counts (key, n) the keys that hold more than one row in MOST_HOT, so fewer than MOST_HOT of them: small enough to broadcast. And how many salts share the hottest out."""
    total, most = counts.agg(F.sum("n"), F.max("n")).head()
    bound = max(LEAST_HOT, (total or 0) // MOST_HOT)
    return counts.filter(F.col("n") > bound).select(F.col(key).alias("__hot")), max(1, min(1024, -(-(most or 0) // bound)))


def salted(rows: DataFrame, key: str, by: str, hot: DataFrame, salts: int) -> DataFrame:
    """The many side of a join: rows of hot keys are dealt over `salts` values of __salt."""
    if salts == 1:
        return rows.withColumn("__salt", F.lit(0))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    return out.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(by, F.lit("salt")), F.lit(salts)).cast("int"))).drop("__hot")


def replicated(rows: DataFrame, key: str, hot: DataFrame, salts: int) -> DataFrame:
    """The other side: rows of hot keys once for each salt."""
    if salts == 1:
        return rows.withColumn("__salt", F.lit(0))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    return out.withColumn("__salt", F.explode(F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1))))).drop("__hot")
