"""Exact top-k search by distributed histogram selection (operator 8).

Candidates stand in blocks, in one copy. Queries come in blocks of a bounded size, which are broadcast one after the
other, and a task holds each of its candidate blocks against them by matrix products. A first pass finds each query's
score range; each further pass counts scores in 256 equal bins of the range that still holds the kth value and narrows
it to one bin, until the range is one value. The last pass keeps what reaches that value; of equal scores a task
sends its k smallest ids at most, which loses nothing, and the final ranks are taken from those. Tasks send what they
have counted over all their blocks, so little is shuffled, and disk doesn't grow with the number of query blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.llm.common import discard, reading, saved, tidy

BLOCK = 1024
QUERY_BLOCK = 8192
AT_ONCE = 256  # queries in one matrix product
BINS = 256
KEPT = 1 << 18  # rows that the last pass holds before it drops what is beaten
EXACT = float(1 << 53)
BLOCK_TYPE = "dim int, block long, ids binary, vectors binary"


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, with components floor(scale * x) as doubles: a null vector or null or non-finite component excludes its row."""
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "embedding").filter(usable).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of equal dimension gathered into blocks, each one row with a matrix."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, v = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"), batch.column(1)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype("<f8"), np.cumsum(sizes)
            out = []
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                for a in range(0, len(at), size):
                    part = at[a : a + size]
                    out.append((int(dim), number, ids[part].tobytes(), flat[(ends[part] - dim)[:, None] + np.arange(dim)].astype("<f8").tobytes()))
                    number += 1
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["dim", "block", "ids", "vectors"])

    return rows.mapInArrow(gather, BLOCK_TYPE)


OWN = np.iinfo(np.int64).min


class Asked:
    """A block of queries: ids, matrices by dimension, and for each query the range that holds its kth value."""

    def __init__(self, ids: list[int], vectors: list[list[float]]):
        self.ids = np.array(ids, np.int64)
        sizes = np.array([len(v) for v in vectors])
        self.of_dim = {int(d): (at := np.flatnonzero(sizes == d), np.array([vectors[i] for i in at], float).reshape(len(at), d)) for d in np.unique(sizes)}
        self.low, self.high, self.need = (np.zeros(len(ids), np.int64) for _ in range(3))

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, candidate ids, exact scores) for each part; a query's own rows are masked as the lowest long."""
        for dim, ids, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "vectors"))):
            if dim not in self.of_dim:
                continue
            c_ids, (at, matrix) = np.frombuffer(ids, "<i8"), self.of_dim[dim]
            c = np.frombuffer(data, "<f8").reshape(len(c_ids), dim)
            most = np.abs(c).max(initial=0)
            for a in range(0, len(at), AT_ONCE):
                q, x = at[a : a + AT_ONCE], matrix[a : a + AT_ONCE]
                exact = (np.abs(x).max(initial=0) * most + 1) * max(dim, 1) < EXACT
                s = (x @ c.T).astype(np.int64) if exact else x.astype(np.int64) @ c.astype(np.int64).T
                s[self.ids[q][:, None] == c_ids[None, :]] = OWN
                yield q, c_ids, s


Batches = Iterator[pa.RecordBatch]


def ranges(asked: Asked, batches: Batches) -> dict:
    low, high, n = np.full(len(asked.ids), np.iinfo(np.int64).max), np.full(len(asked.ids), OWN), np.zeros(len(asked.ids), np.int64)
    for batch in batches:
        for q, _, s in asked.scores(batch):
            real = s != OWN
            n[q] += real.sum(1)
            low[q] = np.minimum(low[q], np.where(real, s, low[q][:, None]).min(1, initial=np.iinfo(np.int64).max))
            high[q] = np.maximum(high[q], s.max(1, initial=OWN))
    some = np.flatnonzero(n)
    return {"q": some, "low": low[some], "high": high[some], "n": n[some]}


def histogram(asked: Asked, batches: Batches) -> dict:
    """Counts by bin from the top, as far as the task alone would need; bins below can't hold a kth value of the whole."""
    counts = np.zeros((len(asked.ids), BINS), np.int64)
    width = -(-(asked.high - asked.low + 1) // BINS)
    for batch in batches:
        for q, _, s in asked.scores(batch):
            low, high = asked.low[q][:, None], asked.high[q][:, None]
            row, at = np.nonzero((s >= low) & (s <= high) & (low < high))
            bins = (s[row, at] - low[row, 0]) // width[q][row]
            counts[q] += np.bincount(row * BINS + bins, minlength=len(q) * BINS).reshape(len(q), BINS)
    above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
    q, bins = np.nonzero((counts > 0) & (above < asked.need[:, None]))
    return {"q": q, "bin": bins, "n": counts[q, bins]}


def reached(k: int):
    def best(asked: Asked, batches: Batches) -> dict:
        held: list[tuple] = []

        def cut() -> tuple:
            q, c, s = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in range(3))
            order = np.lexsort((c, -s, q))
            q, c, s = q[order], c[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            return q[place < k], c[place < k], s[place < k]

        for batch in batches:
            for q, c, s in asked.scores(batch):
                row, at = np.nonzero((s >= asked.low[q][:, None]) & (s != OWN))
                held.append((q[row], c[at], s[row, at]))
            if sum(len(x[0]) for x in held) > KEPT:
                held = [cut()]
        return dict(zip(("q", "vec_id", "score"), cut()))

    return best


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """For each query its k highest inner products of quantised vectors, ties to the smaller vec_id.

    Columns query_id, rank, vec_id, score. Vectors that are null or hold a null or a non-finite component take no part, nor
    do rows without vec_id; a query meets vectors of its own dimension only; rows that repeat a query's vec_id count as
    its own, and of unlike ones the smallest vector asks. Fewer candidates than k give fewer rows, an empty table none.
    Other columns are ignored. Scores must fit a 64-bit integer.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors.filter("vec_id is not null"), scale)
    candidates = saved(blocks(rows, BLOCK))
    queries = saved(quantised(vectors.filter("vec_id is not null").filter(is_query), scale).groupBy("vec_id").agg(F.min("v").alias("v")))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts: list[DataFrame] = []
    for block in range(n_blocks):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n_blocks)) == block).orderBy("vec_id").collect()
        asked = Asked([r["vec_id"] for r in mine], [r["v"] for r in mine])

        def passed(work, schema: str) -> DataFrame:
            shared = spark.sparkContext.broadcast(asked)

            def run(batches: Batches) -> Batches:
                found = work(shared.value, batches)
                yield pa.record_batch({n: pa.array(np.asarray(v), pa.int64()) for n, v in found.items()})

            return candidates.mapInArrow(tidy(run), schema)

        for r in passed(ranges, "q long, low long, high long, n long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.least(F.sum("n"), F.lit(k)).alias("need")).collect():
            asked.low[r["q"]], asked.high[r["q"]], asked.need[r["q"]] = r["low"], r["high"], r["need"]
        while (asked.low < asked.high).any():
            counts = passed(histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            down = Window.partitionBy("q").orderBy(F.desc("bin"))
            counts = counts.withColumn("upto", F.sum("n").over(down))
            need = spark.createDataFrame([*enumerate(asked.need.tolist())], "q long, need long")
            for r in counts.join(F.broadcast(need), "q").filter("upto >= need and upto - n < need").collect():
                q = r["q"]
                width = -(-(int(asked.high[q]) - int(asked.low[q]) + 1) // BINS)
                asked.low[q] += r["bin"] * width
                asked.high[q] = min(int(asked.high[q]), int(asked.low[q]) + width - 1)
                asked.need[q] -= r["upto"] - r["n"]
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        best = passed(reached(k), "q long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([*enumerate(asked.ids.tolist())], "q long, query_id long")
        parts.append(saved(best.join(F.broadcast(ids), "q").select("query_id", "rank", "vec_id", "score")))
    discard(candidates, queries)
    return reading(reduce(DataFrame.unionByName, parts), *parts)
