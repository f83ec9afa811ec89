"""Connected components, and all links inside candidate clusters, for the pair operators (5 and 6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import discard, fits_broadcast, groups, hot_keys, reading, replicated, salted, saved, tidy

CHUNK, CHUNK_BYTES = 256, 1 << 22


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of undirected edges (a, b); a component is named by one of its nodes. No edges, no rows.

    Rounds of contraction: every node takes the smallest of itself and its neighbours as its label, edges between labels
    are the next round's graph. Node ids must be hashes, so that a constant share of the nodes goes in each round. Minima
    are partial aggregates, and the edges of hubs are dealt over salts in the joins; rounds are written to the shared
    folder, and nothing but the question whether edges are left reaches the driver.
    """

    def paired(x: Column, y: Column) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    left = saved(edges.select(*paired(F.col("a"), F.col("b"))).filter("a <> b").distinct())
    labels = None
    while labels is None or not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("next")))
        step = saved(ends.groupBy("node").agg(F.min("next").alias("next"), F.count(F.lit(1)).alias("n")).select("node", F.least("node", "next").alias("component"), "n"))
        hot, salts = hot_keys(step, "node")
        label = replicated(step.drop("n"), "node", hot, salts)
        known = salted(left, "a", "b", hot, salts).join(label.select(F.col("node").alias("a"), F.col("component").alias("x"), "__salt"), ["a", "__salt"]).select("a", "b", "x")
        known = salted(known, "b", "a", hot, salts).join(label.select(F.col("node").alias("b"), F.col("component").alias("y"), "__salt"), ["b", "__salt"])
        done, left = left, saved(known.filter("x <> y").select(*paired(F.col("x"), F.col("y"))).distinct())
        discard(done)
        if labels is None:
            labels = reading(step.select("node", "component"), step)
        else:
            later = step.select(F.col("node").alias("component"), F.col("component").alias("final"))
            done, labels = labels, saved(labels.join(later, "component", "left").select("node", F.coalesce("final", "component").alias("component")))
            discard(done, step)
    discard(left)
    return labels


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index in each index's component."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & (root < 0))
                root[front] = i
    return root


def links_within(members: DataFrame, payload: str, matrix: Callable[[list[bytes], list[bytes]], np.ndarray], chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """All linked pairs inside clusters: members (cluster, rec, size, payload) -> (rec, n_links) and edges (a, b) that span the links.

    matrix(left payloads, right payloads) says which pairs are linked. A cluster of more than `chunk` members or
    CHUNK_BYTES is dealt into chunks, and each pair of chunks is a group of its own: no task gets a whole large cluster,
    and no pair becomes a row. n_links sums the sizes of the linked records; edges join each group's linked records to
    one of them. members should be saved, as it is read twice; the links are.
    """
    sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum(F.length(payload)) / CHUNK_BYTES)).cast("int").alias("chunks"), F.count(F.lit(1)).alias("n"))
    large = saved(sizes.filter("chunks > 1"))
    hot, salts = hot_keys(large, "cluster")
    if fits_broadcast(large, 48):
        dealt = members.join(F.broadcast(large.drop("n")), "cluster", "left")
    else:
        dealt = salted(members, "cluster", "rec", hot, salts).join(replicated(large.drop("n"), "cluster", hot, salts), ["cluster", "__salt"], "left")
    dealt = dealt.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("rec", F.lit("chunk")), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("cluster", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "rec", "size", payload)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["cluster", "i", "j"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rows = 0
        for t in groups(batches, keys):
            if t.num_rows < 2:
                continue
            i, j, c = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("c").to_numpy()
            rec, size, data = t.column("rec").to_numpy(), t.column("size").to_numpy(), t.column(payload).to_pylist()
            own, far = np.flatnonzero(c == i), np.flatnonzero(c == j)
            yes = matrix([data[k] for k in own], [data[k] for k in far])
            whole = np.zeros((len(rec), len(rec)), bool)
            whole[np.ix_(own, far)] = yes
            whole |= whole.T
            np.fill_diagonal(whole, False)
            some = np.flatnonzero(whole.any(0))
            if len(some):
                out.append((rec[some], whole[some] @ size, rec[local_roots(whole)[some]]))
                rows += len(some)
            if rows > 50_000:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["rec", "add", "root"])
                out, rows = [], 0
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["rec", "add", "root"])

    found = saved(dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "rec").mapInArrow(tidy(link), "rec long, add long, root long"))
    discard(large)
    return reading(found.groupBy("rec").agg(F.sum("add").alias("n_links")), found), found.select(F.col("rec").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct()
