"""N-gram Jaccard self-join by chosen paths (operator 5).

Documents with equal shingle sets are one record. A record is embedded as COORDINATES minhash values; a token is a
coordinate with its value. From the root, each node of the path tree samples about 1 / similarity coordinates by a
hash of its path, and a record follows those that it shares with others: children are (path, coordinate, value). Nodes
of at most BUCKET records are compared by brute force; larger ones are split on further tokens, unless the last split
parted them from less than half of its node (near copies share most tokens): those are compared in blocks, as are all
at DEPTH. Runs are independent, and as many are made as bring a pair at the threshold to the target recall, even if a
share of CROWDED of its coordinates lead to large nodes. A pair must survive every split, so records with a larger share
get more runs, by the deepest level reached. A sample of
documents is held against all others on the way; while its recall is under AUDITED, the runs are doubled.
The comparisons only mark candidates (8-bit tokens, a bound of 4.5 standard deviations below the threshold) and join
them to clusters; within clusters every pair is then decided by its exact Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.clusters import components, links_within, local_roots
from findery.llm.common import SHINGLE_WORDS, SIMILARITY, discard, fits_broadcast, groups, hot_keys, mix, reading, replicated, salted, saved, shingle_sets, tidy

COORDINATES = 64
BUCKET = 1024
DEPTH = 6
KEPT = 0.5  # a split that leaves more than this share of its node together isn't followed by another
TARGET_RECALL = 0.9999
CROWDED = 0.25  # with a larger share of its nodes large, a record gets the runs of the deepest level
AUDIT, AUDITED, MOST_RUNS = 256, 0.99, 1 << 12
_rng = np.random.default_rng(5)
FACTORS = _rng.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, COORDINATES, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minima of a set that isn't empty."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[a : a + 4096, None] * FACTORS + OFFSETS) >> np.uint64(32)).min(0))
    return least.astype("<u4")


def loss(similarity: float, depth: int, runs: int, large: int = 0) -> float:
    """Probability that a pair at the threshold survives `depth` splits in none of the runs, over its number of equal coordinates, of which `large` don't help."""
    lost = 0.0
    for equal in range(COORDINATES + 1):
        survives = 1.0
        for _ in range(depth):
            survives = 1 - (1 - min(1.0, 1 / (similarity * COORDINATES)) * survives) ** max(0, equal - large)
        lost += math.comb(COORDINATES, equal) * similarity**equal * (1 - similarity) ** (COORDINATES - equal) * (1 - survives) ** runs
    return lost


def runs_for(most_lost: float, similarity: float, depth: int, large: int = 0) -> int:
    if most_lost <= loss(similarity, depth, 1 << 20, large):
        raise ValueError("no number of runs reaches this recall")
    return next(n for n in range(1, 1 << 20) if loss(similarity, depth, n, large) <= most_lost)


def least_matches(similarity: float) -> int:
    return max(1, math.floor(COORDINATES * similarity - 4.5 * math.sqrt(COORDINATES * similarity * (1 - similarity))))


def children(paths: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row number and child path for each sampled coordinate of each (path, record)."""
    grid = mix(paths[:, None] + np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row, at = np.nonzero(grid < np.uint64(int(2.0**64 / (similarity * COORDINATES))))
    return row, mix(grid[row, at] ^ mix(tokens[row, at].astype(np.uint64) + np.uint64(1)))


class Sample:
    """Shingle sets that all documents are held against: their shingles in order, and whose each is."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sizes, self.similarity = np.array([len(s) for s in sets], np.int64), similarity
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.shingles, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def linked(self, s: np.ndarray) -> np.ndarray:
        """Which of the sample reach the similarity to the set s."""
        lo, hi = np.searchsorted(self.shingles, s, "left"), np.searchsorted(self.shingles, s, "right")
        met = lo < hi
        if not met.any():
            return np.zeros(0, np.int64)
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo[met], hi[met])])
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (both >= self.similarity * (self.sizes + len(s) - both) - 1e-9))


def sampled(docs: DataFrame, n: int, similarity: float, size: int = AUDIT) -> tuple[list[int], Sample]:
    """Records and sets of at most `size` distinct documents (key, text) with words, those of the smallest hashes."""
    texts = docs.filter(r"text rlike '\\S'").select("key", "text").orderBy(F.xxhash64("key", F.lit("audit")), "key").limit(size).dropDuplicates(["key"]).collect()
    sets = [s for s in shingle_sets(pa.array([r["text"] for r in texts], pa.string()), n) if len(s)]
    return [record_id(s) for s in sets], Sample(sets, similarity)


def record_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def records_of(docs: DataFrame, n: int, sample: Sample) -> DataFrame:
    """(doc_id, key, rec, sig, audit) of each row; rec is a hash of the shingle set, null for texts without words; audit lists what it links with in the sample."""
    asked = docs.sparkSession.sparkContext.broadcast(sample)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                recs, sigs, audit = [], [], []
                for s in shingle_sets(batch.column("text"), n):
                    recs.append(record_id(s) if len(s) else None)
                    sigs.append(minhash(s).tobytes() if len(s) else None)
                    audit.append(found.tolist() if len(s) and len(found := asked.value.linked(s)) else None)
                yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(recs, pa.int64()), pa.array(sigs, pa.binary()), pa.array(audit, pa.list_(pa.int32()))], names=["doc_id", "key", "rec", "sig", "audit"])

    return docs.mapInArrow(tidy(sets), "doc_id long, key long, rec long, sig binary, audit array<int>")


def split(state: DataFrame, similarity: float) -> DataFrame:
    """One level down: (path, rec, sig, up) -> (path, rec, sig, up, low). up: how many records the node split has; low: the low bytes of sig's values."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, COORDINATES)
                row, path = children(batch.column("path").to_numpy().view(np.uint64), sig, similarity)
                at, low8 = pa.array(row), np.ascontiguousarray(sig.astype(np.uint8))
                low = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), batch.num_rows, [None, pa.py_buffer(low8)]).cast(pa.binary())
                yield pa.record_batch([pa.array(path.view(np.int64)), *(batch.column(c).take(at) for c in ("rec", "sig", "up")), low.take(at)], names=["path", "rec", "sig", "up", "low"])

    return state.select("path", "rec", "sig", "up").mapInArrow(tidy(down), "path long, rec long, sig binary, up long, low binary")


def candidates(keyed: DataFrame, keys: list[str], least: int, parts: int) -> DataFrame:
    """Edges between records whose tokens agree often enough, in each group of equal keys; c says which side a row is on."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for t in groups(batches, keys):
            n = t.num_rows
            if n < 2:
                continue
            low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(n, COORDINATES)
            rec = t.column("rec").to_numpy()
            if n == 2:
                if rec[0] != rec[1] and int((low[0] == low[1]).sum()) >= least:
                    left.append(rec[:1])
                    right.append(rec[1:])
                continue
            alike = np.zeros((n, n), bool)
            for a in range(0, n, 64):
                alike[a : a + 64] = (low[a : a + 64, None, :] == low[None, :, :]).sum(2, dtype=np.uint8) >= least
            root = local_roots(alike)
            some = np.flatnonzero(root != np.arange(n))
            left.append(rec[some])
            right.append(rec[root[some]])
            if sum(map(len, left)) > 50_000:
                yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
                left, right = [], []
        if left:
            yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return keyed.repartition(parts, *keys).sortWithinPartitions(*keys, "rec").mapInArrow(tidy(compare), "a long, b long")


def chosen_paths(records: DataFrame, similarity: float, runs: range, most_lost: float) -> tuple[DataFrame, range]:
    """Candidate edges (a, b) between records (rec, sig) by these runs, and by more for crowded records, so that at the deepest
    level that they reached no more than `most_lost` of the pairs at the threshold are lost. Also the range of all runs made."""
    edges, depth, crowded = descend(records, runs, similarity)
    made = runs
    while crowded is not None and (need := runs_for(most_lost, similarity, depth)) > len(made):
        more = range(made.stop, made.start + need)
        again, deepest, _ = descend(records.join(crowded, "rec", "left_semi"), more, similarity)
        edges, depth, made = edges.unionByName(again), max(depth, deepest), range(made.start, more.stop)
    out = saved(edges.distinct())
    discard(crowded)
    return out, made


def of_nodes(state: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of state whose path is in nodes (path, n, up, whole), with those columns; nodes of many records are dealt over salts."""
    nodes_only = nodes.drop("up")
    if fits_broadcast(nodes, 48):
        return state.join(F.broadcast(nodes_only), "path")
    hot, salts = hot_keys(nodes, "path")
    return salted(state, "path", "rec", hot, salts).join(replicated(nodes_only, "path", hot, salts), ["path", "__salt"]).drop("__salt")


def descend(records: DataFrame, runs: range, similarity: float) -> tuple[DataFrame, int, DataFrame | None]:
    """Edges of these runs, the deepest level reached, and the crowded records (rec), if any node was large."""
    crowded = None
    spark = records.sparkSession
    parts, least = int(spark.conf.get("spark.sql.shuffle.partitions")), least_matches(similarity)
    roots = mix(np.array(runs, np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)
    state = records.withColumn("path", F.explode(F.array(*(F.lit(int(r)) for r in roots)))).withColumn("up", F.lit(None).cast("long"))
    edges: list[DataFrame] = []
    for level in range(1, DEPTH + 1):
        state, done = split(state, similarity), state
        if level > 1:
            state = saved(state)
            discard(done)
        sizes = state.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.first("up").alias("up"))
        large = saved(sizes.filter(F.col("n") > BUCKET).withColumn("whole", (F.lit(level) == DEPTH) | F.coalesce(F.col("n") > KEPT * F.col("up"), F.lit(False))))
        n_large, n_split = large.agg(F.count(F.lit(1)), F.count(F.when(~F.col("whole"), 1))).head()
        if n_large:
            of_large = F.broadcast(large) if fits_broadcast(large, 48) else large
            edges.append(saved(candidates(state.join(of_large.select("path"), "path", "left_anti").select("path", "rec", "low"), ["path"], least, parts)))
        else:
            edges.append(saved(candidates(state.select("path", "rec", "low"), ["path"], least, parts)))
            discard(state, large)
            break
        crowd = saved(of_nodes(state.drop("up"), large))
        if level == 1:
            crowded = saved(crowd.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED * len(runs) / similarity).select("rec"))
        chunks = F.ceil(F.col("n") / BUCKET).cast("int")
        side = crowd.filter("whole").withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("rec"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        side = side.select("path", "rec", "low", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"))
        edges.append(saved(candidates(side, ["path", "i", "j"], least, parts)))
        state, done = saved(crowd.filter("not whole").select("path", "rec", "sig", F.col("n").alias("up"))), state
        discard(done, crowd, large)
        if not n_split:
            break
    return reduce(DataFrame.unionByName, edges), level, crowded


def jaccard_matrix(similarity: float):
    def matrix(left: list[bytes], right: list[bytes]) -> np.ndarray:
        """Which pairs of shingle sets reach the similarity, from exact intersection sizes."""
        sets = [np.frombuffer(x, "<u8") for x in [*left, *right]]
        n = np.array([len(s) for s in sets])
        all_, where = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), n)
        common = np.bincount(where) > 1
        number = np.cumsum(common) - 1
        use = common[where]
        owner, where = owner[use], number[where[use]]
        both = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(where, kind="stable")
        owner, where = owner[order], where[order]
        width = 8_192
        for a in range(0, int(common.sum()), width):
            lo, hi = np.searchsorted(where, [a, a + width])
            x = np.zeros((len(sets), width), np.float32)
            x[owner[lo:hi], where[lo:hi] - a] = 1
            both += x[: len(left)] @ x[len(left) :].T
        union = n[: len(left), None] + n[None, len(left) :] - both
        return both >= similarity * union - 1e-9

    return matrix


def ngram_jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE_WORDS, target: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, key (hash of doc_id and text), copy_of, class_id, n_links, class_key.

    Words are lower-cased runs without white space; a document's set holds its distinct runs of `n` words, or all words as
    one run where there are fewer. `copy_of` is the smallest doc_id with an equal set, `class_id` the smallest doc_id that
    links of at least `similarity` reach, itself included; `n_links` counts the other documents linked directly, copies
    too. `class_key` tells classes apart whose smallest doc_ids are equal or null. Documents without words (null or empty
    text) link with nothing, stand alone and have no class_key. Repeated rows count as copies; null doc_ids are kept and
    come last in "smallest". Other columns are ignored; an empty table gives no rows. Raises where the audited sample
    stays under AUDITED after MOST_RUNS runs.
    """
    docs = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    audit_recs, sample = sampled(docs, n, similarity)
    rows = saved(records_of(docs, n, sample))
    true = {r["at"]: r["n"] - 1 for r in rows.select(F.explode("audit").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}  # one is the document itself
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = saved(rows.filter("rec is not null").groupBy("rec").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"), F.first("sig").alias("sig")))
    made, edges = range(1, 1), None
    runs = range(1, runs_for(1 - target, similarity, 1, int(CROWDED * COORDINATES)) + 1)
    while True:
        more, made = chosen_paths(classes.select("rec", "sig"), similarity, runs, 1 - target)
        edges, old = more if edges is None else saved(edges.unionByName(more).distinct()), edges
        if old is not None:
            discard(old, more)
        by_rec = decided(docs, classes, edges, similarity, n)
        got = {r["rec"]: r["n_links"] for r in by_rec.filter(F.col("rec").isin(audit_recs)).select("rec", "n_links").collect()}
        parts = [min(1.0, got[r] / true[i]) for i, r in enumerate(audit_recs) if true.get(i)]
        if sum(parts) >= AUDITED * len(parts):
            break
        if made.stop > MOST_RUNS:
            raise RuntimeError(f"{made.stop - 1} runs find {sum(parts) / len(parts):.4f} of the sample's links")
        runs = range(made.stop, 2 * made.stop)
        discard(by_rec)
    discard(edges, classes)
    alone = F.col("rec").isNull()
    hot, salts = hot_keys(by_rec.select("rec", F.col("size").alias("n")), "rec")
    # texts without words have no record; each has a key of its own, so that they don't meet
    out = salted(rows.select("doc_id", "key", F.coalesce("rec", "key").alias("by"), "rec"), "by", "key", hot, salts)
    out = out.join(replicated(by_rec.drop("size").withColumnRenamed("rec", "by"), "by", hot, salts), ["by", "__salt"], "left")
    out = out.select("doc_id", "key", "rec", *(F.when(~alone, F.col(c)).alias(c) for c in ("copy_of", "class_id", "n_links", "class_key")))
    out = out.select("doc_id", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_key")
    return reading(out, rows, by_rec)


def decided(docs: DataFrame, classes: DataFrame, edges: DataFrame, similarity: float, n: int) -> DataFrame:
    """(rec, size, copy_of, class_id, n_links, class_key) of all records, from exact similarities within the components of candidate edges. Saved."""
    clusters = components(edges)
    wanted = saved(clusters.join(classes, clusters.node == classes.rec).select("rec", F.col("component").alias("cluster"), "size", F.col("first.key").alias("key")))
    texts = docs.select("key", "text").join(F.broadcast(wanted) if fits_broadcast(wanted, 64) else wanted, "key")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column("text"), n)]
                yield pa.record_batch([batch.column("cluster"), batch.column("rec"), batch.column("size"), pa.array(sets, pa.binary())], names=["cluster", "rec", "size", "set"])

    members = saved(texts.mapInArrow(tidy(with_sets), "cluster long, rec long, size long, set binary").dropDuplicates(["rec"]))
    links, spans = links_within(members, "set", jaccard_matrix(similarity))
    parts_of = components(spans)
    named = parts_of.join(classes, parts_of.node == classes.rec).select("rec", "component", F.struct(F.col("first.none").alias("none"), F.col("first.doc_id").alias("doc_id")).alias("first"))
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    group_of = named.join(heads, "component").select("rec", F.col("head.doc_id").alias("class_id"), F.col("component").alias("class_key"))
    by_rec = classes.select("rec", F.col("first.doc_id").alias("copy_of"), "size").join(links, "rec", "left").join(group_of, "rec", "left")
    by_rec = by_rec.select("rec", "size", "copy_of", F.when(F.col("class_key").isNotNull(), F.col("class_id")).otherwise(F.col("copy_of")).alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("class_key", "rec").alias("class_key"))
    by_rec = saved(by_rec)
    discard(clusters, wanted, members, links, parts_of)
    return by_rec
