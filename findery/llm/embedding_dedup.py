"""Embedding near-dedup by NN-descent (operator 6).

Equal vectors under one label are one record. A neighbour graph starts from windows of rows sorted by random
hyperplane codes, then is refined: each record's neighbours, in its own list and those in whose lists it stands, are
compared with one another, so that a record meets its neighbours' neighbours, as long as at least one of a pair is new,
and lists keep their best. A list whose last entry reaches the threshold is
saturated and doubles, ENLARGE times at most. Edges near the threshold join records to clusters. Lists that end
saturated don't show what lies beyond them, so a cluster's saturated records are a ball (a centre and the largest angle
to it), and every record outside the cluster that the triangle inequality lets link into the ball is compared with its
records. In the clusters so joined every pair is decided by its cosine in double precision. A sample audits the recall
against all rows, by link and by record; under RECALL the graph is refined again from new windows with lists of twice
the length, and in the end all pairs of a label are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.clusters import components, links_within
from findery.llm.common import discard, groups, hot_keys, reading, replicated, salted, saved, tidy

THRESHOLD = 0.93
NEIGHBOURS = 8
TREES = 6
WINDOW = 256
ROUNDS = 6
ENLARGE = 2
SETTLED = 0.002
ERROR = 0.02  # of the 8-bit cosine that guides the search
AUDIT = 256
RECALL = 0.99
MOST_ATTEMPTS = 3
BALLS, VISITORS = 256, 4096  # compared at once
SCALE = 127.0


def coded(rows: DataFrame) -> DataFrame:
    """(vec_id, rec, label, dim, vec: doubles, low: 8-bit direction); rec is null where a vector links with nothing."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs, dims, vecs, lows = [], [], [], []
            for v, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
                x = np.array(v, "<f8") if v and label is not None and None not in v else None
                if x is None or not np.isfinite(x).all() or not x.any():
                    recs.append(None), dims.append(None), vecs.append(None), lows.append(None)
                    continue
                x = x / np.abs(x).max()  # no overflow in squares
                unit = x / np.sqrt(x @ x)
                recs.append(xxhash.xxh3_64_intdigest(np.array([label], "<i8").tobytes() + np.array(v, "<f8").tobytes()) - (1 << 63))
                dims.append(len(v)), vecs.append(unit.tobytes()), lows.append(np.rint(unit * SCALE).astype(np.int8).tobytes())
            yield pa.record_batch([batch.column("vec_id"), pa.array(recs, pa.int64()), batch.column("label").cast(pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(lows, pa.binary())], names=["vec_id", "rec", "label", "dim", "vec", "low"])

    return rows.mapInArrow(code, "vec_id long, rec long, label long, dim int, vec binary, low binary")


def first_graph(records: DataFrame, bits: int, seed: int, k: int) -> DataFrame:
    """Edges (u, v, s) to the best of each window of rows sorted by label and hyperplane code, for each of TREES codes."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, lows = batch.column("dim").to_numpy(), batch.column("low").to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if (r := made.get(int(dim))) is None:
                    r = made[int(dim)] = np.random.default_rng([seed, int(dim)]).normal(size=(int(dim), TREES * (bits + 1)))
                x = np.frombuffer(b"".join(lows[i] for i in at), np.int8).reshape(len(at), dim) @ r
                x = x.reshape(len(at), TREES, bits + 1)
                code = ((x[:, :, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
                take = pa.array(np.repeat(at, TREES))
                yield pa.record_batch([pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(at))), *(batch.column(c).take(take) for c in ("label", "dim")), pa.array(code.ravel()), pa.array(x[:, :, bits].ravel()), *(batch.column(c).take(take) for c in ("rec", "low"))], names=["tree", "label", "dim", "code", "at", "rec", "low"])

    keys = ["tree", "label", "dim", "code", "at", "rec"]
    rows = records.select("rec", "label", "dim", "low").mapInArrow(planes, "tree int, label long, dim int, code long, at double, rec long, low binary")
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in windows(batches, ["tree", "label", "dim"], WINDOW):
            n, rec = t.num_rows, t.column("rec").to_numpy()
            if n < 2:
                continue
            x = np.frombuffer(b"".join(t.column("low").to_pylist()), np.int8).reshape(n, -1).astype(np.float32)
            x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            best = np.argpartition(-s, min(k, n - 1) - 1, 1)[:, : min(k, n - 1)]
            u = np.repeat(np.arange(n), best.shape[1])
            yield pa.record_batch([pa.array(rec[u]), pa.array(rec[best.ravel()]), pa.array(s[u, best.ravel()].astype(np.float64))], names=["u", "v", "s"])

    return rows.mapInArrow(near, "u long, v long, s double")


def windows(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, at most `size` at a time."""
    held: list[pa.Table] = []
    rows, last = 0, None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        change = np.zeros(part.num_rows, bool)
        for k in keys:
            v = part.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        bounds = [0, *np.flatnonzero(change), part.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            key = tuple(part.column(k)[int(a)].as_py() for k in keys)
            if held and key != last:
                yield pa.concat_tables(held)
                held, rows = [], 0
            last = key
            while a < b:
                take = min(b - a, size - rows)
                held.append(part.slice(a, take))
                rows, a = rows + take, a + take
                if rows == size:
                    yield pa.concat_tables(held)
                    held, rows = [], 0
    if held:
        yield pa.concat_tables(held)


def best_lists(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of edges (u, v, s, fresh) the best k of each u, without repeats; saturated lists keep up to k * 2**ENLARGE entries at or over the threshold."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, kept, k_most = None, set(), 0, k << ENLARGE
        for batch in batches:
            u, v, s = (batch.column(c).to_numpy() for c in ("u", "v", "s"))
            take = []
            for i, (a, b, x) in enumerate(zip(u.tolist(), v.tolist(), s.tolist())):
                if a != last:
                    last, seen, kept = a, set(), 0
                if b in seen or not (kept < k or x >= threshold - ERROR and kept < k_most):
                    continue
                seen.add(b)
                kept += 1
                take.append(i)
            yield batch.take(pa.array(take, pa.int64())) if take else batch.slice(0, 0)

    # of the same edge the known one comes first, so that it isn't fresh again
    return edges.repartition(parts, "u").sortWithinPartitions("u", F.desc("s"), "v", "fresh").mapInArrow(keep, edges.schema)


def refined(graph: DataFrame, records: DataFrame, k: int, threshold: float) -> DataFrame:
    """New edges from comparing each record's neighbours, those that list it too, with one another, both ways, where they beat the end of the list, or reach the threshold and the list is saturated and has room.

    Of the records that list one, as many of the best are taken as a list of its own may hold, so hubs stay small; records
    beyond are found by the settling of saturated lists.
    """
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    room = (F.min("s") >= threshold - ERROR) & (F.count(F.lit(1)) < k << ENLARGE)
    ends = graph.groupBy("u").agg(F.when(room, F.lit(threshold - ERROR)).otherwise(F.min("s")).alias("worst"))
    both = best_lists(graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "fresh")), 2 * k, threshold)
    changed = both.groupBy("u").agg(F.max("fresh").alias("any")).filter("any").select(F.col("u").alias("w"))
    lists = both.join(changed, F.col("u") == F.col("w"), "left_semi")
    known = records.select(F.col("rec").alias("v"), "low").join(ends.select(F.col("u").alias("v"), "worst"), "v", "left")
    hot, salts = hot_keys(graph.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v")  # records that stand in very many lists
    sent = salted(lists, "v", "u", hot, salts).join(replicated(known, "v", hot, salts), ["v", "__salt"]).select("u", "v", "fresh", "low", "worst")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for t in groups(batches, ["u"]):
            n = t.num_rows
            if n < 2:
                continue
            v, fresh, worst = t.column("v").to_numpy(), t.column("fresh").to_numpy(), t.column("worst").to_numpy()
            x = np.frombuffer(b"".join(t.column("low").to_pylist()), np.int8).reshape(n, -1).astype(np.float32)
            x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
            s = x @ x.T
            i, j = np.nonzero((fresh[:, None] | fresh[None, :]) & (s > worst[:, None]) & (v[:, None] != v[None, :]))
            if len(i):
                out.append((v[i], v[j], s[i, j].astype(np.float64)))
            if len(out) == 2048:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["u", "v", "s"])
                out = []
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["u", "v", "s"])

    found = sent.repartition(parts, "u").sortWithinPartitions("u").mapInArrow(meet, "u long, v long, s double")
    return found.distinct().withColumn("fresh", F.lit(True))


def nn_descent(records: DataFrame, n: int, most_of_label: int, seed: int, k: int, threshold: float) -> DataFrame:
    """The refined graph (u, v, s, fresh) of records (rec, label, dim, low)."""
    bits = int(np.clip(np.ceil(np.log2(max(1, most_of_label) / (WINDOW / 2))), 1, 40))
    graph = saved(best_lists(first_graph(records, bits, seed, k).withColumn("fresh", F.lit(True)), k, threshold))
    for _ in range(ROUNDS):
        merged = graph.withColumn("fresh", F.lit(False)).unionByName(refined(graph, records, k, threshold))
        before, graph = graph, saved(best_lists(merged, k, threshold))
        discard(before)
        if graph.filter("fresh").count() <= SETTLED * n * k:
            break
    return graph


def cosine_matrix(threshold: float):
    def matrix(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a, b = (np.frombuffer(b"".join(x), "<f8").reshape(len(x), -1) if x else np.zeros((0, 0)) for x in (left, right))
        return a @ b.T >= threshold if len(a) and len(b) else np.zeros((len(a), len(b)), bool)

    return matrix


def settled(graph: DataFrame, clusters: DataFrame, records: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between clusters (node, component): all that the records of saturated lists have with records outside their cluster, or a way between them."""
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = graph.groupBy("u").agg(F.min("s").alias("worst")).filter(F.col("worst") >= threshold - ERROR).select(F.col("u").alias("rec"))
    of = records.select("rec", "label", "dim", "vec").join(clusters.withColumnRenamed("node", "rec"), "rec", "left")
    inside = saved(of.join(full, "rec").filter("component is not null"))
    centres = inside.groupBy("component").agg(F.min_by("vec", "rec").alias("centre"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = [np.frombuffer(a, "<f8") @ np.frombuffer(b, "<f8") for a, b in zip(batch.column("vec").to_pylist(), batch.column("centre").to_pylist())]
            yield pa.record_batch([*(batch.column(c) for c in ("component", "label", "dim", "centre")), pa.array(np.arccos(np.clip(np.array(cos, float), -1, 1)))], names=["component", "label", "dim", "centre", "angle"])

    away = inside.join(centres, "component").select("component", "label", "dim", "vec", "centre").mapInArrow(angles, "component long, label long, dim int, centre binary, angle double")
    balls = saved(away.groupBy("component", "label", "dim").agg(F.first("centre").alias("vec"), F.max("angle").alias("radius")))
    keys = ["label", "dim", "i", "j"]
    chunks = balls.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BALLS).cast("int").alias("of_balls"))
    chunks = chunks.join(records.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("of_records")), ["label", "dim"])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda c, n: F.pmod(F.xxhash64(c, F.lit("chunk")), F.col(n)).cast("int")
    left = balls.join(chunks, ["label", "dim"]).withColumn("i", one("component", "of_balls")).withColumn("j", each("of_records"))
    right = of.join(chunks, ["label", "dim"]).withColumn("j", one("rec", "of_records")).withColumn("i", each("of_balls"))
    both = left.select(*keys, F.lit(None).cast("long").alias("rec"), "component", "vec", "radius").unionByName(right.select(*keys, "rec", "component", "vec", F.lit(None).cast("double").alias("radius")))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, keys):
            ball = np.asarray(t.column("rec").is_null())
            if not ball.any() or ball.all():
                continue
            x = np.frombuffer(b"".join(t.column("vec").to_pylist()), "<f8").reshape(t.num_rows, -1)
            # -1 for no cluster can't be told from a hash of -1, so the mask counts too
            alone, component = np.asarray(t.column("component").is_null()), t.column("component").fill_null(-1).to_numpy()
            least = np.cos(np.minimum(np.pi, t.column("radius").to_numpy()[ball] + np.arccos(threshold))) - 1e-6
            near = (x[~ball] @ x[ball].T >= least) & (alone[~ball, None] | (component[~ball, None] != component[None, ball]))
            r, b = np.nonzero(near)
            yield pa.record_batch([t.column("rec").combine_chunks().take(pa.array(np.flatnonzero(~ball)[r])), pa.array(component[ball][b])], names=["rec", "cluster"])

    visits = saved(both.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(tidy(reach), "rec long, cluster long"))
    visited = visits.select("cluster").distinct()
    at_home = inside.join(visited, F.col("component") == F.col("cluster"), "left_semi").select("rec", F.col("component").alias("cluster"), "vec")
    members = at_home.unionByName(visits.join(records.select("rec", "vec"), "rec").select("rec", "cluster", "vec"))
    return links_within(members.withColumn("size", F.lit(1).cast("long")), "vec", cosine_matrix(threshold))[1]


def audited(rows: DataFrame, by_rec: DataFrame, threshold: float) -> float:
    """Recall of a sample of at most AUDIT records' links, those of the smallest hashes, against all rows: over links, or over records where that is less."""
    sample = by_rec.join(rows.select("rec", "label", "dim", "vec").dropDuplicates(["rec"]), "rec").orderBy(F.xxhash64("rec", F.lit("audit")), "rec").limit(AUDIT).collect()
    asked = rows.sparkSession.sparkContext.broadcast([(r["rec"], r["label"], r["dim"], r["vec"]) for r in sample])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[tuple, list] = {}
        for rec, label, dim, vec in asked.value:
            of.setdefault((label, dim), []).append((rec, vec))
        of = {key: ([r for r, _ in v], np.stack([np.frombuffer(x, "<f8") for _, x in v])) for key, v in of.items()}
        for batch in batches:
            label, dim, vec = batch.column("label").to_numpy(), batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
            for key, (recs, x) in of.items():
                at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                if len(at):
                    y = np.frombuffer(b"".join(vec[i] for i in at), "<f8").reshape(len(at), -1)
                    yield pa.record_batch([pa.array(recs, pa.int64()), pa.array((x @ y.T >= threshold).sum(1).astype(np.int64))], names=["rec", "n"])

    true = rows.filter("rec is not null").select("label", "dim", "vec").mapInArrow(count, "rec long, n long").groupBy("rec").agg(F.sum("n").alias("n"))
    got = {r["rec"]: r["n_links"] for r in sample}
    pairs = [(min(got[r["rec"]], r["n"] - 1), r["n"] - 1) for r in true.collect()]  # one of the n is the record itself
    pairs = [(a, b) for a, b in pairs if b]
    if not pairs:
        return 1.0
    by_link, by_record = sum(a for a, _ in pairs) / sum(b for _, b in pairs), sum(a / b for a, b in pairs) / len(pairs)
    return min(by_link, by_record)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors (vec_id, embedding, label) are compared under equal labels that aren't null, and equal dimensions. Vectors that
    are null, zero or empty or hold null or non-finite components link with nothing, as do those with a null label; they
    stand alone and are kept. Equal vectors link with one another. Rows that repeat a vec_id count as vectors of their
    own under it. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = saved(coded(vectors.select("vec_id", "embedding", "label")))
    order = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")
    records = saved(rows.filter("rec is not null").groupBy("rec").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"), *(F.first(c).alias(c) for c in ("label", "dim", "vec", "low"))))
    n = records.count()
    most = records.groupBy("label").count().agg(F.max("count")).head()[0] or 0
    graph, by_rec = None, None
    for attempt in range(MOST_ATTEMPTS + 1):
        if attempt < MOST_ATTEMPTS:
            more = nn_descent(records, n, most, attempt + 1, k << attempt, threshold)
            graph = more if graph is None else graph.unionByName(more)
            edges = graph.filter(F.col("s") >= threshold - ERROR).select(F.col("u").alias("a"), F.col("v").alias("b"))
            clusters = components(edges)
            clusters = components(edges.unionByName(settled(graph, clusters, records, threshold)))
        else:
            clusters = records.select(F.col("rec").alias("node"), F.xxhash64("label", "dim").alias("component"))
        members = clusters.join(records, clusters.node == records.rec).select(F.col("component").alias("cluster"), "rec", "size", "vec")
        links, spans = links_within(members, "vec", cosine_matrix(threshold))
        parts_of = components(spans)
        named = parts_of.join(records, parts_of.node == records.rec).select("rec", "component", "first")
        heads = named.groupBy("component").agg(F.min("first").alias("least"))
        group_of = named.join(heads, "component").select("rec", F.col("least.vec_id").alias("component_id"))
        all_ = records.select("rec", F.col("first.vec_id").alias("own"), "size").join(links, "rec", "left").join(group_of, "rec", "left")
        by_rec = saved(all_.select("rec", "size", F.coalesce("component_id", "own").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
        if attempt == MOST_ATTEMPTS or audited(rows, by_rec, threshold) >= RECALL:
            break
    hot, salts = hot_keys(by_rec.select("rec", F.col("size").alias("n")), "rec")
    # vectors that link with nothing have no record and are dealt by their own id
    alone = F.col("rec").isNull()
    out = salted(rows.select("vec_id", "rec", F.coalesce("rec", F.xxhash64("vec_id")).alias("by")), "by", "vec_id", hot, salts)
    out = out.join(replicated(by_rec.drop("size").withColumnRenamed("rec", "by"), "by", hot, salts), ["by", "__salt"], "left")
    own = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
    return reading(out, rows, by_rec)
