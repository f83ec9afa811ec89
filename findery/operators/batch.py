"""Exact search for a batch of queries without ranking whole lists.

Documents come to a task in chunks; a matrix product gives a chunk's scores for all queries. Only the best of each chunk
leave a task. Reciprocal rank fusion needs no more: a document beyond place rrf_k + 2 * k in both lists has a lower fused
score than the first k of either list, so candidates are the documents of those places. A candidate's rank in the list
where it isn't among them is one more than the documents before it, which one more pass counts. What reaches the driver
is bounded by the batch of queries, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findery.functions import scoring

CHUNK, CELLS = 2048, 1 << 22
QUERY_BATCH = 512

Scored = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, scores (id x query), which of them are there


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """At least `rows` rows at a time, and never a doc_id in two of those: batches are sorted by it, or it doesn't repeat."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        ids, at = t.column("doc_id").to_numpy(zero_copy_only=False), 0
        while at < t.num_rows:
            take = min(rows - n, t.num_rows - at)
            if n >= rows:  # only what is left of the last document
                last, take = held[-1].column("doc_id")[-1].as_py(), 0
                while at + take < t.num_rows and ids[at + take] == last:
                    take += 1
            if take:
                held.append(t.slice(at, take))
                n, at = n + take, at + take
            if n >= rows and at < t.num_rows and ids[at] != held[-1].column("doc_id")[-1].as_py():
                yield pa.concat_tables(held)
                held, n = [], 0
    if held:
        yield pa.concat_tables(held)


class ScoreList:
    """A list of scores: rows (with doc_id) and what makes a chunk of them into scores for n queries."""

    def __init__(self, rows: DataFrame, score: Callable[[pa.Table], Scored], n: int, chunk: int):
        self.rows, self.score, self.n, self.chunk = rows, score, n, chunk

    def _each(self, work: Callable[[Scored], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        score, chunk = self.score, self.chunk

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in chunks(batches, chunk):
                yield from work(score(t))

        return self.rows.mapInArrow(run, schema)

    def best(self, k: int) -> list[list[tuple[str, float]]]:
        """For each query its k best (doc_id, score), by falling score and then doc_id."""
        kind = self.rows.schema["doc_id"].dataType.simpleString()
        schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64() if kind == "bigint" else pa.string()), ("score", pa.float64())])

        def cut(scored: Scored) -> Iterator[pa.RecordBatch]:
            ids, s, there = scored
            place = np.argsort(np.argsort(ids))
            out: list[tuple] = []
            for q in range(s.shape[1]):
                at = np.flatnonzero(there[:, q])
                if len(at) > k:
                    least = np.partition(s[at, q], len(at) - k)[len(at) - k]
                    at = at[s[at, q] >= least]
                at = at[np.lexsort((place[at], -s[at, q]))][:k]
                out.append((np.full(len(at), q), ids[at], s[at, q]))
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        rows = self._each(cut, f"query int, doc_id {kind}, score double") if k else self.rows.limit(0).select(F.lit(0).alias("query"), "doc_id", F.lit(0.0).alias("score"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")  # Spark cuts before the shuffle, too
        found: list[list[tuple[str, float]]] = [[] for _ in range(self.n)]
        for r in rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).orderBy("query", "place").collect():
            found[r["query"]].append((r["doc_id"], r["score"]))
        return found

    def of(self, wanted: list[list[str]]) -> list[dict[str, float]]:
        """For each query the scores of these documents, as far as the list has them."""
        by_id: dict[str, list[int]] = {}
        for q, ids in enumerate(wanted):
            for i in ids:
                by_id.setdefault(i, []).append(q)
        known = self.rows.sparkSession.sparkContext.broadcast(by_id)

        def pick(scored: Scored) -> Iterator[pa.RecordBatch]:
            ids, s, there = scored
            out = [(q, i, s[r, q]) for r, i in enumerate(ids) for q in known.value.get(i, ()) if there[r, q]]
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.float64()))], names=["query", "doc_id", "score"])

        found: list[dict[str, float]] = [{} for _ in range(self.n)]
        if by_id:
            spark = self.rows.sparkSession
            listed = F.broadcast(spark.createDataFrame([(i,) for i in by_id], "doc_id string"))
            part = ScoreList(self.rows.join(listed, "doc_id", "left_semi"), self.score, self.n, self.chunk)
            for r in part._each(pick, "query int, doc_id string, score double").collect():
                found[r["query"]][r["doc_id"]] = r["score"]
        return found

    def before(self, wanted: list[dict[str, float]]) -> list[dict[str, int]]:
        """For each query and document with its score, how many of the list come before it."""
        if not any(wanted):
            return [{} for _ in wanted]
        asked = self.rows.sparkSession.sparkContext.broadcast([(np.array([*x], object), np.array([*x.values()], float)) for x in wanted])

        def count(scored: Scored) -> Iterator[pa.RecordBatch]:
            ids, s, there = scored
            every = np.concatenate([ids, *(w for w, _ in asked.value)])
            place = np.unique(every.astype(str), return_inverse=True)[1]
            own, at = place[: len(ids)], len(ids)
            out: list[tuple] = []
            for q, (w, x) in enumerate(asked.value):
                if len(w):
                    theirs, at = place[at : at + len(w)], at + len(w)
                    has = there[:, q]
                    y, mine = s[has, q][:, None], own[has][:, None]
                    out.append((np.full(len(w), q), np.arange(len(w)), ((y > x) | ((y == x) & (mine < theirs))).sum(0)))
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], names=["query", "at", "n"])

        found: list[dict[str, int]] = [{} for _ in wanted]
        names = [[*x] for x in wanted]
        for r in self._each(count, "query int, at int, n long").groupBy("query", "at").agg(F.sum("n").alias("n")).collect():
            found[r["query"]][names[r["query"]][r["at"]]] = r["n"]
        return found


def vector_list(vectors: DataFrame, queries: list[list[float]], repeats: bool) -> ScoreList:
    """Cosines of all vectors (doc_id, embedding); where documents repeat, their rows meet and add up."""
    q = np.array(queries, float)
    lengths = np.sqrt((q * q).sum(1))

    def score(t: pa.Table) -> Scored:
        lists = t.column("embedding").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        if len(sizes) and not (sizes == q.shape[1]).all():
            raise ValueError("vectors of unlike dimensions")
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, q.shape[1])
        s = (x @ q.T) / np.maximum(np.sqrt((x * x).sum(1))[:, None] * lengths, scoring.LEAST)
        ids = t.column("doc_id").to_numpy(zero_copy_only=False)
        if repeats:
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            ids, s = ids[first], np.add.reduceat(s, first, axis=0)
        return ids, np.round(s, scoring.DIGITS), np.ones(s.shape, bool)

    rows = vectors.select("doc_id", "embedding")
    if repeats:
        rows = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    return ScoreList(rows, score, len(queries), max(1, min(CHUNK, CELLS // max(1, len(queries)))))


def lexical_list(values: DataFrame, queries: list[dict[str, int]], digits: int = scoring.DIGITS) -> ScoreList:
    """BM25 from what each query term gives to a document (doc_id, term, value); a query has its terms so often."""
    terms = {t: i for i, t in enumerate(sorted({t for q in queries for t in q}))}
    weight = np.zeros((len(terms), len(queries)))
    for j, q in enumerate(queries):
        for t, n in q.items():
            weight[terms[t], j] = n

    has = (weight > 0).astype(np.float32)

    def score(t: pa.Table) -> Scored:
        ids = t.column("doc_id").to_numpy(zero_copy_only=False)
        first = np.concatenate(([True], ids[1:] != ids[:-1]))
        row, value = np.cumsum(first) - 1, t.column("value").to_numpy()
        at = np.fromiter((terms[x] for x in t.column("term").to_pylist()), np.int64, t.num_rows)
        n = int(first.sum())
        s, there = np.empty((n, len(queries))), np.empty((n, len(queries)), bool)
        step = max(1, CELLS // max(1, len(terms)))
        for a in range(0, n, step):  # of the wide matrix only so many cells at once
            x, y = np.searchsorted(row, [a, a + step])
            v = np.zeros((min(step, n - a), len(terms)))
            np.add.at(v, (row[x:y] - a, at[x:y]), value[x:y])
            s[a : a + step], there[a : a + step] = v @ weight, (v > 0).astype(np.float32) @ has > 0
        return ids[first], np.round(s, digits), there

    rows = values.select("doc_id", "term", "value").repartition("doc_id").sortWithinPartitions("doc_id")
    return ScoreList(rows, score, len(queries), max(1, min(16 * CHUNK, 4 * CELLS // max(1, len(queries)))))


def fused_best(lexical: ScoreList, vector: ScoreList, k: int, rrf_k: int) -> list[list[tuple[str, float | None, float | None, float]]]:
    """For each query the k best (doc_id, lexical score, vector score, fused score) by reciprocal rank fusion, exactly."""
    places, lists = rrf_k + 2 * k, (lexical, vector)
    tops = [x.best(places) for x in lists]
    ranks = [[{i: r for r, (i, _) in enumerate(q, 1)} for q in top] for top in tops]
    scores = [[dict(q) for q in top] for top in tops]
    for mine, other in ((0, 1), (1, 0)):
        # a list that ends before its last place is whole
        missing = [[i for i in ranks[other][q] if i not in ranks[mine][q]] if len(ranks[mine][q]) == places else [] for q in range(lexical.n)]
        found = lists[mine].of(missing)
        for q, n in enumerate(lists[mine].before(found)):
            scores[mine][q] |= found[q]
            ranks[mine][q] |= {i: x + 1 for i, x in n.items()}
    out = []
    for q in range(lexical.n):
        part = lambda side, i: 1.0 / (rrf_k + ranks[side][q][i]) if i in ranks[side][q] else 0.0  # noqa: B023,E731
        rows = [(i, scores[0][q].get(i), scores[1][q].get(i), part(0, i) + part(1, i)) for i in ranks[0][q] | ranks[1][q]]
        out.append(sorted(rows, key=lambda r: (-r[3], r[0]))[:k])
    return out
