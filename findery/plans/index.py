"""The search index: add, update, delete, compact and search, each as DataFrame work and one manifest commit."""

from __future__ import annotations

import json
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions.text import snippet
from findery.operators import batch, bm25, fusion, vectors
from findery.plans.model import DOCUMENT, SearchError, SearchMode
from findery.plans.store import Manifest, Segment, Store, now
from findery.sources.bundle import load_bundle
from findery.sources.tables import release

SMALL_BYTES = 1 << 25
MANY_DOCUMENTS = 20_000
PART_BITS = 55  # ord: the part above, Spark's row number below
RESULT = ["doc_id", "concept_path", "title", "type_name", "tags", "snippet", "bm25_score", "vector_score", "fused_score"]


@dataclass
class Trace:
    """What a search went through: the query and its whole ranked lists, lazily."""

    query: str
    lexical: DataFrame | None
    vector: DataFrame | None
    fused: DataFrame

    def parts(self) -> Iterator[str]:
        """Its JSON in pieces; a list passes through the driver a partition at a time."""
        yield f'{{"query": {json.dumps(self.query, ensure_ascii=False)}'
        for name, df, score in (("lexical_candidates", self.lexical, "score"), ("vector_candidates", self.vector, "score"), ("fused", self.fused, "fused_score")):
            yield f', "{name}": ['
            if df is not None:
                for i, r in enumerate(df.orderBy(F.desc(score), "doc_id").select("doc_id", score).toLocalIterator()):
                    yield (", " if i else "") + json.dumps([r[0], r[1]])
            yield "]"
        yield "}"


class SearchIndex:
    def __init__(self, spark: SparkSession, root: str, provider: vectors.EmbeddingProvider | None = None, compat: bool = False, recover: bool = False):
        """Opens or creates an index. compat=True keeps tombstones as a ban on an id until compaction.

        recover=True, for the one writer, removes what an earlier writer left unfinished; a reader removes nothing.
        """
        self.spark, self.provider, self.compat = spark, provider or vectors.MockProvider(), compat
        self.store = Store(spark, root)
        self.manifest = self.store.load()
        self.recovered = self.store.recover(self.manifest) if recover else []

    def _commit(self, manifest: Manifest) -> None:
        self.store.commit(manifest)
        self.manifest = manifest

    def _segment(self, parts: list[DataFrame], generation: int, kind: str = "seg") -> Segment | None:
        """Writes documents with vectors, part by part, and their postings. What a part had shuffled is let go before the next. Each task sorts those of its documents by term, so that a scan reads the pages of its terms; no posting is shuffled."""
        at = now()
        name = f"{kind}_{at:016x}"
        for i, docs in enumerate(parts):
            if i:
                release(docs)
            rows = docs.select(*DOCUMENT.names, *(c for c in ("embedding",) if c in docs.columns))
            if "embedding" not in docs.columns:
                rows = vectors.embedded(rows, self.provider)
            rows = rows.withColumn("segment_id", F.lit(name)).withColumn("ord", F.monotonically_increasing_id() + F.lit(i << PART_BITS))
            staging = self.store.write_documents(rows, name)
        with self.store.small_tasks():
            written = self.store.read_documents(f"{staging}/documents")
            count, distinct = written.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).head()
            if not count:
                self.store.remove(staging)
                return None
            if count > MANY_DOCUMENTS:  # texts that were shuffled on the way are stored now
                release(docs)
            self.store.write_postings(bm25.postings(written).sortWithinPartitions("term", "doc_id"), name)
        total = self.spark.read.parquet(f"{staging}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0))).head()[0]
        return Segment(name, self.store.place(staging), count, total, at, generation, count == distinct)

    def _described(self, manifest: Manifest) -> Manifest:
        if manifest.segments and manifest.embedding_dimension not in (0, self.provider.dimension):
            raise SearchError(f"the index holds {manifest.embedding_dimension} dimensions, the provider gives {self.provider.dimension}")
        manifest.embedding_model, manifest.embedding_dimension = self.provider.name, self.provider.dimension
        return manifest

    def _admitted(self, docs: DataFrame) -> DataFrame:
        if self.compat and self.manifest.tombstones:
            return docs.join(self.spark.read.parquet(*self.manifest.tombstones).select("doc_id").distinct(), "doc_id", "left_anti")
        return docs

    def add(self, docs: DataFrame, *more: DataFrame) -> Segment | None:
        """Appends documents as a new segment, without looking for earlier copies. No rows, no segment. A large table can be given in parts."""
        m = self._described(deepcopy(self.manifest))
        if segment := self._segment([self._admitted(d) for d in (docs, *more)], m.generation + 1):
            if m.segments:
                new = self.spark.read.parquet(f"{segment.path}/documents").select("doc_id")
                m.disjoint = m.disjoint and self.live("doc_id").join(new, "doc_id", "left_semi").isEmpty()
            m.generation += 1
            m.segments.append(segment)
            self._commit(m)
        return segment

    def _tombstones(self, ids: DataFrame, m: Manifest) -> None:
        """Tombstones of the present generation for the ids, as a file of their own."""
        name = f"del_{now():016x}"
        staging = f"{self.store.root}/tombstones/{name}.staging"
        ids.select("doc_id").distinct().withColumn("generation", F.lit(m.generation).cast("long")).write.parquet(staging)
        m.tombstones.append(self.store.place(staging))

    def delete_doc_ids(self, ids: list[str] | DataFrame) -> None:
        """Hides documents; unknown ids and empty lists count as a change too."""
        m = deepcopy(self.manifest)
        self._tombstones(ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "doc_id string"), m)
        m.generation += 1
        self._commit(m)

    def _ids_of_keys(self, keys: DataFrame) -> DataFrame:
        rows = self.store.documents(self.manifest)
        return keys.select(F.lit("").alias("doc_id")).limit(0) if rows is None else rows.join(keys.select("logical_key").distinct(), "logical_key", "left_semi").select("doc_id")

    def delete_logical_keys(self, keys: list[str]) -> None:
        self.delete_doc_ids(self._ids_of_keys(self.spark.createDataFrame([(k,) for k in keys], "logical_key string")))

    def update(self, docs: DataFrame) -> Segment | None:
        """Replaces the documents of the same logical keys, in one commit."""
        m = self._described(deepcopy(self.manifest))
        self._tombstones(self._ids_of_keys(docs), m)
        ban = self.spark.read.parquet(m.tombstones[-1]).select("doc_id") if self.compat else None
        docs = self._admitted(docs)
        segment = self._segment([docs.join(ban, "doc_id", "left_anti") if self.compat else docs], m.generation + 1)
        m.generation += 1
        if segment:
            m.segments.append(segment)
        self._commit(m)
        return segment

    def add_bundle(self, path: str, on_error: str = "fail") -> Segment | None:
        return self.update(load_bundle(self.spark, path, on_error))

    def live(self, *columns: str | Column, only: DataFrame | None = None) -> DataFrame | None:
        """Live rows, or those of the ids in `only`; of these columns alone, if any are named, which are taken before the dead are left out. A short list of those spares the rows a shuffle."""
        rows = self.store.documents(self.manifest)
        dead = self.store.dead(self.manifest, self.compat)
        if rows is None:
            return None
        if only is not None:
            rows = rows.join(only, "doc_id", "left_semi")
        keys = ["segment_id", "doc_id"]
        named = [*columns] and [F.col(c) if isinstance(c, str) else c for c in columns]
        if dead is None:
            return rows.select(*named) if named else rows
        few = self.store.few_dead(self.manifest)
        if not named:
            return rows.join(F.broadcast(dead) if few else dead, keys, "left_anti")
        own = [F.col(k).alias(f"__{k}") for k in keys]
        dead = dead.select(*(F.col(k).alias(f"__{k}") for k in keys))
        return fusion.without(rows.select(*own, *named), dead, ["__segment_id", "__doc_id"], few).drop("__segment_id", "__doc_id")

    def compact(self) -> Segment:
        """All live rows in one segment with statistics of its own; tombstones go."""
        rows = self.live()
        m = deepcopy(self.manifest)
        if rows is not None and m.repeats:
            rows = rows.orderBy("segment_ord", "ord")  # which of the rows of a document is the last
        segment = self._segment([rows], m.generation + 1, "compact") if rows is not None else None
        if segment is None:
            raise SearchError("nothing to compact")
        m.generation += 1
        m.segments, m.tombstones, m.disjoint = [segment], [], True
        self._commit(m)
        return segment

    def vacuum(self) -> list[str]:
        """Removes folders that the manifest no longer lists."""
        return self.store.recover(self.manifest)

    def _lists(self, queries: list[tuple[int, str]], mode: SearchMode) -> tuple[DataFrame | None, DataFrame | None]:
        n, dead = sum(s.doc_count for s in self.manifest.segments) * max(1, len(queries)), self.store.dead(self.manifest, self.compat)
        lexical = vector = None
        asked = self.spark.createDataFrame(queries, "query_id long, query string")
        if mode != SearchMode.VECTOR:
            p = self.manifest.bm25
            few = sum(len(q.split()) for _, q in queries) <= bm25.SMALL_QUERIES
            lexical = fusion.ranked(bm25.scores(self.store.postings(self.manifest), self.store.stats(self.manifest), asked, dead, p["k1"], p["b"], few), n)
        if mode != SearchMode.LEXICAL:
            embedded = [(i, v) for (i, _), v in zip(queries, self.provider.embed([q for _, q in queries]))]
            vector = fusion.ranked(vectors.scores(self.live("doc_id", "embedding"), embedded), n)
        return lexical, vector

    @staticmethod
    def _fused(lexical: DataFrame | None, vector: DataFrame | None, rrf_k: int) -> DataFrame:
        if lexical is not None and vector is not None:
            return fusion.rrf(lexical, vector, rrf_k)
        none = F.lit(None).cast("double")
        if lexical is not None:
            return lexical.select("query_id", "doc_id", F.col("score").alias("bm25_score"), none.alias("vector_score"), F.col("score").alias("fused_score"))
        return vector.select("query_id", "doc_id", none.alias("bm25_score"), F.col("score").alias("vector_score"), F.col("score").alias("fused_score"))

    def _best(self, queries: list[str], mode: SearchMode, k: int) -> list[list[tuple]]:
        """For each query its k best (doc_id, bm25_score, vector_score, fused_score)."""
        lexical = vector = None
        if mode != SearchMode.VECTOR:
            asked = self.spark.createDataFrame([*enumerate(queries)], "query_id long, query string")
            terms: list[dict[str, int]] = [{} for _ in queries]
            for r in bm25.query_terms(asked).collect():
                terms[r["query_id"]][r["term"]] = r["qtf"]
            every = self.spark.createDataFrame([(t,) for t in {t for q in terms for t in q}], "term string")
            p, n = self.manifest.bm25, sum(map(len, terms))
            values = bm25.term_values(self.store.postings(self.manifest), self.store.stats(self.manifest), every, self.store.dead(self.manifest, self.compat), p["k1"], p["b"], n <= bm25.SMALL_QUERIES)
            lexical = batch.lexical_list(values, terms)
        if mode != SearchMode.LEXICAL:
            vector = batch.vector_list(self.live("doc_id", "embedding"), self.provider.embed(queries), self.manifest.repeats)
        if lexical and vector:
            lexical.rows = lexical.rows.persist()
            try:
                return batch.fused_best(lexical, vector, k, self.manifest.rrf_k)
            finally:
                lexical.rows.unpersist()
        return [[(i, s if lexical else None, None if lexical else s, s) for i, s in q] for q in (lexical or vector).best(k)]

    def search_many(self, queries: list[tuple[int, str]], mode: SearchMode | str = SearchMode.HYBRID, top_k: int = 10) -> DataFrame:
        """Result rows of many queries (query_id, query): query_id, position and the result columns. Finds the best at once, and gives their documents lazily."""
        best = []
        for a in range(0, len(queries) if self.manifest.segments else 0, batch.QUERY_BATCH):
            part = queries[a : a + batch.QUERY_BATCH]
            for (i, q), rows in zip(part, self._best([q for _, q in part], SearchMode(mode), top_k)):
                best += [(i, q, n, *r) for n, r in enumerate(rows, 1)]
        if not best:
            empty = "query_id long, position int, " + ", ".join(f"{c} {'array<string>' if c == 'tags' else 'double' if c.endswith('score') else 'string'}" for c in RESULT)
            return self.spark.createDataFrame([], empty)
        rows = self.spark.createDataFrame(best, "query_id long, query string, position int, doc_id string, bm25_score double, vector_score double, fused_score double")
        few = sum(len(r[1]) + len(r[3]) + 64 for r in best) <= SMALL_BYTES
        wanted = rows.select("doc_id").distinct()
        docs = fusion.last_wins(self.live(only=F.broadcast(wanted) if few else wanted))
        rows = docs.join(F.broadcast(rows) if few else rows, "doc_id")
        return rows.withColumn("snippet", snippet("body", F.col("query"))).select("query_id", "position", *RESULT).orderBy("query_id", "position")

    def search(self, query: str, mode: SearchMode | str = SearchMode.HYBRID, top_k: int = 10) -> DataFrame:
        return self.search_many([(0, query)], mode, top_k).orderBy("position").select(*RESULT)

    def trace(self, query: str, mode: SearchMode | str = SearchMode.HYBRID) -> Trace:
        if not self.manifest.segments:
            return Trace(query, None, None, self.spark.createDataFrame([], "query_id long, doc_id string, fused_score double"))
        lexical, vector = self._lists([(0, query)], SearchMode(mode))
        return Trace(query, lexical, vector, self._fused(lexical, vector, self.manifest.rrf_k))

    def register_views(self, prefix: str = "") -> None:
        """The index's tables for spark.sql: documents (live) and postings."""
        if self.manifest.segments:
            self.live().createOrReplaceTempView(f"{prefix}documents")
            self.store.postings(self.manifest).createOrReplaceTempView(f"{prefix}postings")
