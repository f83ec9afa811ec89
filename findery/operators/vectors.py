"""Embedding providers and brute-force cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.functions import scoring

QUERY_BATCH = 512
TEXTS = 1000


class EmbeddingProvider(Protocol):
    """The extension point: a name, a dimension, and vectors for a batch of texts (called in tasks, once a batch)."""

    name: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class MockProvider:
    """Sums of the text's bytes / 255 by position modulo the dimension: deterministic, for tests and trials."""

    name = "mock"

    def __init__(self, dimension: int = 16):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            out.append((np.bincount(np.arange(len(data)) % self.dimension, data, self.dimension) / 255.0).tolist())
        return out


class OnnxProvider:
    """A local ONNX sentence model with its tokenizer file, loaded once in each worker. Mean of the last layer, unit length."""

    def __init__(self, model: str, tokenizer: str, dimension: int = 384, name: str = "onnx"):
        self.model, self.tokenizer, self.dimension, self.name = model, tokenizer, dimension, name
        self._loaded = None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(self.tokenizer)
            tok.enable_padding()
            tok.enable_truncation(512)
            self._loaded = tok, onnxruntime.InferenceSession(self.model)
        tok, session = self._loaded
        enc = tok.encode_batch(texts)
        ids, mask = np.array([e.ids for e in enc]), np.array([e.attention_mask for e in enc])
        feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        x = session.run(None, {i.name: feeds[i.name] for i in session.get_inputs()})[0]
        x = (x * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).tolist()


def embedded(df: DataFrame, provider: EmbeddingProvider, text: str = "searchable_text", into: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(provider.embed(s.fillna("").tolist()))

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXTS:  # so many whole texts at once in a worker, however large the table is
        conf.set(key, str(TEXTS))
    return df.withColumn(into, embed(F.col(text)))


def mock_embedding(text: Column, dimension: int = 16) -> Column:
    """The mock provider as one expression: whole-number sums of byte values, divided once."""
    digits = F.hex(F.encode(F.coalesce(text, F.lit("")), "utf-8"))
    pairs = F.filter(F.split(F.regexp_replace(digits, "(..)", "$1,"), ","), lambda x: x != "")
    zero = F.array_repeat(F.lit(0).cast("long"), dimension)
    values = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda j: F.aggregate(F.filter(values, lambda _, i: F.pmod(i, F.lit(dimension)) == j), F.lit(0).cast("long"), lambda s, x: s + x))
    return F.transform(F.when(F.size(pairs) > 0, sums).otherwise(zero), lambda x: x / 255.0)


def scores(vectors: DataFrame, queries: list[tuple[int, list[float]]], score: Callable[[Column, Column], Column] = scoring.cosine) -> DataFrame:
    """(query_id, doc_id, score) of every vector (doc_id, embedding) for each query; rows of one document add up.

    Queries are literals beside each row, QUERY_BATCH at a time; nothing is shuffled but sums by document.
    """
    parts = []
    for a in range(0, max(1, len(queries)), QUERY_BATCH):
        asked = F.array(*(F.struct(F.lit(i).cast("long").alias("query_id"), F.array(*(F.lit(float(x)) for x in v)).alias("q")) for i, v in queries[a : a + QUERY_BATCH]))
        each = vectors.select("doc_id", "embedding", F.explode(asked).alias("a"))
        parts.append(each.select("a.query_id", "doc_id", score(F.col("a.q"), F.col("embedding")).alias("score")))
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
