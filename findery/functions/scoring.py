"""Column expressions of scores: BM25, cosine, reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual BM25 and fusion parameters.
K1, B, RRF_K = 1.2, 0.75, 60
LEAST = 1e-6
DIGITS = 9


def rounded(score: Column, digits: int = DIGITS) -> Column:
    """Rounded as the SQL does it: the double product with 10 ** digits, halves away from zero. F.round takes the shortest decimal of the score instead, which falls on the other side of some halves."""
    scale = F.lit(10.0**digits)
    return F.round(score * scale) / scale


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25_term(tf: Column, dl: Column, avgdl: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    norm = k1 * (F.lit(1.0 - b) + F.lit(b) * dl / F.greatest(avgdl, F.lit(LEAST)))
    return weight * tf * (k1 + 1.0) / (tf + norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero for zero vectors; unlike dimensions are an error."""
    same = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors of unlike dimensions")).cast("double"))
    return same / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(LEAST))


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    """Of ranks from 1; 0 where there is none."""
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank), F.lit(0.0))
