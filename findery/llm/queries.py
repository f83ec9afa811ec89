"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from findery.llm import byte_bpe, embedding_dedup, jaccard_join, packing, quality_lm, secret_scan, substring_dedup, topk_search, url_filter
from findery.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE))


def op2_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_words", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), "kept")


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_jaccard_join(table(spark, sf_dir, "documents")).drop("key", "class_key")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "kind", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_topk(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op9_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.token_matrix(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = substring_dedup.remove_repeated_spans(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_removed", "text", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_url_models, op3_byte_bpe, op4_kneser_ney, op5_chosen_path, op6_nn_descent, op7_secret_forest, op8_exact_topk, op9_token_matrix, op10_sentence_spans)}
ORACLE_SQL: dict[str, str] = {
    "op8_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
}
