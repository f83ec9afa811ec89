"""The registered queries, over whole small tables."""

import os

import pytest
from findery.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "op1_pack": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op2_url_models": ["page_id", "host", "path", "rule", "verdict"],
    "op3_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_kneser_ney": ["doc_id", "perplexity", "threshold", "kept"],
    "op5_chosen_path": ["doc_id", "class_id", "n_links"],
    "op6_nn_descent": ["vec_id", "n_links", "component_id", "kept"],
    "op7_secret_forest": ["doc_id", "start", "length", "kind", "is_secret"],
    "op8_exact_topk": ["query_id", "rank", "vec_id", "score"],
    "op9_token_matrix": ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids"],
    "op10_sentence_spans": ["doc_id", "n_removed", "text"],
}
ONE_A_ROW = {"op2_url_models": ("pages", "page_id"), "op3_byte_bpe": ("documents", "doc_id"), "op4_kneser_ney": ("documents", "doc_id"), "op5_chosen_path": ("documents", "doc_id"), "op6_nn_descent": ("embeddings", "vec_id"), "op10_sentence_spans": ("documents", "doc_id")}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_runs_over_its_whole_table(spark, name):
    rows = queries.QUERIES[name](spark, DATA).toPandas()
    assert set(COLUMNS[name]) <= set(rows.columns) and (len(rows) or name == "op7_secret_forest")  # its 200 documents hold no candidate
    if name in ONE_A_ROW:
        table, key = ONE_A_ROW[name]
        assert sorted(rows[key]) == sorted(spark.read.parquet(f"{DATA}/{table}.parquet").select(key).toPandas()[key])
    if name == "op1_pack":
        for _, doc in rows.sort_values("start").groupby("doc_id"):
            assert doc.start.tolist() == [0, *doc.length.cumsum()[:-1]] and doc.length.sum() == doc.doc_tokens.iloc[0]
        for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
            assert sequence.offset.tolist() == [0, *sequence.length.cumsum()[:-1]] and sequence.length.sum() <= 4096


def test_every_query_has_a_test():
    assert set(COLUMNS) == set(queries.QUERIES)
