import os

import duckdb
import pytest
from findery import catalog
from findery.functions import text
from findery.operators import fusion
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert len(db.execute(f"describe {catalog.ORACLE_SQL[name]}").fetchall()) == len(columns)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(columns).collect())


def test_tokens_and_paths(spark):
    row = spark.range(1).select(text.tokenize(F.lit("É_ñ-1 ß٣ Ⅷ x")).alias("t"), text.concept_path(F.lit("b"), F.lit("b2/a.md")).alias("p"), text.concept_path(F.lit("b/"), F.lit("b//c.md.md")).alias("q"), text.snippet(F.lit("x" * 50 + "Find Me" + "y" * 100), F.lit("find me")).alias("s"), text.snippet(F.lit("z" * 200), F.lit("")).alias("e")).head()
    assert row.t == ["é", "ñ", "1", "ß٣", "ⅷ", "x"] and row.p == "b2/a" and row.q == "c"
    assert row.s == "x" * 40 + "Find Me" + "y" * 80 and row.e == "z" * 80


def test_distributed_ranks_equal_local_ones(spark, monkeypatch, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(fusion, "ONE_TASK_ROWS", 100)
    s = spark.range(1000).select((F.col("id") % 3).alias("query_id"), F.col("id").cast("string").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 10).alias("score"))
    of = lambda df: {(r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect()}
    assert of(fusion.ranked(s, 1000)) == of(fusion.ranked(s)) == of(fusion.ranked(s, 100))


def test_tokens_are_lower_cased_after_the_cut(spark):
    texts = ["", None, " ", "ΑΣ'Β ΟΔΟΣ", "İstanbul x", "a\tb\u00a0c", "--", "ǅ ﬀ ẞ", "e\u0301 É"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    each = F.transform(F.filter(F.split(F.coalesce("t", F.lit("")), text.NOT_WORD), lambda t: t != ""), F.lower)
    assert all(r.a == r.b for r in rows.select(text.tokenize("t").alias("a"), each.alias("b")).collect())


def test_snippets_near_wide_characters(spark):
    body = "😀é" * 30 + "Straße ZIEL" + "ü😀" * 50
    at = body.index("ZIEL")
    row = spark.createDataFrame([(body,)], "b string").select(text.snippet("b", F.lit("ziel")).alias("s"), text.snippet("b", F.lit("fehlt")).alias("e")).head()
    assert row.s == body[at - 40 : at + 4 + 80] and row.e == body[:160]


def test_queries_leave_no_index_behind(spark, tmp_path):
    """Each query's index is its own scratch: the rows outlive it, its files don't stay in the shared folder."""
    import os

    spark.createDataFrame([(i, f"the text {i}", "en", "src1", 10) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = {n for n in os.listdir(shared) if n.startswith("index-")} if os.path.exists(shared) else set()
    assert catalog.QUERIES["compact_live_docs"](spark, str(tmp_path)).count() == 19
    assert catalog.QUERIES["index_search_lexical"](spark, str(tmp_path)).count() == 10
    assert {n for n in os.listdir(shared) if n.startswith("index-")} == before


def same_as_sql(spark, folder, name):
    """The query's rows over the folder's documents, and those of its SQL."""
    db = duckdb.connect()
    db.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, folder)
    want = db.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    return sorted(map(str, (tuple(r) for r in got.collect()))), sorted(map(str, want))


@pytest.mark.parametrize("name", ["hybrid_trace", "rrf_fuse", "hybrid_search_topk", "vector_search_topk"])
def test_texts_without_a_byte_are_not_in_the_vector_list(spark, tmp_path, name):
    rows = [(i, t, "en", "src1", 10) for i, t in enumerate(["", None, "the", "...", "restion the", " ", None, "the dead", "", "ouaié"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = same_as_sql(spark, str(tmp_path), name)
    assert len(got) == 5 and got == want


def test_scores_near_halves_are_ranked_as_by_sql(spark, monkeypatch, tmp_path):
    """What a half is rounded to decides its place among the scores next to it."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(fusion, "ONE_TASK_ROWS", 500)
    digits = [10**8 + 7919 * i * 1009 % (8 * 10**9) for i in range(700)]
    scores = [x for n in digits for x in ((n + 1) / 1e9, (n + 0.5) / 1e9, n / 1e9)]
    rows = [(0, i, s) for i, s in enumerate(scores)]
    listed = spark.createDataFrame(rows, "query_id long, doc_id long, score double")
    listed.write.parquet(f"{tmp_path}/scores")
    want = duckdb.sql(f"select doc_id, round(score, 9), row_number() over (order by round(score, 9) desc, doc_id) from read_parquet('{tmp_path}/scores/*.parquet')").fetchall()
    for rank in (fusion.ranked(listed), fusion.ranked(listed, 500)):
        assert sorted(map(tuple, rank.select("doc_id", "score", "rank").collect())) == sorted(want)


def test_reopened_trace_is_whole(spark, tmp_path):
    rows = [(i, "the " * (i % 7) + f"text {i}", "en", "src1", 10) for i in range(3 * catalog.K)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = same_as_sql(spark, str(tmp_path), "reopen_index")
    assert len(got) == 3 * catalog.K and got == want
