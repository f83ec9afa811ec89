import json
import os
import threading
import urllib.request

import pytest
from findery import cli
from findery.config import Config
from findery.http import handle, server
from findery.operators.vectors import MockProvider, mock_embedding
from findery.plans.index import SearchIndex
from findery.plans.model import DocumentInput, SearchError
from findery.sources.bundle import load_bundle, split_frontmatter
from findery.sources.documents import from_inputs
from pyspark.sql import functions as F

ORDERS = DocumentInput("b", "b/a.md", {"type": "Metric", "title": "Orders"}, "Orders completed by customers")
REVENUE = DocumentInput("b", "b/b.md", {"type": "Metric", "title": "Revenue"}, "Revenue from orders and invoices")
CUSTOMERS = DocumentInput("b", "b/c.md", {"type": "Metric", "title": "Customers"}, "Customers who ordered and paid")


@pytest.fixture
def index(spark, tmp_path):
    return SearchIndex(spark, str(tmp_path / "index"))


def titles(df):
    return [r.title for r in df.collect()]


def test_golden_scores(index, spark):
    index.add(from_inputs(spark, [ORDERS, REVENUE, CUSTOMERS]))
    rows = index.search("orders", "hybrid", 3).collect()
    assert [r.title for r in rows] == ["Orders", "Revenue", "Customers"]
    assert [r.bm25_score for r in rows] == [pytest.approx(0.668370180, abs=1e-8), pytest.approx(0.458959158, abs=1e-8), None]
    assert [round(r.vector_score, 6) for r in rows] == [0.750817, 0.746217, 0.721945]
    assert [round(r.fused_score, 9) for r in rows] == [0.032786885, 0.032258065, 0.015873016]
    trace = json.loads("".join(index.trace("orders").parts()))
    assert len(trace["lexical_candidates"]) == 2 and len(trace["vector_candidates"]) == 3 and trace["query"] == "orders"
    assert titles(index.search("orders", "lexical", 5)) == ["Orders", "Revenue"]
    assert len(titles(index.search("orders", "vector", 2))) == 2
    assert titles(index.search("orders", "hybrid", 0)) == [] and titles(index.search("...", "lexical")) == []
    many = index.search_many([(1, "orders"), (2, "paid paid")], "lexical", 5).collect()
    assert [(r.query_id, r.title) for r in many] == [(1, "Orders"), (1, "Revenue"), (2, "Customers")]
    assert many[2].bm25_score == pytest.approx(2 * index.search("paid", "lexical").head().bm25_score)


def test_reopen_delete_compact(index, spark):
    index.add(from_inputs(spark, [ORDERS, REVENUE]))
    again = SearchIndex(spark, index.store.root)
    assert titles(again.search("orders", "lexical")) == ["Orders", "Revenue"]
    dead = again.search("revenue", "lexical", 1).head().doc_id
    again.delete_doc_ids([dead])
    assert titles(again.search("orders", "hybrid")) == ["Orders"]
    assert again.search("orders", "lexical").head().bm25_score == pytest.approx(0.257270068, abs=1e-8)  # the dead still count
    again.compact()
    assert again.search("orders", "lexical").head().bm25_score == pytest.approx(0.395562850, abs=1e-7)
    assert again.manifest.tombstones == [] and len(again.vacuum()) == 2
    again.delete_logical_keys(["b::a"])
    assert titles(again.search("orders", "vector")) == []
    with pytest.raises(SearchError):
        again.compact()
    again.add(from_inputs(spark, [ORDERS]))
    assert titles(again.search("orders", "hybrid")) == ["Orders"]


def test_update_and_compat(index, spark, tmp_path):
    index.add(from_inputs(spark, [ORDERS]))
    index.update(from_inputs(spark, [ORDERS]))
    assert titles(index.search("orders")) == ["Orders"]
    index.update(from_inputs(spark, [DocumentInput("b", "b/a.md", {"title": "New"}, "orders again")]))
    assert titles(index.search("orders")) == ["New"]
    index.add(from_inputs(spark, [DocumentInput("b", "b/a.md", {"title": "New"}, "orders again")]))
    assert index.search("orders", "vector").head().vector_score > 1  # copies add up
    old = SearchIndex(spark, str(tmp_path / "old"), compat=True)
    old.add(from_inputs(spark, [ORDERS]))
    old.update(from_inputs(spark, [ORDERS]))
    assert titles(old.search("orders")) == []
    assert index.add(from_inputs(spark, [ORDERS]).limit(0)) is None


def test_recovery(index, spark):
    index.add(from_inputs(spark, [ORDERS]))
    os.makedirs(f"{index.store.root}/segments/seg_dead.staging")
    os.makedirs(f"{index.store.root}/segments/seg_unlisted")
    assert SearchIndex(spark, index.store.root).recovered == [] and len(os.listdir(f"{index.store.root}/segments")) == 3  # a reader removes nothing
    again = SearchIndex(spark, index.store.root, recover=True)
    assert len(again.recovered) == 2 and len(os.listdir(f"{index.store.root}/segments")) == 1
    assert titles(again.search("orders")) == ["Orders"]


def test_frontmatter():
    f, body = split_frontmatter("---\ntype: Metric\ntitle: Orders\ntags:\n  - sales\n---\nhello world\n")
    assert f == {"type": "Metric", "title": "Orders", "tags": ["sales"]} and body == "hello world"
    assert split_frontmatter("---\r\ntitle: x\n---\n")[0] == {} and split_frontmatter("plain\n") == ({}, "plain\n")
    assert split_frontmatter("---\ntitle: x") == ({"title": "x"}, "")
    f, _ = split_frontmatter("---\na: 2024-01-01\nb: yes\nc: 12:30\nd: 123\ne: true\nf: ~\ng: 1.5\nh: {x: 1}\n3: q\n---\n")
    assert f == {"a": "2024-01-01", "b": "yes", "c": "12:30", "d": 123, "e": True, "f": None, "g": 1.5, "h": None}
    with pytest.raises(Exception):
        split_frontmatter("---\na: 1\na: 2\n---\n")
    assert split_frontmatter("---\ntitle: x\r\n---\r\none\r\ntwo\r\n") == ({"title": "x"}, "one\ntwo")  # CRLF lines
    import yaml

    for bad in ("a: [", "a: b: c", "\ta: 1", "a: 'x"):
        with pytest.raises(yaml.YAMLError):
            split_frontmatter(f"---\n{bad}\n---\n")


def test_bundle(spark, tmp_path):
    b = tmp_path / "bundle"
    (b / "_x" / ".y").mkdir(parents=True)
    (b / "a.md").write_text("---\ntype: Metric\ntitle: Orders\ntags: [sales, 3]\n---\nhello world\n")
    (b / "c.md.md").write_text("plain\n")
    (b / "_x" / ".y" / "h.md").write_text("---\ntitle: 123\ntags: a\n---\nbody")
    (b / "n.MD").write_text("no")
    (b / "l.md").symlink_to(b / "a.md")
    rows = {r.concept_path: r for r in load_bundle(spark, str(b)).collect()}
    assert set(rows) == {"a", "c", "_x/.y/h"}
    assert rows["a"].searchable_text == "Orders\nsales\nhello world" and rows["a"].tags == ["sales"]
    assert rows["_x/.y/h"].title is None and rows["_x/.y/h"].tags == [] and rows["c"].type_name == "Unknown"
    (b / "bad.md").write_text("---\na: [\n---\n")
    with pytest.raises(Exception):
        load_bundle(spark, str(b)).collect()
    assert load_bundle(spark, str(b), "skip").count() == 3
    index = SearchIndex(spark, str(tmp_path / "i"))
    index.add_bundle(str(b), "skip")
    index.add_bundle(str(b), "skip")
    assert index.live().count() == 3


def test_mock_embedding_forms_agree(spark):
    texts = ["", "orders", "É_ñ-1 ß٣ Ⅷ", "x" * 1000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mock_embedding(F.col("t")).alias("e")).orderBy("i").collect()
    for r, e in zip(rows, MockProvider(16).embed(texts)):
        assert r.e == pytest.approx(e)


def test_http(index, spark):
    lock = threading.Lock()
    doc = {"bundle_path": "b", "file_path": "b/a.md", "frontmatter": {"title": "Orders"}, "body": "orders"}
    assert handle(index, lock, "POST", "/documents", json.dumps(doc).encode())[0] == 200
    status, out = handle(index, lock, "POST", "/search", b'{"query":"orders","mode":"hybrid","top_k":5}')
    assert status == 200 and out["results"][0]["title"] == "Orders" and out["plan"].query == "orders"
    assert handle(index, lock, "POST", "/search", b'{"query":"x","mode":"odd"}')[0] == 422
    assert handle(index, lock, "POST", "/documents/delete", b'{"logical_keys":["b::a"]}')[0] == 200
    assert handle(index, lock, "POST", "/search", b'{"query":"orders"}')[1]["results"] == []
    s = server(index, "127.0.0.1:0")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    for path in ("health", "openapi.json"):
        assert urllib.request.urlopen(f"http://127.0.0.1:{s.server_address[1]}/{path}").status == 200
    request = urllib.request.Request(f"http://127.0.0.1:{s.server_address[1]}/search", b'{"query":"orders"}')
    assert json.loads(urllib.request.urlopen(request).read())["plan"] == {"query": "orders", "lexical_candidates": [], "vector_candidates": [], "fused": []}
    s.shutdown()


def test_cli(spark, tmp_path, capsys):
    c = str(tmp_path / "c.toml")
    assert cli.main(["--config", c, "init-config"]) == 0 and Config.load(c) == Config()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.md").write_text("---\ntitle: Orders\n---\norders here")
    base = ["--config", c, "--index", str(tmp_path / "i"), "--mock-embeddings"]
    cli.main([*base, "add", str(tmp_path / "b")], spark)
    cli.main([*base, "search", "orders", "--mode", "odd", "--top-k", "3"], spark)
    assert json.loads(capsys.readouterr().out)[0]["title"] == "Orders"
    cli.main([*base, "compact"], spark)


def test_streaming(spark, tmp_path):
    from findery.plans.model import RAW
    from findery.streaming.ingest import stream_into

    rows = spark.createDataFrame([("b", "b/a.md", None, "Orders", None, None, None, ["x"], "orders here")], RAW)
    rows.write.parquet(str(tmp_path / "in"))
    index = SearchIndex(spark, str(tmp_path / "i"))
    stream_into(spark.readStream.schema(RAW).parquet(str(tmp_path / "in")), index, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert titles(index.search("orders")) == ["Orders"]


def test_batches_equal_whole_rankings(spark, tmp_path):
    """Many documents, ties, repeats and dead ones: the best by pruned places are those of the whole lists."""
    import random

    from findery.operators import fusion

    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [DocumentInput("b", f"b/{i}.md", {}, " ".join(r.choice(words[: r.randint(1, 40)]) for _ in range(r.randint(0, 12)))) for i in range(400)]
    index = SearchIndex(spark, str(tmp_path / "i"), MockProvider(4))
    index.add(from_inputs(spark, docs))
    queries = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 4)))) for i in range(6)] + [(6, "none"), (7, "")]

    def equal():
        for mode in ("lexical", "vector", "hybrid"):
            got = {(x.query_id, x.position): (x.doc_id, x.bm25_score, x.vector_score, round(x.fused_score, 12)) for x in index.search_many(queries, mode, 5).collect()}
            want = {}
            for i, q in queries:
                for x in fusion.top(index.trace(q, mode).fused, 5).collect():
                    want[i, x.position] = (x.doc_id, x.bm25_score, x.vector_score, round(x.fused_score, 12))
            assert got == want, mode

    assert not index.manifest.repeats
    equal()
    index.add(from_inputs(spark, docs[:50]))
    index.delete_logical_keys([f"b::{i}" for i in range(100, 120)])
    assert index.manifest.repeats
    equal()
    index.add(from_inputs(spark, docs[100:110]))  # back from the dead; 50 documents are in two segments
    index.compact()
    assert index.manifest.repeats and SearchIndex(spark, index.store.root).manifest == index.manifest
    assert len({x.doc_id for x in index.search_many(queries, "vector", 400).filter("query_id = 0").collect()}) == 390


def test_chunks_keep_rows_of_a_document_together():
    import pyarrow as pa
    from findery.operators.batch import chunks

    ids = [f"d{i:03}" for i in range(50) for _ in range(1 + i % 4)]
    for size in (1, 3, 7, 1000):
        for step in (1, 5, 200):
            batches = [pa.record_batch([pa.array(ids[a : a + step])], names=["doc_id"]) for a in range(0, len(ids), step)]
            got = [t.column("doc_id").to_pylist() for t in chunks(iter(batches), size)]
            assert sum(got, []) == ids and all(a[-1] != b[0] for a, b in zip(got, got[1:]))


def test_model_provider_with_a_stand_in_session():
    import pickle

    import numpy as np
    from findery.operators.vectors import OnnxProvider

    class Encoding:
        def __init__(self, ids, mask):
            self.ids, self.attention_mask = ids, mask

    class Tokens:
        def encode_batch(self, texts):
            most = max(len(t.split()) for t in texts)
            return [Encoding([len(w) for w in t.split()] + [0] * (most - len(t.split())), [1] * len(t.split()) + [0] * (most - len(t.split()))) for t in texts]

    class Input:
        def __init__(self, name):
            self.name = name

    class Session:
        def get_inputs(self):
            return [Input("input_ids"), Input("attention_mask")]

        def run(self, _, feeds):
            assert set(feeds) == {"input_ids", "attention_mask"}
            return [np.stack([feeds["input_ids"], np.full(feeds["input_ids"].shape, 9)], 2).astype(float)]  # padding would count if it weren't masked

    p = OnnxProvider("no.onnx", "no.json", 2)
    p._loaded = Tokens(), Session()
    got = p.embed(["aaa a", "bb bb bb bb"])
    for row, mean in zip(got, ([2, 9], [2, 9])):
        assert row == pytest.approx((np.array(mean) / np.linalg.norm(mean)).tolist())
    assert pickle.loads(pickle.dumps(p))._loaded is None  # each worker loads its own


def test_documents_are_stored_once_and_postings_by_task(index, spark):
    """Derived searchable text isn't stored, given text is; each postings file is sorted; repeated rows still add up."""
    docs = from_inputs(spark, [ORDERS, REVENUE, CUSTOMERS, ORDERS]).repartition(2, "file_path")
    own = docs.withColumn("searchable_text", F.when(F.col("title") == "Revenue", F.lit("only this")).otherwise(F.col("searchable_text")))
    segment = index.add(own)
    stored = spark.read.parquet(f"{segment.path}/documents").select("title", "searchable_text").collect()
    assert {r.title: r.searchable_text for r in stored} == {"Orders": None, "Revenue": "only this", "Customers": None}
    assert {r.title: r.searchable_text for r in index.live().collect()}["Orders"] == "Orders\nOrders completed by customers"
    assert titles(index.search("only", "lexical")) == ["Revenue"] and titles(index.search("invoices", "lexical")) == []
    rows = spark.read.parquet(f"{segment.path}/postings").withColumn("file", F.input_file_name()).collect()
    assert {(r.tf, r.dl) for r in rows if r.term == "orders"} == {(4, 5)} and segment.total_tokens == 5 + 5 + 2 + 6 and not segment.unique
    assert len({(r.term, r.doc_id) for r in rows}) == len(rows)


def test_states_need_no_shuffle_of_texts(index, spark):
    from findery.catalog import post_state

    index.add(from_inputs(spark, [ORDERS, REVENUE]))
    index.delete_logical_keys(["b::a"])
    state = post_state(index)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in plan.split("Exchange hashpartitioning(file_path")[1]  # below the exchange
    assert [(r.file_path, r.copies) for r in state.collect()] == [("b/b.md", 1)]


def test_a_long_list_of_dead_shuffles_no_text(index, spark, monkeypatch):
    from findery.catalog import post_state
    from findery.plans import store

    monkeypatch.setattr(store, "FEW_DEAD", 0)
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        index.add(from_inputs(spark, [ORDERS, REVENUE]))
        index.delete_logical_keys(["b::a"])
        state = post_state(index)
        plan = state._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("sha2("), plan
        assert [(r.file_path, r.copies) for r in state.collect()] == [("b/b.md", 1)]
        assert titles(index.search("revenue", "lexical")) == ["Revenue"]
    finally:
        spark.conf.set(key, before)


def test_sorted_terms_are_stored_as_deltas(index, spark):
    import glob

    import pyarrow.parquet as pq

    segment = index.add(from_inputs(spark, [ORDERS, REVENUE]))
    at = next(f for f in glob.glob(f"{segment.path.removeprefix('file:')}/postings/*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    columns = pq.ParquetFile(at).metadata.row_group(0)
    of = {columns.column(i).path_in_schema: columns.column(i) for i in range(columns.num_columns)}
    assert "DELTA_BYTE_ARRAY" in of["term"].encodings and of["term"].compression == "ZSTD"


def test_shuffled_texts_go_before_postings_are_written(spark, tmp_path, monkeypatch):
    """Shuffle files of the texts, as large as the input, are let go of once the documents are stored."""
    from findery.plans import index as plans

    seen = []

    def release(df):
        (staging,) = (tmp_path / "i/segments").iterdir()
        seen.append(sorted(p.name for p in staging.iterdir()))

    monkeypatch.setattr(plans, "release", release)
    monkeypatch.setattr(plans, "MANY_DOCUMENTS", 1)
    docs = from_inputs(spark, [DocumentInput("b", f"{n}.md", {}, f"text {n}") for n in range(3)])
    SearchIndex(spark, f"{tmp_path}/i").add(docs)
    assert seen == [["documents"]]


def test_a_large_table_is_stored_in_parts(spark, tmp_path, monkeypatch):
    """A table in one row group is shuffled a part at a time, each let go before the next: whole, it stood beside its stored documents."""
    from findery import catalog
    from findery.plans import index as plans
    from findery.sources import tables

    monkeypatch.setattr(tables, "UNEVEN", 0)
    monkeypatch.setattr(tables, "MANY_ROWS", 100)
    rows = [(i if i else None, f"the text {i}", "en", "src1", 10) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    stored = []
    monkeypatch.setattr(plans, "release", lambda df: stored.append(df))
    index, _ = catalog.built(spark, str(tmp_path))
    assert len(stored) == tables.PARTS - 1
    (segment,) = index.manifest.segments
    assert (segment.doc_count, segment.total_tokens, segment.unique) == (400, 400 * 4, True)
    got = spark.read.parquet(f"{segment.path}/documents").select("body", "ord").collect()
    assert {r.body for r in got} == {r[1] for r in rows} and len({r.ord for r in got}) == 400
    assert max(p.count() for p in tables.parts(spark.read.parquet(f"{tmp_path}/documents.parquet"))) < 200
    assert index.search("399", "lexical").head().snippet == "the text 399"
