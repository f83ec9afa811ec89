from findery.operators import batch, bm25, vectors

ROWS = [("0", 1, "b a b"), ("0", 2, ""), ("0", 3, None), ("1", 1, "a"), ("0", 1, "b c"), ("1", 4, "É é x")]


def docs(spark):
    return spark.createDataFrame(ROWS, "segment_id string, doc_id long, searchable_text string")


def test_terms_are_counted_within_rows(spark):
    once = docs(spark).filter("doc_id != 1")
    plan = bm25.postings(once)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {tuple(r) for r in bm25.postings(once).collect()} == {("1", "é", 4, 2, 3), ("1", "x", 4, 1, 3)}


def test_repeated_rows_add_up(spark):
    want = {("0", "b", 1, 3, 3), ("0", "a", 1, 1, 3), ("0", "c", 1, 1, 2), ("1", "a", 1, 1, 1), ("1", "é", 4, 2, 3), ("1", "x", 4, 1, 3)}
    got = bm25.postings(docs(spark)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r) for r in bm25.postings(docs(spark), terms=["b"]).collect()} == {("0", "b", 1, 3, 3)}
    kept = bm25.saved_counts(docs(spark), ["a", "b"])
    assert {tuple(r) for r in bm25.of_counts(kept).collect()} == {r for r in want if r[1] in "ab"}
    assert {tuple(r) for r in bm25.stats_of_counts(kept).collect()} == {tuple(r) for r in bm25.segment_stats(docs(spark)).collect()} == {("0", 4, 1.25), ("1", 2, 2.0)}


def test_lists_of_numbered_documents(spark):
    """Ids that are numbers stay numbers, ties go to the smaller one, and scores are rounded before they are ranked."""
    values = spark.createDataFrame([(10, "a", 1.0000001), (9, "a", 1.0), (8, "b", 0.5)], "doc_id long, term string, value double")
    assert batch.lexical_list(values, [{"a": 1}, {"b": 2}, {}], 6).best(5) == [[(9, 1.0), (10, 1.0)], [(8, 1.0)], []]


def test_texts_go_to_python_in_small_batches(spark):
    class Counting:
        name, dimension = "counting", 1

        def embed(self, texts):
            return [[float(len(texts))] for _ in texts]

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        rows = spark.range(0, 5000, 1, 1).selectExpr("string(id) t")
        assert max(r.e[0] for r in vectors.embedded(rows, Counting(), "t", "e").collect()) == 1000
    finally:
        spark.conf.set(key, before)


def test_no_text_is_shuffled_to_leave_out_the_dead(spark, tmp_path):
    """An anti join would be put before the vectors are made, and shuffle whole texts for a long list of dead."""
    from findery import catalog
    from findery.operators import vectors

    spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(None, "none")], "doc_id long, searchable_text string").write.parquet(f"{tmp_path}/d")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        docs = vectors.embedded(spark.read.parquet(f"{tmp_path}/d"), vectors.MockProvider(16))
        got = catalog.mock_scores(docs, spark.createDataFrame([(3,), (3,), (5,)], "doc_id long"))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("ArrowEvalPython"), plan
        assert sorted(r.doc_id for r in got.filter("doc_id is not null").collect()) == [i for i in range(20) if i not in (3, 5)]
        assert got.filter("doc_id is null").count() == 1
    finally:
        spark.conf.set(key, before)


def test_even_tables_are_not_dealt_out(spark, tmp_path):
    """Eight files on more cores stay as they are; a row group that is most of a table is dealt by key."""
    from findery.sources.tables import spread

    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 800, 1, max(1, cores // 2)).withColumnRenamed("id", "doc_id")
    rows.write.parquet(f"{tmp_path}/even")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    even, one = (spread(spark.read.parquet(f"{tmp_path}/{d}")) for d in ("even", "one"))
    assert "Repartition" not in even._jdf.queryExecution().optimizedPlan().toString()
    assert ("Repartition" in one._jdf.queryExecution().optimizedPlan().toString()) == (cores > 3)
    assert sorted(r.doc_id for r in one.collect()) == list(range(800))


def test_tables_are_dealt_by_their_own_key(spark, tmp_path, monkeypatch):
    """Pages and embeddings have no doc_id; a single row group of theirs is dealt by page_id and vec_id."""
    from findery.llm.common import table
    from findery.sources import tables

    monkeypatch.setattr(tables, "UNEVEN", 0)
    for name, key in (("pages", "page_id"), ("embeddings", "vec_id"), ("other", "word")):
        spark.range(0, 50, 1, 1).selectExpr(f"id as {key}", "string(id) as text").write.parquet(f"{tmp_path}/{name}.parquet")
        got = table(spark, str(tmp_path), name)
        assert f"RepartitionByExpression [{key}" in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r[0] for r in got.collect()) == list(range(50))


def test_tasks_follow_from_rows_where_cores_are_few(spark, tmp_path, monkeypatch):
    """While executors register Spark counts two cores, so that a large row group stayed one task."""
    from findery.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 100 * cores, 1, cores).selectExpr("id as doc_id", "'x' as text").write.parquet(f"{tmp_path}/d")
    got = tables.spread(spark.read.parquet(f"{tmp_path}/d"))
    assert "RepartitionByExpression [doc_id#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.split("], ")[1].startswith(str(10 * cores))
    assert sorted(r.doc_id for r in got.collect()) == list(range(100 * cores))
