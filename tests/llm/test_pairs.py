import random
from collections import defaultdict

import numpy as np
import pytest
from findery.llm import clusters, embedding_dedup, jaccard_join, topk_search
from pyspark.sql import functions as F


def words(r, n):
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randint(0, 60)) for _ in range(n)]


def corpus():
    r = random.Random(4)
    texts = []
    for _ in range(25):
        base = words(r, r.randint(20, 120))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = base[:]
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    crowd = words(r, 100)  # a large group of near copies
    texts += [" ".join(crowd[:k] + [f"own{k}"] + crowd[k + 1 :]) for k in range(0, 100)]
    texts += ["", None, " \n ", "one two", "One  two", "one", "a b c d e", "a b c d f", " ".join(crowd * 200)]
    return texts


def brute(texts, least=0.8, n=5):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links = defaultdict(set)
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                links[i].add(j), links[j].add(i)
    component = {}
    for i in range(len(sets)):
        if i not in component:
            component[i], front = i, [i]
            while front:
                for y in links[front.pop()]:
                    if y not in component:
                        component[y] = i
                        front.append(y)
    return links, component


def test_jaccard_join_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, size int, cluster string").repartition(3)
    links, component = brute(texts)
    got = {r.doc_id: r for r in jaccard_join.ngram_jaccard_join(docs).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].class_id) == (len(links[i]), component[i]), i
    assert got[texts.index("One  two")].copy_of == texts.index("one two")


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 8)
    monkeypatch.setattr(jaccard_join, "DEPTH", 2)
    texts = corpus()
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    links, component = brute(texts)
    got = {r.doc_id: r for r in jaccard_join.ngram_jaccard_join(docs).collect()}
    assert all((got[i].n_links, got[i].class_id) == (len(links[i]), component[i]) for i in range(len(texts)))


@pytest.mark.parametrize("kept", [0.5, 1.0])
def test_pairs_of_large_nodes_reach_the_recall(spark, monkeypatch, kept):
    monkeypatch.setattr(jaccard_join, "BUCKET", 1)  # every pair has to survive all splits: two with kept=0.5, six else
    monkeypatch.setattr(jaccard_join, "KEPT", kept)
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 32, (400, 64), np.uint32)
    b = np.where(r.random(a.shape) < 0.8, a, r.integers(0, 1 << 32, a.shape, np.uint32))
    rows = [(2 * i + j, x[i].astype("<u4").tobytes()) for i in range(400) for j, x in enumerate((a, b))]
    edges, _ = jaccard_join.chosen_paths(spark.createDataFrame(rows, "rec long, sig binary"), 0.8, range(1, 1 + jaccard_join.runs_for(1e-4, 0.8, 1)), 1e-4)
    found = {(min(e), max(e)) for e in edges.collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(400)}


@pytest.mark.parametrize("depth", [1, 2, 3, 6])
def test_recall_by_level_of_exact_sets(depth):
    """Pairs of real shingle sets at the threshold, brute force beside the path tree: the runs for a level reach the target at it."""
    r = np.random.default_rng(depth)
    n, runs = 3000, jaccard_join.runs_for(1e-4, 0.8, depth)
    pairs = []
    for _ in range(n):
        both = r.integers(0, 1 << 63, 80, np.uint64)
        pairs.append([jaccard_join.minhash(np.concatenate((both, r.integers(0, 1 << 63, 10, np.uint64)))) for _ in range(2)])
    a, b = (np.stack(x) for x in zip(*pairs))
    met = np.zeros(n, bool)
    for run in range(1, runs + 1):
        at = {i: {int(jaccard_join.mix(np.array([run], np.uint64))[0])} for i in range(n) if not met[i]}
        for _ in range(depth):
            owner = np.array([i for i, p in at.items() for _ in p], np.int64)
            paths = np.array([x for p in at.values() for x in p], np.uint64)
            if not len(owner):
                break
            below = [{(int(owner[k]), int(x)) for k, x in zip(*jaccard_join.children(paths, side[owner], 0.8))} for side in (a, b)]
            at = {}
            for i, x in below[0] & below[1]:
                at.setdefault(i, set()).add(x)
        met[list(at)] = True
    assert met.mean() >= 0.999  # 0.9999 wanted; 3,000 pairs


def test_too_few_runs_are_noticed(spark, monkeypatch):
    real, made = jaccard_join.chosen_paths, []

    def poor(records, similarity, runs, most_lost):
        made.append(runs)
        edges, all_ = real(records, similarity, runs, most_lost)
        return (edges.filter("false"), all_) if len(made) == 1 else (edges, all_)

    monkeypatch.setattr(jaccard_join, "chosen_paths", poor)
    texts = corpus()
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    links, component = brute(texts)
    got = {r.doc_id: r for r in jaccard_join.ngram_jaccard_join(docs).collect()}
    assert len(made) > 1 and all((got[i].n_links, got[i].class_id) == (len(links[i]), component[i]) for i in range(len(texts)))


def test_rows_of_one_id_and_unlike_texts_are_classes_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "o p q r s t u"), (None, "o p q r s t u"), (None, "")], "doc_id long, text string")
    got = jaccard_join.ngram_jaccard_join(docs).collect()
    assert len({r.class_key for r in got}) == 4 and sum(r.class_key is None for r in got) == 1


def test_jaccard_join_of_nothing_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "")], "doc_id long, text string")
    assert jaccard_join.ngram_jaccard_join(docs.limit(0)).count() == 0
    rows = sorted([(r.doc_id or -1, r.class_id, r.n_links) for r in jaccard_join.ngram_jaccard_join(docs).collect()], key=str)
    assert rows == sorted([(1, 1, 2), (1, 1, 2), (-1, 1, 2), (-1, None, 0), (3, 3, 0)], key=str)


def test_components(spark):
    from findery.llm.common import mix

    r = np.random.default_rng(1)
    nodes = mix(np.arange(1, 2000, dtype=np.uint64)).view(np.int64)
    chain = [(int(nodes[i]), int(nodes[i + 1])) for i in range(600)] + [(int(nodes[1000]), int(nodes[1001 + i])) for i in range(300)]
    r.shuffle(chain)
    rows = clusters.components(spark.createDataFrame(chain, "a long, b long")).collect()
    of = {x.node: x.component for x in rows}
    assert len({of[int(n)] for n in nodes[:601]}) == 1 and len({of[int(n)] for n in nodes[1000:1301]}) == 1 and len(set(of.values())) == 2
    assert clusters.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        rows.append((i, r.normal(size=16).tolist(), int(r.integers(0, 3))))
    for i in range(400, 520):  # near copies
        j = int(r.integers(0, 60))
        rows.append((i, (np.array(rows[j][1]) + r.normal(size=16) * r.choice([0.02, 0.1, 0.3])).tolist(), rows[j][2]))
    hot = r.normal(size=16)
    rows += [(520 + i, (hot + r.normal(size=16) * 0.02).tolist(), 1) for i in range(150)]
    rows += [(700, rows[0][1], rows[0][2]), (701, rows[0][1], (rows[0][2] + 1) % 3), (702, [0.0] * 16, 0), (703, None, 0), (704, [float("nan")] * 16, 0), (705, [None] + [1.0] * 15, 0), (706, rows[0][1], None), (707, [float("inf")] * 16, 0), (708, [1.0, 2.0], 0), (709, [2.0, 4.0], 0), (710, [1e300] * 16, 2), (711, [1e-300] * 16, 2), (712, [], 0)]
    return rows


def good(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)


@pytest.mark.parametrize("trees,rounds", [(embedding_dedup.TREES, embedding_dedup.ROUNDS), (1, 1)])
def test_nn_descent_equals_brute_force(spark, monkeypatch, trees, rounds):
    monkeypatch.setattr(embedding_dedup, "TREES", trees)
    monkeypatch.setattr(embedding_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(embedding_dedup, "RECALL", 1.0)
    real, recalls = embedding_dedup.audited, []
    monkeypatch.setattr(embedding_dedup, "audited", lambda *a: recalls.append(real(*a)) or recalls[-1])
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rec", F.lit("x")).repartition(3)
    links = defaultdict(set)
    unit = {i: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for i, v, _ in rows if good(v)}
    for i, v, a in rows:
        for j, w, b in rows:
            if i != j and a is not None and a == b and good(v) and good(w) and len(v) == len(w) and unit[i] @ unit[j] >= 0.93:
                links[i].add(j)
    component = {}
    for i, _, _ in rows:
        if i not in component:
            component[i], front = i, [i]
            while front:
                for y in links[front.pop()]:
                    if y not in component:
                        component[y] = i
                        front.append(y)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, _, _ in rows if (got[i].n_links, got[i].component_id, got[i].kept) != (len(links[i]), component[i], component[i] == i)]
    assert not wrong and recalls[-1] == 1.0  # a poor start is noticed and mended
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_equal_vectors_under_long_labels_stay_apart(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 5), (2, [1.0, 2.0], 5 + (1 << 32)), (3, [1.0, 2.0], 5)], "vec_id long, embedding array<double>, label long")
    assert {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == {(1, 1, 1), (2, 0, 2), (3, 1, 1)}


def two_tight_groups(n=200):
    """Groups of n close records each, whose centres have a cosine of 0.95: every list is full of its own group."""
    r = np.random.default_rng(6)
    a, b = np.eye(16)[0], 0.95 * np.eye(16)[0] + np.sqrt(1 - 0.95**2) * np.eye(16)[1]
    return [(i, ((a if i < n else b) + r.normal(size=16) * 0.001).tolist(), 0) for i in range(2 * n)]


def test_saturated_groups_meet(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MOST_ATTEMPTS", 1)
    monkeypatch.setattr(embedding_dedup, "audited", lambda *a: 1.0)  # by the graph and the balls, not by the exact way out
    far = np.random.default_rng(8).normal(size=(100, 16)).tolist()
    df = spark.createDataFrame([*two_tight_groups(), *((1000 + i, v, 0) for i, v in enumerate(far))], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df).filter("vec_id < 1000").collect()
    assert {(r.n_links, r.component_id) for r in got} == {(399, 0)}


def test_recall_not_reached_ends_in_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MOST_ATTEMPTS", 1)
    monkeypatch.setattr(embedding_dedup, "nn_descent", lambda records, *a: records.sparkSession.createDataFrame([], "u long, v long, s double, fresh boolean"))
    df = spark.createDataFrame(two_tight_groups(40), "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == {(79, 0)}


def test_exact_topk_equals_brute_force(spark):
    rows = [(i, v) for i, v, _ in vectors(3)] + [(1000 + i, [0.5] * 16) for i in range(30)] + [(-50, [0.5] * 16), (2000, [1e7] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v is not None and None not in v and all(np.isfinite(v)) and max(map(abs, v), default=0) < 1e15}
    df = df.filter("vec_id not in (710)")
    q.pop(710, None)
    got = defaultdict(list)
    for r in topk_search.exact_topk(df, F.pmod("vec_id", F.lit(50)) == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = {i: sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in q.items() if j != i and len(v) == len(w)))[:5] for i, v in q.items() if i % 50 == 0}
    assert {i for i, w in want.items() if w} == set(got)
    for i, w in want.items():
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(w)], i
    assert topk_search.exact_topk(df.limit(0), F.col("vec_id") == 0).count() == 0
