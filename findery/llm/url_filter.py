"""URL filter: rules first, then a ratio of two character language models (operator 2).

Two variable-order Markov models, of accepted and of rejected URLs, give each URL a log-likelihood difference per
character. Rejected are URLs that a rule blocks or whose host holds a seed word; accepted are those that a rule allows
and, as background, those without rule or seed word, so that the models don't learn the rules' own coverage. The models
are fitted on all URLs: grams are counted by class and fold, orders are mixed by joins, and what a gram adds to a score is
looked up by the texts that have it. The threshold is calibrated on all accepted URLs, each scored by the counts without
its fold's. Every URL is scored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findery.llm.common import discard, hot_keys, reading, replicated, salted, saved, tidy

ORDER = 5
ALPHABET = 256
FALSE_BLOCKS = 0.01
FOLDS = 5
BLOCK_GRAMS = 200_000
HOT_GRAMS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A host with one of these words is taken as rejected when the models are fitted.
SEED_WORDS = ["casino", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx"]


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Up to the first /, ? or #, with A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Of equal length, the first in the list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


class MarkovModel:
    """Variable-order character model: Witten-Bell mixing of all orders up to the longest context that was seen. For lists that fit in memory; weights() gives the same from tables."""

    def __init__(self, texts: list[str], order: int = ORDER, alphabet: int = ALPHABET):
        self.order, self.alphabet = order, alphabet
        self.counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for t in texts:
            padded = "\n" * order + t
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    self.counts[padded[i - k : i]][padded[i]] += 1
        self.total = {c: (sum(n.values()), len(n)) for c, n in self.counts.items()}
        self.counts = {c: dict(n) for c, n in self.counts.items()}
        self.memo: dict[str, float] = {}

    def probability(self, context: str, char: str) -> float:
        p = 1 / self.alphabet
        for k in range(len(context) + 1):
            c = context[len(context) - k :]
            if c not in self.total:
                break
            n, kinds = self.total[c]
            p = (self.counts[c].get(char, 0) + kinds * p) / (n + kinds)
        return p

    def log_likelihood(self, text: str) -> float:
        padded, total = "\n" * self.order + text, 0.0
        for i in range(self.order, len(padded)):
            gram = padded[i - self.order : i + 1]
            if (p := self.memo.get(gram)) is None:
                if len(self.memo) > 1_000_000:
                    self.memo.clear()
                p = self.memo[gram] = math.log(self.probability(gram[:-1], gram[-1]))
            total += p
        return total


class UrlModel:
    """Gram counts of both classes, saved by length, and the threshold below which a URL is blocked. Without URLs of both classes nothing is."""

    def __init__(self, counts: list[DataFrame], contexts: list[DataFrame], ready: bool, order: int):
        self.counts, self.contexts, self.ready, self.order = counts, contexts, ready, order
        self.threshold = 0.0 if ready else -math.inf


def parsed(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, by_rule, scored) of every url; scored is what the models see."""
    url = F.col("url")
    out = pages.select("page_id", "url").withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rest = F.concat("host", after_scheme(F.coalesce(url, F.lit(""))).substr(F.length("host") + 1, F.length(F.coalesce(url, F.lit("")))))
    return out.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("scored", rest).drop("url")


def labelled(rows: DataFrame, seed_words: list[str]) -> DataFrame:
    """(scored, slot) of each different URL that is of a class: slots below FOLDS are folds of the accepted, slot FOLDS holds the rejected."""
    seeded = F.col("host").rlike("|".join(seed_words)) if seed_words else F.lit(False)
    label = F.when(seeded, "block").otherwise(F.coalesce("by_rule", F.when(F.col("host") != "", "allow")))
    fold = F.pmod(F.xxhash64("scored"), F.lit(FOLDS)).cast("int")
    return rows.select("scored", F.when(label == "block", FOLDS).when(label == "allow", fold).alias("slot")).filter("slot is not null").distinct()


def grams(rows: DataFrame, order: int) -> DataFrame:
    """(gram, slot, n): each character of (scored, slot) after the `order` before it, summed over a block before anything is sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[int, str]] = Counter()

        def done() -> Iterator[pa.RecordBatch]:
            keys, n = [*held], [*held.values()]
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000]
                yield pa.record_batch([pa.array([g for _, g in part], pa.string()), pa.array([s for s, _ in part], pa.int32()), pa.array(n[a : a + 100_000], pa.int64())], names=["gram", "slot", "n"])
            held.clear()

        for b in batches:
            for t, slot in zip(b.column("scored").to_pylist(), b.column("slot").to_pylist()):
                padded = "\n" * order + t
                held.update((slot, padded[i : i + order + 1]) for i in range(len(t)))
                if len(held) >= BLOCK_GRAMS:
                    yield from done()
        yield from done()

    return rows.select("scored", "slot").mapInArrow(tidy(count), "gram string, slot int, n long")


def of_models(n: Callable[[int], Column]) -> list[Column]:
    """From the counts by slot those of each model: accepted, accepted without each fold, rejected."""
    every = reduce(add, (n(i) for i in range(FOLDS)))
    return [every, *(every - n(i) for i in range(FOLDS)), n(FOLDS)]


def gram_model(classes: DataFrame, order: int) -> UrlModel:
    """Counts of all grams of all URLs (scored, slot). Shorter grams are the ends of longer ones; a context has its total and how many characters follow it, for each model."""
    slots = [F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(FOLDS + 1)]
    counts = [saved(grams(classes, order).groupBy("gram").agg(*slots))]
    for k in range(order - 1, -1, -1):
        shorter = F.right(F.col("gram"), F.lit(k + 1)).alias("gram")
        counts.insert(0, saved(counts[0].groupBy(shorter).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(FOLDS + 1)))))
    contexts = []
    for k, table in enumerate(counts):
        m = of_models(lambda i: F.col(f"n{i}"))
        sums = [F.sum(x).alias(f"total{j}") for j, x in enumerate(m)] + [F.sum((x > 0).cast("long")).alias(f"kinds{j}") for j, x in enumerate(m)]
        contexts.append(saved(table.groupBy(F.left(F.col("gram"), F.lit(k)).alias("context")).agg(*sums)))
    accepted, rejected = contexts[0].agg(F.sum("total0"), F.sum(f"total{FOLDS + 1}")).head()
    return UrlModel(counts, contexts, bool(accepted and rejected), order)


def weights(model: UrlModel, wanted: DataFrame) -> DataFrame:
    """(gram, times, w) of wanted (gram, times): by how much its last character is likelier after the others in the accepted; w has that of all folds first, then that without each. Saved."""
    models = range(FOLDS + 2)
    known: DataFrame | None = None
    for k in range(model.order + 1):
        # of a shorter gram or a context at most as many grams ask as there are characters, so that no key is hot
        asked = wanted.select(F.right(F.col("gram"), F.lit(k + 1)).alias("gram")).distinct()
        asked = asked.join(model.counts[k], "gram", "left").withColumn("context", F.left(F.col("gram"), F.lit(k)))
        asked = asked.join(model.contexts[k] if k else F.broadcast(model.contexts[0]), "context", "left")
        n = of_models(lambda i: F.coalesce(f"n{i}", F.lit(0)))
        if known is not None:
            asked = asked.join(known.withColumnRenamed("gram", "shorter"), F.right(F.col("gram"), F.lit(k)) == F.col("shorter"))
        before = [F.col(f"p{j}") if k else F.lit(1 / ALPHABET) for j in models]
        mixed = [(n[j] + F.col(f"kinds{j}") * before[j]) / (F.col(f"total{j}") + F.col(f"kinds{j}")) for j in models]
        known = asked.select("gram", *(F.when(F.col(f"total{j}") > 0, mixed[j]).otherwise(before[j]).alias(f"p{j}") for j in models))
    w = F.array(*(F.log(f"p{j}") - F.log(f"p{FOLDS + 1}") for j in range(FOLDS + 1)))
    return saved(known.select("gram", w.alias("w")).join(wanted, "gram").select("gram", "times", "w"))


def scores(rows: DataFrame, w: DataFrame, order: int) -> DataFrame:
    """rows (scored, slot, ...) with score: the mean weight of a URL's grams, that of place `slot`; 0 for empty texts.

    The grams seen most often are broadcast, HOT_GRAMS at most. The others, if there are any, are joined by shuffle, once
    for each different URL.
    """
    of = w.groupBy("times").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy(F.desc("times"))))
    least = of.filter(F.col("upto") <= HOT_GRAMS).agg(F.min("times")).head()[0]
    hot = w.filter(F.col("times") >= least).select("gram", "w").toArrow() if least is not None else pa.table({"gram": pa.array([], pa.string()), "w": pa.array([], pa.list_(pa.float64()))})
    flat = hot.column("w").combine_chunks().flatten().to_numpy() if len(hot) else np.zeros(0)
    shared = rows.sparkSession.sparkContext.broadcast((hot.column("gram").to_pylist(), flat.reshape(-1, FOLDS + 1)))

    def known(batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[pa.RecordBatch]:
        names, values = shared.value
        place = {g: i for i, g in enumerate(names)}
        for b in batches:
            total: list[float] = []
            cold: list[tuple[int, int, str]] = []
            keys = b.column("key").to_pylist() if rest else [0] * b.num_rows
            for t, slot, key in zip(b.column("scored").to_pylist(), b.column("slot").to_pylist(), keys):
                padded = "\n" * order + t
                at = [place.get(padded[i : i + order + 1], -1) for i in range(len(t))]
                if rest:
                    cold += [(key, slot, padded[i : i + order + 1]) for i, x in enumerate(at) if x < 0]
                else:
                    total.append(float(values[[x for x in at if x >= 0], slot].sum()) if names else 0.0)
            if rest:
                yield pa.record_batch([pa.array([c[i] for c in cold], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["key", "slot", "gram"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total, pa.float64())], names=[*b.schema.names, "sum"])

    keyed = rows.withColumn("key", F.xxhash64("scored"))
    summed = keyed.mapInArrow(tidy(lambda b: known(b, False)), T.StructType([*keyed.schema.fields, T.StructField("sum", T.DoubleType())]))
    others = w.filter(F.col("times") < least) if least is not None else w
    if not others.isEmpty():
        each = keyed.select("key", "scored", "slot").dropDuplicates(["key", "slot"])
        cold = each.mapInArrow(tidy(lambda b: known(b, True)), "key long, slot int, gram string").join(others, "gram")
        cold = saved(cold.groupBy("key", "slot").agg(F.sum(F.col("w")[F.col("slot")]).alias("cold")))
        hot_urls, salts = hot_keys(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
        summed = salted(summed.withColumn("__by", F.rand(1)), "key", "__by", hot_urls, salts).drop("__by")
        summed = summed.join(replicated(cold, "key", hot_urls, salts), ["key", "slot", "__salt"], "left").withColumn("sum", F.col("sum") + F.coalesce("cold", F.lit(0.0)))
    length = F.length("scored")
    return summed.select(*rows.columns, F.when(length > 0, F.col("sum") / length).otherwise(0.0).alias("score"))


def quantile_of(values: DataFrame, q: float) -> float | None:
    """The exact quantile of one column, between its neighbours in proportion: values are dealt by ranges, and only the ranges that hold these are sorted."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(values.toDF("x").repartitionByRange(parts, "x").withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()
    n = sum(r["n"] for r in sizes)
    if not n:
        return None
    place = q * (n - 1)
    found = []
    for at in (math.floor(place), math.ceil(place)):
        for r in sizes:
            if at < r["n"]:
                found.append(dealt.filter(F.col("range") == r["range"]).withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("x"))).filter(F.col("at") == at + 1).head()["x"])
                break
            at -= r["n"]
    discard(dealt)
    return found[0] + (found[1] - found[0]) * (place - math.floor(place))


def calibrated(model: UrlModel, classes: DataFrame, w: DataFrame, false_blocks: float) -> UrlModel:
    """The model with its threshold, from the score of each accepted URL without its fold."""
    held = scores(classes.filter(F.col("slot") < FOLDS).withColumn("slot", F.col("slot") + 1), w, model.order)
    if (at := quantile_of(held.select("score"), false_blocks)) is not None:
        model.threshold = min(0.0, at)
    return model


def asked_grams(rows: DataFrame, order: int) -> DataFrame:
    """(gram, times) of all texts (scored), saved."""
    return saved(grams(rows.select("scored", F.lit(0).alias("slot")), order).groupBy("gram").agg(F.sum("n").alias("times")))


def fit_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, seed_words: list[str] = SEED_WORDS, order: int = ORDER, false_blocks: float = FALSE_BLOCKS) -> UrlModel:
    """Models and threshold from all URLs of each class."""
    classes = saved(labelled(parsed(pages, rules), seed_words))
    model = gram_model(classes, order)
    if model.ready:
        wanted = asked_grams(classes, order)
        w = weights(model, wanted)
        calibrated(model, classes, w, false_blocks)
        discard(wanted, w)
    discard(classes)
    return model


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, model: UrlModel | None = None, seed_words: list[str] = SEED_WORDS, order: int = ORDER, false_blocks: float = FALSE_BLOCKS) -> DataFrame:
    """Host, path, rule, verdict and model score of every url (page_id, url; other columns are ignored).

    A null url or one without :// has an empty host and path, no rule and score 0, so it is allowed. Repeated rows and ids
    stay. Without a model, one is fitted on all of these pages (see fit_urls); where a class has no URLs (an empty table
    too), nothing is blocked but by rules.
    """
    rows = saved(parsed(pages, rules).withColumn("slot", F.lit(0)))
    classes = None
    if model is None:
        classes = saved(labelled(rows, seed_words))
        model = gram_model(classes, order)
    if model.ready:
        wanted = asked_grams(rows.select("scored"), model.order)
        w = weights(model, wanted)
        if classes is not None:
            calibrated(model, classes, w, false_blocks)
        judged = scores(rows, w, model.order)
        discard(wanted, w)
    else:
        judged = rows.withColumn("score", F.lit(0.0))
    if classes is not None:  # a model that was given stays
        discard(classes, *model.counts, *model.contexts)
    verdict = F.coalesce("by_rule", F.when(F.col("score") < model.threshold, "block").otherwise("allow"))
    return reading(judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score"), rows)
