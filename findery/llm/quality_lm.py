"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text (operator 4).

Words and pairs of neighbours are known by 64-bit hashes, so no vocabulary is fixed and nothing by word is held in one
place: all that is counted grows with the corpus. Pair counts are grouped, give the statistics of contexts and
continuations, and are joined with both; no pair is pruned. What comes out is one weight for each seen word and pair.
The logarithm of a document's probability is a constant for each word, plus the weights of its words (back-off as a context, continuation
probability), plus those of its pairs (what a pair adds to backing off), so scoring is a join of postings with weights
and a sum by document. The weights seen most often, a table of fixed size, are broadcast; the others are kept in
shards of the hash space. Documents become blocks that add up what they find in the table, send each shard the postings
of the rest, packed, and get back a sum for each document. A text is its words between a start and an end.
Thresholds are quantiles by language over trusted documents that were held out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.llm.common import discard, fits_broadcast, hot_keys, mix, reading, replicated, salted, saved, tidy, word_hashes
from findery.sources.tables import release

WORD = np.uint64((1 << 48) - 1)  # a word's hash has 48 bits: shuffles carry many of them
START, END = np.uint64(0xF42D4C957F2D), np.uint64(0x7B7EF767814F)
LEAST_SEEN = 1  # of a pair that has a weight of its own: all
FACTOR = np.uint64(0xD1342543DE82EF95)
CODE_BITS = 32  # of a hash, beside its shard: an unseen word or pair is taken for a seen one once in 2**32 / SHARD_ITEMS
CODE_BYTES = -(-CODE_BITS // 8)
BLOCK_TOKENS, BLOCK_DOCS = 1 << 19, 1 << 16
SHARD_ITEMS = 1 << 18
FEW_SHARDS = 64  # as many, but no more than partitions, where the weights need fewer
SUMS_BYTES = 1 << 25
HOT_ITEMS = 1 << 19
SLICES, SLICE_PAIRS = 5, 1 << 20  # pairs are joined in so many slices where there are more of them, as the joins' shuffles would else take twice their size at once
HELD_OUT = 10  # one trusted document in so many
QUANTILE = 0.99
SLACK = 0.2  # nats; a quantile of a few dozen held-out documents is uncertain by about as much
PRIOR_WORDS = 20  # a short document's mean is drawn to its language's median by so many words


def zipped(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 3)


def unzipped(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def planes(a: np.ndarray) -> bytes:
    """Numbers with their bytes of equal weight together, which compress better."""
    return zipped(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T))


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(unzipped(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_codes(sorted_codes: np.ndarray) -> bytes:
    """Ascending codes of CODE_BITS, as differences."""
    return zipped(np.ascontiguousarray(np.diff(sorted_codes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].T))


def unpack_codes(data: bytes) -> np.ndarray:
    part = unzipped(data, np.uint8).reshape(CODE_BYTES, -1).T
    d = np.zeros((len(part), 8), np.uint8)
    d[:, :CODE_BYTES] = part
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * FACTOR + mix(word))


def neighbours(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, word) of each prediction: a document's words after START, and END after its last."""
    starts = np.cumsum(lengths + 1) - lengths - 1
    first, last = np.zeros(len(words) + len(lengths), bool), np.zeros(len(words) + len(lengths), bool)
    first[starts], last[starts + lengths] = True, True
    context, word = np.full(len(first), START), np.full(len(first), END)
    context[~first] = word[~last] = words
    return context, word


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts D1, D2, D3+ from the numbers of counts 1 to 4; sound for small samples too."""
    n1, n2, n3, n4 = (max(1, x or 0) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05, 0.1, 0.2], [0.95, 1.9, 2.9]).tolist()


def discount(d: list[float], count: Column) -> Column:
    return F.when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, text, key, trusted, held). Trusted are documents with a label of quality 1 that none calls toxic."""
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0 and doc_id is not null").select("doc_id", F.lit(True).alias("__trusted"))
    trusted = saved(trusted)
    docs = docs.select("doc_id", "lang", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    if fits_broadcast(trusted, 32):
        docs = docs.join(F.broadcast(trusted), "doc_id", "left")
    else:  # null ids, which no label can mean, don't meet in one task
        docs = docs.filter("doc_id is not null").join(trusted, "doc_id", "left").unionByName(docs.filter("doc_id is null").withColumn("__trusted", F.lit(None).cast("boolean")))
        docs = docs.sortWithinPartitions("doc_id", "key")  # a task that is run again makes the same blocks
    return docs.withColumn("trusted", F.coalesce("__trusted", F.lit(False))).drop("__trusted").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(u, v, n): how often v follows u. Summed over a block of tokens before anything is sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> Iterator[pa.RecordBatch]:
            context, word = (np.concatenate(x) for x in zip(*held))
            held.clear()
            _, at, n = np.unique(pair_hash(context, word), return_index=True, return_counts=True)
            for a in range(0, len(at), 100_000):
                part = at[a : a + 100_000]
                yield pa.record_batch([pa.array(context[part].view(np.int64)), pa.array(word[part].view(np.int64)), pa.array(n[a : a + 100_000])], names=["u", "v", "n"])

        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                words, offsets = word_hashes(whole.column(0).slice(a, 1024))
                lengths = np.diff(offsets)
                held.append(neighbours(words & WORD, lengths[lengths > 0]))
                if sum(len(x) for x, _ in held) >= BLOCK_TOKENS:
                    yield from done()
        if held:
            yield from done()

    return texts.select("text").mapInArrow(tidy(count), "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def model(texts: DataFrame) -> tuple[DataFrame, float, float]:
    """Weights (hash, weight, times), saved, and the logarithms of what each word and each document has besides."""
    pairs = saved(pair_counts(texts), "zstd")
    release(pairs)
    times = lambda c, k: F.sum((F.col(c) == k).cast("long"))
    total, *of = pairs.agg(F.count(F.lit(1)), *(times("n", k) for k in (1, 2, 3, 4))).head()
    d = discounts(of)
    taken = F.sum(discount(d, F.col("n")))
    contexts = saved(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.log(taken / F.sum("n")).alias("back"), taken.alias("scale"), F.sum("n").alias("total")))
    follow = saved(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    release(pairs)
    kinds, *of = follow.agg(F.count(F.lit(1)), *(times("n", k) for k in (1, 2, 3, 4))).head()
    d1 = discounts(of)
    mass = follow.agg(F.sum(discount(d1, F.col("n")))).head()[0] or 0.0
    rest = mass / total / (kinds + 1) if total else 1.0  # of each word, and of all unknown ones together
    one = (F.col("n") - discount(d1, F.col("n"))) / F.lit(max(total, 1)) + F.lit(rest)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items of pairs (u, v), and of words where v is null."""
        for b in batches:
            u, v = (b.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("u", "v"))
            h = np.where(np.asarray(b.column("v").is_null()), mix(u), pair_hash(u, v))
            yield pa.record_batch([pa.array(h.view(np.int64)), b.column("weight"), b.column("times")], names=["hash", "weight", "times"])

    following = follow.select("v", one.alias("one"))
    hot_u, salts_u = hot_keys(contexts.select("u", "n"), "u")
    hot_v, salts_v = hot_keys(follow, "v")
    slices = SLICES if total > SLICE_PAIRS else 1

    def items(rows: DataFrame) -> DataFrame:
        return saved(rows.mapInArrow(tidy(hashed), "hash long, weight float, times long"), "zstd")

    parts = []
    for i in range(slices):
        own = lambda rows: rows.filter(F.pmod(F.xxhash64("v"), F.lit(slices)) == i) if slices > 1 else rows  # noqa: B023, E731
        seen = salted(own(pairs).filter(F.col("n") >= LEAST_SEEN).withColumnRenamed("n", "times"), "u", "v", hot_u, salts_u).join(replicated(contexts.select("u", "scale"), "u", hot_u, salts_u), ["u", "__salt"]).drop("__salt")
        seen = salted(seen, "v", "u", hot_v, salts_v).join(replicated(own(following), "v", hot_v, salts_v), ["v", "__salt"])
        parts.append(items(seen.select("u", "v", F.log1p((F.col("times") - discount(d, F.col("times"))) / F.col("scale") / F.col("one")).cast("float").alias("weight"), "times")))
        if slices > 1:
            release(pairs)
    words = contexts.join(following, F.col("u") == F.col("v")).select("u", F.lit(None).cast("long").alias("v"), (F.col("back") + F.log("one") - float(np.log(rest))).cast("float").alias("weight"), F.col("total").alias("times"))
    parts.append(items(words))
    weights = reading(reduce(DataFrame.unionByName, parts), *parts)
    ends = lambda c: int(c.astype(np.int64))
    back = contexts.filter(F.col("u") == ends(START)).select("back").head()
    close = following.filter(F.col("v") == ends(END)).select("one").head()
    discard(pairs, contexts, follow)
    release(weights)
    return weights, float(np.log(rest)), (back[0] if back else 0.0) + (float(np.log(close[0])) if close else 0.0)


def parted(weights: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """Hashes in order and weights of those seen most often, at most `most` (of equal counts all or none), and the others."""
    falling = Window.orderBy(F.desc("times"))  # over the distinct counts: at most the square root of twice the tokens
    counts = weights.groupBy("times").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(falling))
    least = counts.filter(F.col("upto") <= most).agg(F.min("times")).head()[0]
    if least is None:
        return (np.zeros(0, np.uint64), np.zeros(0, np.float32)), weights
    hot = weights.filter(F.col("times") >= least).select("hash", "weight").toArrow()
    h, w = hot.column("hash").to_numpy().view(np.uint64), hot.column("weight").to_numpy()
    order = np.argsort(h)
    return (h[order], w[order]), weights.filter(F.col("times") < least)


SHARDED = "shard int, block long, docs int, codes binary, items binary, doc binary, times binary, weights binary, doc_id array<long>, key array<long>, lang array<string>, trusted array<boolean>, held array<boolean>, lengths binary, sums binary"
INFO = [("doc_id", pa.int64()), ("key", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("held", pa.bool_())]
SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("docs", pa.int32()), *((c, pa.binary()) for c in ("codes", "items", "doc", "times", "weights")), *((c, pa.list_(t)) for c, t in INFO), ("lengths", pa.binary()), ("sums", pa.binary())])


def sharded(weights: DataFrame, bits: int) -> DataFrame:
    """The weights as one packed row for each shard: hashes with the same upper `bits`."""
    code = F.shiftrightunsigned(F.shiftleft("hash", bits), 64 - CODE_BITS)
    rows = weights.select(F.shiftrightunsigned("hash", 64 - bits).cast("int").alias("shard"), code.alias("code"), "weight")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, codes, values = None, [], []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": shard, "codes": pack_codes(np.concatenate(codes)), "weights": planes(np.concatenate(values))}], SCHEMA)

        for b in batches:
            at, code, value = b.column("shard").to_numpy(), b.column("code").to_numpy().astype("<u8"), b.column("weight").to_numpy().astype("<f4")
            bounds = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(at)]
            for x, y in zip(bounds[:-1], bounds[1:]):
                if x < y:
                    if shard is not None and at[x] != shard:
                        yield done()
                        codes, values = [], []
                    shard = int(at[x])
                    codes.append(code[x:y])
                    values.append(value[x:y])
        if shard is not None:
            yield done()

    parts = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "code").mapInArrow(tidy(pack), SHARDED)


def questions(docs: DataFrame, bits: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of each block of documents a row that says what they are and have of the hot weights, and for each shard a row with their other words and pairs there and the documents that have them."""
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        words: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = docs_held = 0

        def block() -> Iterator[pa.RecordBatch]:
            t, n, w = pa.Table.from_batches(held), np.concatenate(lengths), np.concatenate(words)
            # long documents first: those that have most postings get the small numbers
            by_length, before = np.argsort(-n, kind="stable"), np.cumsum(n) - n
            w = w[np.repeat(before[by_length] - (np.cumsum(n[by_length]) - n[by_length]), n[by_length]) + np.arange(len(w))]
            t, n = t.take(pa.array(by_length)), n[by_length]
            some = np.flatnonzero(n)
            h = np.concatenate((mix(w), pair_hash(*neighbours(w, n[some]))))
            doc = np.concatenate((np.repeat(some, n[some]), np.repeat(some, n[some] + 1))).astype("<u2")
            order = np.argsort(h, kind="stable")  # documents rise within words and within pairs
            h, doc = h[order], doc[order]
            del order
            sums = np.zeros(len(n), "<f8")
            hot_hash, hot_weight = known.value
            if len(hot_hash) and len(h):
                first = np.flatnonzero(np.concatenate((np.ones(1, bool), h[1:] != h[:-1])))
                at = np.minimum(np.searchsorted(hot_hash, h[first]), len(hot_hash) - 1)
                is_hot, many = hot_hash[at] == h[first], np.diff(np.append(first, len(h)))
                here = np.repeat(is_hot, many)
                sums += np.bincount(doc[here], np.repeat(hot_weight[at[is_hot]], many[is_hot]), len(n))
                h, doc = h[~here], doc[~here]
            info = {c: [t.column(c).to_pylist()] for c, _ in INFO}
            own = {"shard": [number & ((1 << bits) - 1)], "block": [number], "docs": [len(n)], **info, "lengths": [zipped(n.astype("<u4"))], "sums": [zipped(sums)]}
            yield pa.record_batch([pa.array(own.get(f.name, [None]), f.type) for f in SCHEMA], schema=SCHEMA)
            post = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
            times = np.diff(np.append(post, len(h))).astype("<u4")
            h, doc = h[post], doc[post]
            item = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
            items = np.diff(np.append(item, len(h))).astype("<u4")
            at = np.searchsorted(h[item] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            p = np.append(item, len(h))[at]
            codes = (h[item] << np.uint64(bits)) >> np.uint64(64 - CODE_BITS)
            out = []
            for s in np.flatnonzero(at[1:] > at[:-1]).tolist():
                a, b, x, y = at[s], at[s + 1], p[s], p[s + 1]
                out.append({"shard": s, "block": number, "docs": len(n), "codes": pack_codes(codes[a:b]), "items": planes(items[a:b]), "doc": planes(doc[x:y]), "times": planes(times[x:y])})
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                w, offsets = word_hashes(batch.column("text"))
                words.append(w & WORD)
                lengths.append(np.diff(offsets))
                held.append(batch.select([c for c, _ in INFO]))
                size, docs_held = size + len(w), docs_held + batch.num_rows
                if size >= BLOCK_TOKENS or docs_held > BLOCK_DOCS - 1024:
                    yield from block()
                    held, words, lengths, size, docs_held, number = [], [], [], 0, 0, number + 1
        if held:
            yield from block()

    return docs.mapInArrow(tidy(ask), SHARDED)


SUMS = [f.name for f in SCHEMA if f.name in ("block", "docs", "lengths", "sums", *(c for c, _ in INFO))]


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, its weights before the questions: sums of weights by block and document, and the blocks' own rows as they are."""
    schema = pa.schema([*(SCHEMA.field(c) for c in SUMS), ("at", pa.binary())])
    shard, codes, weights = None, np.zeros(0, np.uint64), np.zeros(0, "<f4")
    sums: dict[int, np.ndarray] = {}

    def done() -> pa.RecordBatch:
        out = []
        for block, x in sums.items():
            at = np.flatnonzero(x)
            few = 6 * len(at) < 4 * len(x)
            out.append({"block": block, "docs": len(x), "at": planes(at.astype("<u2")) if few else None, "sums": planes(x[at] if few else x)})
        sums.clear()
        return pa.RecordBatch.from_pylist(out, schema)

    for batch in batches:
        for i, row_shard in enumerate(batch.column("shard").to_pylist()):
            row = {c: batch.column(c)[i].as_py() for c in ("block", "docs", "codes")}
            if row["block"] is None:
                shard, codes, weights = row_shard, unpack_codes(row["codes"]), unplanes(batch.column("weights")[i].as_py(), "<f4")
            elif row["codes"] is None:
                own = pa.Table.from_batches([batch.slice(i, 1)]).select(SUMS)
                yield from own.append_column("at", pa.nulls(1, pa.binary())).to_batches()
            elif shard == row_shard and len(codes):
                asked = unpack_codes(row["codes"])
                at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
                w = np.where(codes[at] == asked, weights[at], np.float32(0))
                items, doc, times = (unplanes(batch.column(c)[i].as_py(), k) for c, k in (("items", "<u4"), ("doc", "<u2"), ("times", "<u4")))
                x = np.bincount(doc, np.repeat(w, items) * times, row["docs"]).astype("<f4")
                sums[row["block"]] = sums[row["block"]] + x if row["block"] in sums else x
                if sum(len(x) for x in sums.values()) * 4 > SUMS_BYTES:
                    yield done()
    if sums:
        yield done()


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of every document: doc_id, key (hash of doc_id and text), lang, trusted, held, n_words, perplexity.

    docs should be a table that was read or saved: a task that is run again has to meet its rows in the same order.
    Without trusted documents every word is unknown and all perplexities are 1. Saved.
    """
    docs = with_trust(docs, labels)
    weights, each, whole = model(docs.filter("trusted and not held"))
    hot, others = parted(weights, HOT_ITEMS)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (max(min(FEW_SHARDS, parts), -(-others.count() // SHARD_ITEMS)) - 1).bit_length())
    packed = saved(sharded(others, bits))
    discard(weights)
    release(packed)
    asked = packed.unionByName(questions(docs, bits, hot)).repartition(parts, "shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    columns = [c for c in SHARDED.split(", ") if c.split()[0] in SUMS]
    answers = asked.mapInArrow(tidy(answer), ", ".join([*columns, "at binary"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block, its own before the sums."""
        row, total = None, np.zeros(0)

        def done() -> pa.RecordBatch:
            lengths = unzipped(row["lengths"], "<u4").astype(np.int64)
            mean = (total + each * lengths + whole) / (lengths + 1)
            return pa.record_batch([*(pa.array(row[c], t) for c, t in INFO), pa.array(lengths), pa.array(np.exp(-mean), mask=lengths == 0)], names=[*(c for c, _ in INFO), "n_words", "perplexity"])

        for batch in batches:
            for part in batch.to_pylist():
                if part["lengths"] is not None:
                    if row is not None:
                        yield done()
                    row, total = part, unzipped(part["sums"], "<f8").copy()
                elif part["at"] is None:
                    total += unplanes(part["sums"], "<f4")
                else:
                    total[unplanes(part["at"], "<u2")] += unplanes(part["sums"], "<f4")
        if row is not None:
            yield done()

    scored = answers.repartition(parts, "block").sortWithinPartitions("block", F.col("lengths").isNull()).mapInArrow(tidy(score), "doc_id long, key long, lang string, trusted boolean, held boolean, n_words long, perplexity double")
    out = saved(scored)
    discard(packed)
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, key, lang, n_words, perplexity, threshold, kept.

    A language's threshold is the `quantile` of log perplexity over its held-out trusted documents, and `slack` beyond;
    a language without any (null too) has that of all languages. A document of n words is compared by the mean of its
    log perplexity, with weight n, and its language's median, with weight PRIOR_WORDS, so that a few rare words don't
    condemn a short text. Kept are documents at or under the threshold. A document without
    words (null or empty text) has no perplexity and isn't kept. Without trusted documents there is no threshold and all
    documents with words are kept. Repeated rows have a row each; other columns are ignored; an empty table gives no rows.
    """
    scored = perplexities(docs, labels)
    held = scored.filter("trusted and held and perplexity is not null").withColumn("log", F.log("perplexity"))
    middle = saved(held.groupBy("lang").agg(F.percentile_approx("log", 0.5, 10_000).alias("own_middle")).filter("lang is not null"))
    all_middle = held.agg(F.percentile_approx("log", 0.5, 10_000)).head()[0]

    def drawn(rows: DataFrame) -> DataFrame:
        centre = F.coalesce("own_middle", F.lit(all_middle).cast("double"), F.log("perplexity"))
        return rows.join(middle, "lang", "left").withColumn("drawn", (F.log("perplexity") * F.col("n_words") + centre * PRIOR_WORDS) / (F.col("n_words") + PRIOR_WORDS)).drop("own_middle")

    least = F.percentile_approx("drawn", quantile, 10_000) + slack
    held = drawn(held)
    by_lang = saved(held.groupBy("lang").agg(least.alias("own")).filter("lang is not null"))
    overall = held.agg(least.alias("x")).head()[0]
    limit = F.exp(F.coalesce("own", F.lit(overall).cast("double")))
    out = drawn(scored).join(by_lang, "lang", "left").withColumn("threshold", limit)
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.exp("drawn") <= F.col("threshold"), F.lit(True))
    return reading(out.select("doc_id", "key", "lang", "n_words", "perplexity", "threshold", kept.alias("kept")), scored, middle, by_lang)
