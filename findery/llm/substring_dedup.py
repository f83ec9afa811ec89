"""Removal of repeated passages by sliding spans of sentences (operator 10).

Each text is cut into sentences (also at clause marks, where a capital follows a lower-case word, as passages are
pasted into the middle of sentences, and within run-ons). From every sentence on, the shortest run of at least `SENTENCES` sentences and
`WORDS` words is hashed. A first pass counts 64-bit hashes alone; a second gives the places of the few that repeat, with
32 bits more, and the first place of each. All sentences under a span that isn't the first of its hash go. Hot hashes
are dealt over salts, and each pass leaves only its small result in the shared folder.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findery.llm.common import BROADCAST_BYTES, discard, hot_keys, mix, reading, replicated, salted, saved, tidy

SENTENCES = 3
WORDS = 20  # three sentences of some length: a single licence line or heading that many documents share is no passage
LONG = 25
WORD = re.compile(r"\s*\S+\s*")
#: Ends a sentence: white space after a mark, or that is a line break, or before a capital that follows a lower-case letter.
BREAK = re.compile(r"(\s(?:(?<=[.!?;:,]\s)|(?<=\n)|(?<=[a-zß-öø-ÿ]\s)(?=[A-ZÀ-ÖØ-Þ]))\s*)")


def cut_long(sentence: str) -> list[str]:
    """A run-on sentence cut after words picked by their own hash, so that equal passages are cut alike wherever they stand, and after LONG words at the latest."""
    out, held = [], []
    for word in WORD.findall(sentence):
        held.append(word)
        if len(held) >= LONG or zlib.crc32(word.strip().lower().encode()) % 6 == 0:
            out.append("".join(held))
            held = []
    return [*out, "".join(held)] if held else out


def sentences(text: str) -> tuple[list[str], list[str]]:
    """The sentences of a text and what stands after each, which together are the text."""
    parts = BREAK.split(text)
    own, seps = parts[::2], [*parts[1::2], ""]
    if all(p.count(" ") < LONG for p in own):
        return own, seps
    cut, after = [], []
    for p, sep in zip(own, seps):
        pieces = p.count(" ") >= LONG and cut_long(p) or [p]
        cut += [x.rstrip() for x in pieces]
        after += [x[len(x.rstrip()) :] for x in pieces[:-1]] + [pieces[-1][len(pieces[-1].rstrip()) :] + sep]
    return cut, after


def spans(counts: np.ndarray, least: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and end of the shortest run of `least` sentences and `words` words from each sentence on, where there is one. counts: words by sentence."""
    upto = np.concatenate(([0], np.cumsum(counts)))
    first = np.arange(len(counts))
    end = np.maximum(first + least, np.searchsorted(upto, upto[:-1] + words))
    fits = end <= len(counts)
    return first[fits], end[fits]


POWER = 0x9E3779B97F4A7C15
INVERSE = pow(POWER, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(each: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of every run from those of its sentences, wherever it stands."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * powers(POWER, len(each)), dtype=np.uint64)))
    return mix((upto[end] - upto[first]) * powers(INVERSE, len(each))[first] + (end - first).astype(np.uint64))


def span_hashes(docs: DataFrame, least: int, words: int, places: bool) -> DataFrame:
    """(hash) of every span of docs (doc_id, key, text); with `places` also check (32 independent bits), doc_id, key, first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                out: list[tuple] = []
                for at, text in enumerate(batch.column("text").to_pylist()):
                    if not text:
                        continue
                    parts = [p.lower().split() for p in sentences(text)[0]]
                    first, end = spans(np.fromiter(map(len, parts), np.int64, len(parts)), least, words)
                    if len(first):
                        each = np.frombuffer(b"".join([digest(" ".join(w)) for w in parts]), "<u8").reshape(-1, 2)
                        out.append((run_hashes(each[:, 0], first, end), *((run_hashes(each[:, 1], first, end), np.full(len(first), at), first) if places else ())))
                if out:
                    hashes, *rest = map(np.concatenate, zip(*out))
                    columns = {"hash": pa.array(hashes.view(np.int64))}
                    if places:
                        row = pa.array(rest[1])
                        columns |= {"check": pa.array(rest[0].view(np.int64).astype(np.int32)), "doc_id": batch.column("doc_id").take(row), "key": batch.column("key").take(row), "first": pa.array(rest[2].astype(np.int32))}
                    yield from pa.table(columns).to_batches(max_chunksize=100_000)

    return docs.select("doc_id", "key", "text").mapInArrow(tidy(find), "hash long" + ", check int, doc_id long, key long, first int" * places)


def later_places(docs: DataFrame, least: int, words: int) -> DataFrame:
    """(doc_id, key, runs): where repeated spans of docs (doc_id, key, text) begin, but for the first of each. Saved.

    Runs are (from, to) of neighbouring sentences: a copied passage, or a whole copy, is one of them, whatever its length.
    """
    repeated = saved(span_hashes(docs, least, words, False).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot, salts = hot_keys(repeated, "hash")
    here = salted(span_hashes(docs, least, words, True), "hash", "key", hot, salts)
    here = saved(here.join(replicated(repeated, "hash", hot, salts).select("hash", "__salt"), ["hash", "__salt"], "left_semi"))
    place = F.struct("doc_id", "key", "first")
    starts = here.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")).filter("n > 1")
    starts = starts.select("hash", "check", *(F.col(f"place.{c}").alias(f"{c}_0") for c in ("doc_id", "key", "first")))
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_0")) & (F.col("key") == F.col("key_0")) & (F.col("first") == F.col("first_0"))
    later = here.join(replicated(starts, "hash", hot, salts), ["hash", "check", "__salt"]).filter(~same)
    firsts = later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("first")).alias("firsts"))
    before, after = F.concat(F.array(F.lit(-2)), "firsts"), F.concat(F.slice("firsts", 2, F.size("firsts")), F.array(F.lit(-2)))
    own = F.arrays_zip(F.col("firsts").alias("x"), F.slice(before, 1, F.size("firsts")).alias("before"), after.alias("after"))
    marked = firsts.select("doc_id", "key", own.alias("own"))
    begin = F.transform(F.filter("own", lambda o: o["x"] != o["before"] + 1), lambda o: o["x"])
    end = F.transform(F.filter("own", lambda o: o["after"] != o["x"] + 1), lambda o: o["x"])
    out = saved(marked.select("doc_id", "key", F.arrays_zip(begin.alias("from"), end.alias("to")).alias("runs")))
    discard(repeated, here)
    return out


def remove_repeated_spans(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """All documents with their columns; `text` loses every sentence under a non-first repeated span; adds n_removed.

    First is the occurrence with the smallest (doc_id, place), null ids before others; repeats within a document count
    too. Rows equal in doc_id and text are one document and come out alike. A null text stays null and an empty one
    empty; both have no spans, as have texts of fewer than `least` sentences or `words` words. A document may lose all its
    text and keeps its row. A column named n_removed is replaced; others stay, whatever their names. An empty table gives
    no rows.
    """
    columns = [c for c in docs.columns if c != "n_removed"]
    own = {c: "text" if c == "text" else f"__c{i}" for i, c in enumerate(columns)}
    renamed = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), *(docs[f"`{c}`"].alias(a) for c, a in own.items()))
    later = later_places(renamed, least, words)
    gone = later.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "runs")
    if 8 * (later.agg(F.sum(3 * F.size("runs") + 6)).head()[0] or 0) <= BROADCAST_BYTES:  # then texts needn't be shuffled
        gone = F.broadcast(gone)
    joined = renamed.join(gone, (renamed.key == F.col("__key")) & renamed.doc_id.eqNullSafe(F.col("__id")), "left").select(*own.values(), "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            texts, counts = [], []
            for text, runs in zip(t.column("text").to_pylist(), t.column("runs").to_pylist()):
                n = 0
                if runs:
                    parts, seps = sentences(text)
                    of = dict(zip(*(x.tolist() for x in spans(np.array([len(p.split()) for p in parts]), least, words))))
                    under = np.zeros(len(parts) + 1, np.int64)
                    for r in runs:  # the spans of neighbouring sentences overlap, and their ends don't fall
                        under[r["from"]] += 1
                        under[of[r["to"]]] -= 1
                    under = np.cumsum(under)[:-1] > 0
                    n = int(under.sum())
                    text = "".join(p + s for p, s, u in zip(parts, seps, under) if not u).rstrip()
                texts.append(text)
                counts.append(n)
            out = t.drop_columns(["runs"])
            out = out.set_column(out.column_names.index("text"), "text", pa.array(texts, pa.string())).append_column("n_removed", pa.array(counts, pa.int64()))
            yield from out.to_batches()

    schema = T.StructType([*(T.StructField(a, docs.schema[c].dataType) for c, a in own.items()), T.StructField("n_removed", T.LongType())])
    return reading(joined.mapInArrow(tidy(cut), schema).select(*(F.col(a).alias(c) for c, a in own.items()), "n_removed"), later)
