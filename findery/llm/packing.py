"""Best-fit-decreasing packing of token sequences into windows of a fixed capacity (operators 1 and 9).

Each task packs what it reads: pieces are gathered up to `window_tokens` ids, sorted by falling length, and each goes
to the open sequence whose room is the tightest that fits. A segment tree over remaining capacities finds it in
log2(capacity) steps. Where that leaves more than OPEN of a window's room (as with texts a little over half a sequence),
the emptiest sequences are dissolved and their pieces cut to fill the others. So a window leaves open at most OPEN and
one sequence, and nothing is shuffled; memory is bounded by the window. A lost task is run again alone and gives its
partition the same sequence numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.common import tidy
from findery.llm.word_bpe import word_bpe

CAPACITY = 4096
EOS = 2
WINDOW_TOKENS = 1 << 20
OPEN = 0.02
SEQUENCES_PER_PARTITION = 1 << 33


class RoomTree:
    """Open sequences by remaining room. Node i counts the sequences below it; leaf `width + r` those with room r."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        i = self.width + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, sequence) with the least room >= need, or None."""
        count, i = self.count, self.width + need
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if count[2 * i] else 2 * i + 1
        return self.out(i)

    def largest(self) -> tuple[int, int] | None:
        """Removes and returns (room, sequence) with the most room, or None where no room is left."""
        count, i = self.count, 1
        if not count[1]:
            return None
        while i < self.width:
            i = 2 * i + 1 if count[2 * i + 1] else 2 * i
        return self.out(i) if i > self.width else None

    def out(self, i: int) -> tuple[int, int]:
        room = i - self.width
        sequence = self.open[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, sequence


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece (each at most capacity long), and the number of sequences. Ties: earlier piece first."""
    sequence, offset, tree, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), RoomTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        if found := tree.take(need):
            room, at = found
        else:
            room, at, used = capacity, used, used + 1
        sequence[i], offset[i] = at, capacity - room
        if room > need:
            tree.add(room - need, at)
    return sequence, offset, used


def filled(lengths: np.ndarray, sequence: np.ndarray, offset: np.ndarray, used: int, capacity: int, open_share: float = OPEN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The same placing with at most `open_share` and a sequence left open: (piece, start in it, length, sequence, offset) of each part, and the number of sequences.

    The emptiest sequences beyond those needed are dissolved; each of their pieces goes to the tightest room that takes
    it whole, or else in parts to the largest rooms.
    """
    tokens = int(lengths.sum())
    keep = -(-tokens // max(1, int(capacity * (1 - open_share))))
    piece = np.arange(len(lengths))
    if used <= keep:
        return piece, np.zeros(len(lengths), np.int64), lengths, sequence, offset, used
    load = np.bincount(sequence, lengths, used).astype(np.int64)
    order = np.argsort(-load, kind="stable")
    number = np.full(used, -1)
    number[order[:keep]] = np.arange(keep)
    stays = number[sequence] >= 0
    parts = list(zip(piece[stays].tolist(), [0] * int(stays.sum()), lengths[stays].tolist(), number[sequence[stays]].tolist(), offset[stays].tolist()))
    tree = RoomTree(capacity)
    for i, n in enumerate(load[order[:keep]].tolist()):
        if n < capacity:
            tree.add(capacity - n, i)
    for i in piece[~stays].tolist():
        at, left = 0, int(lengths[i])
        while left:
            room, to = tree.take(left) or tree.largest()
            n = min(room, left)
            parts.append((i, at, n, to, capacity - room))
            at, left = at + n, left - n
            if room > n:
                tree.add(room - n, to)
    return *(np.array(c, np.int64) for c in zip(*parts)), keep


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
MATRIX = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])


class Window:
    """Pieces gathered so far. Overlong documents are cut into full sequences and a rest."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.clear()

    def clear(self) -> None:
        self.doc, self.start, self.ids, self.total, self.tokens = [], [], [], [], 0

    def add(self, doc: int | None, ids: bytes) -> None:
        n, step = len(ids) // 4, 4 * self.capacity
        for a in range(0, len(ids), step):
            self.doc.append(doc)
            self.start.append(a // 4)
            self.ids.append(ids[a : a + step])
            self.total.append(n)
        self.tokens += n

    def packed(self) -> pa.Table:
        lengths = np.array([len(x) // 4 for x in self.ids], np.int64)
        piece, at, n, sequence, offset, used = filled(lengths, *best_fit_decreasing(lengths, self.capacity), self.capacity)
        ids = [self.ids[i] if k == lengths[i] else self.ids[i][4 * a : 4 * (a + k)] for i, a, k in zip(piece.tolist(), at.tolist(), n.tolist())]
        doc, start, total = ([x[i] for i in piece.tolist()] for x in (self.doc, self.start, self.total))
        out = pa.table([pa.array(doc, pa.int64()), pa.array(np.array(start, np.int64) + at), pa.array(n), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(sequence + self.next), pa.array(offset)], schema=PIECES)
        self.next += used
        self.clear()
        return out


def packed_windows(batches: Iterator[pa.RecordBatch], encode: Callable[[str | None], bytes], capacity: int, eos: int, window_tokens: int) -> Iterator[pa.Table]:
    end = np.array([eos], "<u4").tobytes()
    window = Window(capacity, TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION)
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            window.add(doc, encode(text) + end)
            if window.tokens >= window_tokens:
                yield window.packed()
    if window.doc:
        yield window.packed()


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, eos: int = EOS, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Pieces of all documents (doc_id, text; other columns are ignored), placed in sequences of at most `capacity` ids.

    Each document is its text's ids and then `eos`; a null or empty text is `eos` alone, an empty table gives no rows, a
    repeated or null doc_id is packed for each of its rows. `ids` holds little-endian unsigned 32-bit ids, `start` counts
    the document's ids before the piece, `offset` the sequence's. Ties are broken by the order of rows in a partition.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in packed_windows(batches, word_bpe(tokenizer).encode, capacity, eos, window_tokens):
            yield from t.to_batches(max_chunksize=8192)
        word_bpe(tokenizer).forget()

    return docs.select("doc_id", "text").mapInArrow(tidy(pack), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def token_matrix(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, eos: int = EOS, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per packed sequence: its row of the id matrix, cumulative segment lengths and position resets.

    `input_ids` is `capacity` little-endian unsigned 16-bit ids (32-bit where the vocabulary needs them), padded with
    `eos` after `n_tokens`; `cu_seqlens` starts with 0 and ends with n_tokens; `position_ids` (unsigned 16-bit) begins at
    0 in every segment and is 0 in the padding. Segment k is ids `starts[k]` and on of document `doc_ids[k]`, so documents
    are recovered whole. Nulls, empty texts and repeated rows are as in pack_documents.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if word_bpe(tokenizer).vocabulary <= 1 << 16 else "<u4"
        for t in packed_windows(batches, word_bpe(tokenizer).encode, capacity, eos, window_tokens):
            t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            sequence, length = t.column("sequence_id").to_numpy(), t.column("length").to_numpy()
            ids = t.column("ids").to_pylist()
            first = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
            bounds = np.r_[first, len(sequence)]
            docs, starts = t.column("doc_id").to_pylist(), t.column("start").to_pylist()
            out: list[list] = [[] for _ in MATRIX]
            for a, b in zip(bounds[:-1], bounds[1:]):
                cu = np.r_[0, np.cumsum(length[a:b])].astype(np.int32)
                row, position = np.full(capacity, eos, kind), np.zeros(capacity, "<u2" if capacity <= 1 << 16 else "<u4")
                row[: cu[-1]] = np.frombuffer(b"".join(ids[a:b]), "<u4")
                position[: cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], length[a:b])
                for column, v in zip(out, (int(sequence[a]), int(cu[-1]), row.tobytes(), cu, position.tobytes(), docs[a:b], starts[a:b])):
                    column.append(v)
                if len(out[0]) == 512:
                    yield pa.record_batch(out, schema=MATRIX)
                    out = [[] for _ in MATRIX]
            if out[0]:
                yield pa.record_batch(out, schema=MATRIX)
        word_bpe(tokenizer).forget()

    return docs.select("doc_id", "text").mapInArrow(tidy(rows), "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>")


def write_token_matrix(matrix: DataFrame, path: str) -> None:
    """Binary sink: Parquet files of matrix rows, committed by Spark's writer, so that a lost task leaves no half file. No rows, an empty table."""
    matrix.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_token_matrix(spark, path: str) -> DataFrame:
    """Segments of a written matrix, with their ids: (doc_id, start, ids). Of an empty table none."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["input_ids"], "<u2" if len(row["input_ids"]) == len(row["position_ids"]) else "<u4")
                cu = row["cu_seqlens"]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(row["starts"], pa.int64()), pa.array([ids[a:b].tolist() for a, b in zip(cu[:-1], cu[1:])], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return spark.read.parquet(path).mapInArrow(tidy(cut), "doc_id long, start long, ids array<int>")


def with_crc(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


