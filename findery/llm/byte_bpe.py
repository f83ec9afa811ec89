"""Byte-level BPE by prefix dynamic programming (operator 3).

For every prefix of a byte string exactly one token can be the last of its encoding. `last[i]` holds it for the first
i bytes; a token t that ends at i is the right one if the prefix before t ends in a token p such that p and t, put
side by side, are not merged across or otherwise. The ids are read back from the end. Appending bytes only extends
`last`; an edit keeps all entries before it. `fits` decides a pair by undoing both tokens' merges along their border.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = 1 << 62
KEPT = 1_000_000
STEM = 6


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1 and (two := self.parts(t, i)):
                self.halves[i] = two
                self.pairs[two] = i
        # a token that merging doesn't rebuild from its own bytes is never part of an encoding
        self.ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i in self.halves}
        self.fit: dict[int, bool] = {}
        self.stems: dict[bytes, list[int]] = {}  # of first bytes, to which the rest is appended

    def parts(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens of which merging makes this one in its last step; None if it makes another or none."""
        out = [self.ranks[token[k : k + 1]] for k in range(len(token))]
        while len(out) > 2:
            best = min(((self.pairs.get((a, b), NONE), k) for k, (a, b) in enumerate(zip(out, out[1:]))), default=(NONE, 0))
            if best[0] >= rank:
                return None
            out[best[1] : best[1] + 2] = [best[0]]
        return (out[0], out[1]) if len(out) == 2 else None

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of left's and right's bytes together is these two tokens.

        Goes back in time from both whole tokens: the later merge of the two at the border is undone, and before each
        step no merge over the border may be due earlier than the merges that made what stands there.
        """
        limit, halves, pairs = NONE, self.halves, self.pairs
        a, b = left, right
        while True:
            if (c := pairs.get((a, b), NONE)) < limit:
                return False
            ra = a if a in halves else -1
            rb = b if b in halves else -1
            if ra < 0 and rb < 0:
                return True
            # the merge that happened last is undone; of equal ranks the right one is later
            if ra > rb:
                limit, a = ra, halves[a][1]
                # merges over the border at the same rank would come after the left one
                if (c := pairs.get((a, b), NONE)) < limit:
                    return False
            else:
                limit, b = rb + 1, halves[b][0]
                if (c := pairs.get((a, b), NONE)) < limit:
                    return False

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """`last` for all prefixes of data, given it for the first len(last) - 1 bytes (last[0] is -1). Changes and returns `last`.

        Short tokens are tried first; as only one fits, the first that does ends the search.
        """
        rank, fit = self.ranks.get, self.fit
        known = fit.get
        for j in range(len(last), len(data) + 1):
            for i in range(j - 1, -1, -1):
                if (r := rank(data[i:j])) is None:
                    continue
                if (p := last[i]) < 0:
                    break
                key = p << 32 | r
                if (ok := known(key)) is None:
                    if len(fit) > 4 * KEPT:
                        fit.clear()
                    ok = fit[key] = self.fits(p, r)
                if ok:
                    break
            else:
                raise ValueError("a prefix has no encoding")
            last.append(r)
        return last

    def read(self, data: bytes, last: list[int]) -> list[int]:
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        if len(data) <= STEM:
            return self.read(data, self.extend(data, [-1]))
        if (begun := self.stems.get(stem := data[:STEM])) is None:
            if len(self.stems) > KEPT // 4:
                self.stems.clear()
            begun = self.stems[stem] = self.extend(stem, [-1])
        return self.read(data, self.extend(data, begun[:]))

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The longer string and its `last`; what was known stays."""
        return data + more, self.extend(data + more, last)

    def replace(self, data: bytes, last: list[int], at: int, gone: int, new: bytes) -> tuple[bytes, list[int]]:
        """After an edit that replaces `gone` bytes at `at`: entries before it are kept, the rest is computed again."""
        edited = data[:at] + new + data[at + gone :]
        return edited, self.extend(edited, last[: at + 1])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Pieces(dict):
    """Decimal ids of one pre-token, joined by spaces, and what they decode to; and of whole chunks between spaces.

    A chunk is kept under its text. Chunks hold no white space, so under public_tokenizers.PATTERN every pre-token lies
    within one, with the space before it. Under any other pattern texts are split as a whole.
    """

    def __init__(self, path: str, pattern: str):
        self.bpe = PrefixBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))})
        self.split = regex.compile(pattern).findall
        self.gap = regex.compile(r"\s").search
        self.by_chunk = pattern == public_tokenizers.PATTERN

    def ids(self, text: str) -> tuple[bytes, int, bytes]:
        ids = [i for piece in self.split(text) for i in self.bpe.encode(piece.encode())]
        return " ".join(map(str, ids)).encode(), len(ids), self.bpe.decode(ids)

    def __missing__(self, chunk: str) -> tuple[bytes, int, bytes]:
        if len(self) >= KEPT:
            self.clear()
        if self.gap(chunk[1:]) or chunk in ("", " "):
            raise KeyError(chunk)
        body = chunk[:-1]
        if chunk[-1] in ",." and body[1:].isalpha() and body[1:].isascii():  # a word and a mark: the word may be known
            a, b = self[body], self.ids(chunk[-1])
            found = (a[0] + b" " + b[0], a[1] + b[1], a[2] + b[2])
        else:
            found = self.ids(chunk)
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, int, bytes]:
        """Fast where lines hold words between single spaces; any other text is split as a whole."""
        if not self.by_chunk:
            return self.ids(text)
        try:
            parts = []
            newline = None
            for k, line in enumerate(text.split("\n")):
                if k:
                    newline = newline or self.ids("\n")
                    parts.append(newline)
                words = line.split(" ")
                if self.gap(words[0]):
                    raise KeyError(words[0])
                parts.append(self[words[0]])
                parts.extend([self[" " + w] for w in words[1:]])
            return b" ".join([p[0] for p in parts]), sum([p[1] for p in parts]), b"".join([p[2] for p in parts])
        except KeyError:
            return self.ids(text)


@lru_cache(maxsize=2)
def pieces(path: str, pattern: str) -> Pieces:
    return Pieces(path, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text. Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids and the decoded text.

    Null text counts as empty: no ids. Null and repeated doc_ids keep their rows; other columns are ignored. Runs in
    the scan's own partitions; texts of any length are taken whole.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(ranks, pattern)
        for batch in batches:
            n, shas, backs, ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                a, count, back = known.encode(text) if text else (b"", 0, b"")
                n.append(count)
                shas.append(hashlib.sha256(a).hexdigest())
                backs.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids.append([*map(int, a.split())])
                    texts.append(back.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], [*names, "ids", "decoded"]
            yield pa.record_batch(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
