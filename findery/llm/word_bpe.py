"""Token ids of the lower-casing word-BPE vocabulary, with a bounded cache of white-space chunks.

The ids equal those of the tokenizers library (tests compare them). A chunk between white space is split into
pre-tokens and merged once, then kept; texts with the few control characters on whose white-space nature the
libraries differ go to the tokenizers library itself.

Merging is by rank. A merge list and a rank table give the same ids if each token, encoded alone, gives itself:
merges inside a span that no merge has crossed run as they do in isolation, so two neighbours that spell a token
are the pair of its merge. Tokens that fail this can never arise and are left out of the table.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache

import numpy as np
import regex

#: The vocabulary's pre-token pattern.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = b"\xff"  # stands for the end-of-word suffix; never part of UTF-8
KEPT_CHUNKS = 150_000
KEPT_BYTES = 15_000_000
ODD = re.compile("[\x1c-\x1f\x85᠎​﻿]")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe(dict):
    """Maps a chunk without white space to its ids, as 32-bit bytes (little-endian, as all machines that Spark supports here)."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        to_byte, suffix = _byte_of(), "</w>"
        ranks: dict[bytes, int] = {}
        for token, i in vocab.items():
            body, end = (token[: -len(suffix)], END) if token.endswith(suffix) and token != suffix else (token, b"")
            if all(c in to_byte for c in body):
                ranks[bytes(to_byte[c] for c in body) + end] = i
        self.vocabulary = len(vocab)
        ranks = {t: i for t, i in ranks.items() if t not in (END, END * 2)}  # that byte can't occur
        if any(i < 512 for t, i in ranks.items() if len(t.removesuffix(END)) > 1) or any(i < 256 for t, i in ranks.items() if t.endswith(END)):
            raise ValueError("the vocabulary doesn't begin with the bytes and then the bytes that end a word")
        ranks[END] = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("words", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.encoding._core_bpe.encode_single_piece
        self.split = regex.compile(PRE_TOKENS).findall
        self.size = 0

    @cached_property
    def whole(self):
        """The tokenizers library's own; loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def merged(self, chunk: str) -> bytes:
        if chunk.isascii():
            text = chunk.lower()
            if text.isalpha():
                return array("I", self.piece(text.encode() + END)).tobytes()
            if text[:-1].isalpha() and not text[-1].isalnum():
                return self[text[:-1]] + array("I", self.piece(text[-1:].encode() + END)).tobytes()
        else:
            text = unicodedata.normalize("NFC", chunk)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return b"".join(array("I", self.piece(p.encode() + END)).tobytes() for p in self.split(text))

    def __missing__(self, chunk: str) -> bytes:
        ids = self.merged(chunk)
        if self.size > KEPT_BYTES or len(self) >= KEPT_CHUNKS:
            self.forget()
        if len(chunk) <= 64:
            self.size += len(chunk) + len(ids)
            self[chunk] = ids
        return ids

    def forget(self) -> None:
        """Empties the cache of chunks; the vocabulary stays."""
        self.clear()
        self.size = 0

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text.isascii():
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
