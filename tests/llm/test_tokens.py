import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from findery.llm import byte_bpe, packing
from findery.llm.word_bpe import word_bpe
from tokenizers import Tokenizer

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "The and thinnt, of re.", "naïve Café's ΣΣ ﬁ İ ß 😀 ٣Ⅷ", " \n\t ", "a\x1cb \x85c\u2003d", "x" * 5000, "thinking about it. " * 3000, "it's we'll I'd  two  spaces\n\nand lines \n", "ÀÉ e\u0301 \u0301 a", "a b a b"]
ALPHABET = "abcxyzÉé 's't12٣ \n\t\xa0好😀.,  ΣßﬁK\u0301\u200d"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "e", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, sequence_id int")


def fuzz(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_word_ids_equal_the_library():
    t = Tokenizer.from_file(WORDS)
    own = word_bpe(WORDS)
    for text in [x for x in TEXTS if x] + fuzz(20_000, 1):
        assert own.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_word_ids_of_every_word_in_the_vocabulary():
    t = Tokenizer.from_file(WORDS)
    words = [w.removesuffix("</w>") for w in t.get_vocab() if w.endswith("</w>") and w.isascii()]
    own = word_bpe(WORDS)
    for w, e in zip(words, t.encode_batch_fast(words, add_special_tokens=False)):
        assert own.encode(w) == np.array(e.ids, "<u4").tobytes(), w


def brute_best_fit(lengths, capacity):
    rooms = []
    out = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            i = len(rooms)
            rooms.append(capacity - n)
        out.append(i)
    return rooms


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    lengths = np.random.default_rng(seed).integers(1, 65, 300)
    sequence, offset, used = packing.best_fit_decreasing(lengths, 64)
    rooms = brute_best_fit(lengths.tolist(), 64)
    assert used == len(rooms)
    filled = np.bincount(sequence, lengths, used)
    assert sorted(64 - filled) == sorted(rooms)
    for s in range(used):
        at = np.flatnonzero(sequence == s)
        at = at[np.argsort(offset[at])]
        assert (offset[at] == np.r_[0, np.cumsum(lengths[at])[:-1]]).all()


@pytest.mark.parametrize("lengths", [[2501] * 400, [4096, 2049, 2049], [33] * 1000, [1], [4000] * 100 + [50], *([np.random.default_rng(s).integers(1, 4097, 500).tolist()] for s in range(3))])
def test_open_room_is_filled_with_cut_pieces(lengths):
    lengths = np.array(lengths if isinstance(lengths[0], int) else lengths[0])
    best = packing.best_fit_decreasing(lengths, 4096)
    piece, at, n, sequence, offset, used = packing.filled(lengths, *best, 4096)
    assert used <= best[2] and (used == best[2] or used * 4096 * 0.98 < n.sum() + 4096)
    assert used * 4096 * 0.98 <= n.sum() + 4096  # at most 2 % and one sequence open
    for i in range(len(lengths)):
        own = sorted(zip(at[piece == i], n[piece == i]))
        assert sum(k for _, k in own) == lengths[i] and all(a + k == b for (a, k), (b, _) in zip(own, own[1:])) and own[0][0] == 0
    for s in range(used):
        own = sorted(zip(offset[sequence == s], n[sequence == s]))
        assert own[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 4096


def expected(text):
    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("window", [1 << 23, 500])
def test_pack_keeps_every_id_once(spark, window):
    docs = frame(spark, [*TEXTS, TEXTS[2]]).repartition(2)
    pieces = packing.pack_documents(docs, WORDS, capacity=256, window_tokens=window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert len(by_doc) == len(TEXTS) + 1
    for i, text in enumerate([*TEXTS, TEXTS[2]]):
        ids = b"".join(p.ids for p in sorted(by_doc[i], key=lambda p: p.start))
        assert np.frombuffer(ids, "<u4").tolist() == expected(text)
        assert all(p.doc_tokens == len(ids) // 4 for p in by_doc[i])
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        assert at <= 256
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in packing.with_crc(packing.pack_documents(docs, WORDS, 256)).collect()}
    assert all(crc[p.doc_id, p.start] == zlib.crc32(p.ids) for p in pieces)


def test_token_matrix_round_trip(spark, tmp_path):
    docs = frame(spark, TEXTS)
    matrix = packing.token_matrix(docs, WORDS, capacity=256)
    packing.write_token_matrix(matrix, str(tmp_path / "m"))
    got = defaultdict(list)
    for r in packing.read_token_matrix(spark, str(tmp_path / "m")).collect():
        got[r.doc_id].append((r.start, r.ids))
    for i, text in enumerate(TEXTS):
        assert [x for _, ids in sorted(got[i]) for x in ids] == expected(text)
    for r in matrix.collect():
        ids, position = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(position) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            assert (position[a:b] == np.arange(b - a)).all()


def test_empty_tables(spark):
    none = frame(spark, TEXTS).limit(0)
    assert packing.pack_documents(none, WORDS).count() == packing.token_matrix(none, WORDS).count() == byte_bpe.encode_documents(none, RANKS, P.PATTERN).count() == 0


def libraries():
    own = byte_bpe.pieces(RANKS, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.bpe.ranks, special_tokens={})


def test_byte_ids_equal_the_library():
    own, library = libraries()
    for text in [x for x in TEXTS if x] + fuzz(20_000, 2):
        ids, n, back = own.encode(text)
        want = library.encode_ordinary(text)
        assert ids.decode() == " ".join(map(str, want)) and n == len(want) and back == text.encode()


def test_byte_strings_that_are_not_text():
    own, library = libraries()
    r = random.Random(3)
    for _ in range(5000):
        data = bytes(r.choice(b"\x80\xc3\xa9 aAthe\xe4\xff0ab") for _ in range(r.randint(1, 20)))
        assert own.bpe.encode(data) == library._encode_single_piece(data)


def test_appends_and_edits_reuse_prefixes():
    bpe = libraries()[0].bpe
    data, last = b" rethink", bpe.extend(b" rethink", [-1])
    longer, grown = bpe.append(data, last[:], b"ingly")
    assert bpe.read(longer, grown) == bpe.encode(longer) and grown[: len(last)] == last
    edited, again = bpe.replace(longer, grown, 4, 2, b"XYZ")
    assert edited == b" retXYZ" + longer[6:] and bpe.read(edited, again) == bpe.encode(edited)
    assert bpe.decode(bpe.encode(edited)) == edited


def test_encode_documents(spark):
    import hashlib

    library = libraries()[1]
    rows = {r.doc_id: r for r in byte_bpe.encode_documents(frame(spark, TEXTS), RANKS, P.PATTERN, with_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        want = library.encode_ordinary(text or "")
        assert rows[i].ids == want and rows[i].decoded == (text or "") and rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
