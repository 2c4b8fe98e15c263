import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe, staging


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.default_path())


TEXTS = ["", " ", "Hello, World!  it's we'll 'S 12 3456", "Straße Ünïcödé ﬁ İstanbul ΣΑΣ日本語 👩‍👩‍👧 é", "<|endoftext|>a<|startoftext|> x<|endoftext|", " a b\x85c\x1cd\r\ne\x0bf", "x" * 5000, "ab" * 3000 + "!" * 700, "\u0000 a\u0000b"]


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    n, decimal, plain = own.rendered(text)
    assert (n, decimal) == (len(ids), " ".join(map(str, ids)))
    assert plain == library.decode(ids, skip_special_tokens=False) == own.decode(ids)


def test_segment_tree_merges_like_a_scan(own):
    draw = random.Random(3)
    symbols = list(range(256))
    for n in (1, 2, 33, 34, 35, 400, 3000):
        ids = [own.inner[draw.choice(symbols[97:110])] for _ in range(n)]
        slow = list(ids)
        while True:
            ranked = [(own.merges[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(slow, slow[1:])) if a << 32 | b in own.merges]
            if not ranked:
                break
            _, i = min(ranked)
            slow[i : i + 2] = [own.merges[slow[i] << 32 | slow[i + 1]][1]]
        assert own.merged(list(ids)) == slow


def test_query_against_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in staging.table(spark, sf, "documents").collect()}
    got = bpe.op10_bpe_round_trip(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, none, library):
    path = bpe.default_path()
    ids = {(r["doc_id"], tuple(r["ids"])) for r in bpe.encoded(odd, path).collect()}
    assert ids == {(r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()}
    texts = {(r["doc_id"], r["text"]) for r in bpe.decoded(bpe.encoded(odd, path), path).collect()}
    assert texts == {(i, library.decode(list(x), skip_special_tokens=False)) for i, x in ids}
    assert bpe.digests(odd, path).count() == odd.count() and bpe.digests(none, path).count() == 0


def test_rows_of_trees_merge_like_one_tree(own):
    """Words of every length, those of a batch together, by both kinds of tree."""
    draw = random.Random(5)
    words = list({"".join(draw.choice("abcdeé1!'") for _ in range(draw.randrange(1, 90))).encode() for _ in range(1500)} | {b"a", "é".encode(), b"ab" * 32, b"ab" * 33, b"x" * 65})
    for word, ids in own.words_of(words).items():
        symbols = [own.inner[b] for b in word[:-1]] + [own.last[word[-1]]]
        assert np.frombuffer(ids, np.int32).tolist() == own.merged(symbols), word
    assert own.words_of([]) == {}


def test_every_code_point_is_as_in_the_library(library, own):
    """Each by itself between letters, in texts of 256 code points."""
    for first in range(0, 0x110000, 256):
        points = [chr(c) for c in range(first, first + 256) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{c}b {c}" for c in points)
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(first)


def test_what_a_worker_keeps_is_bounded():
    small = bpe.Bpe(bpe.default_path(), most=1000, most_bytes=20_000)
    for i in range(20):
        small.rendered_all([" ".join(f"w{i}x{k}" for k in range(300)), "z" * 10_000 + str(i)])
        assert len(small.of_word) < 2500 and small.of_word.bytes < 60_000 and small.of_piece.bytes < 60_000
        assert all(len(p) <= 64 for p in small.of_piece)
