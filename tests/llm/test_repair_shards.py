import zlib

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from quern.llm import repair_shards as r, staging


@pytest.mark.parametrize("kind", ["random", "skewed", "constant", "short", "empty"])
def test_compression_is_lossless(kind):
    draw = np.random.default_rng(2)
    ids = {
        "random": draw.integers(0, 5000, 20_000),
        "skewed": draw.zipf(1.3, 60_000) % 5000,
        "constant": np.full(10_001, 7),
        "short": np.array([3]),
        "empty": np.zeros(0),
    }[kind].astype(np.uint16)
    symbols, rules = r.compress(ids, 5000)
    lengths = r.rule_lengths(rules, 5000)
    assert (r.expand(symbols, rules, lengths, 5000) == ids).all()
    if kind in ("skewed", "constant"):
        assert len(symbols) < 0.8 * len(ids)
    row = {"rules": rules.astype("<u2").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u2").tobytes(), "first_symbol": 5000}
    for a, b in ((0, len(ids)), (0, 0), (len(ids) // 3, len(ids) // 2), (max(0, len(ids) - 5), len(ids))):
        assert (r.read_range(row, a, b) == ids[a:b]).all()


def expected(rows):
    t = Tokenizer.from_file(r.default_path())
    out, start = [], 0
    for row in sorted(rows, key=lambda x: x["doc_id"]):
        ids = np.array(t.encode(row["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf):
    want = expected(staging.table(spark, sf, "documents").collect())
    assert sorted(map(tuple, r.op3_repair_shards(spark, sf).collect())) == want


def test_odd_rows(spark, odd, none):
    to = staging.new_path(spark, "t")
    r.write(odd, r.default_path(), to)
    got = r.read(spark, to).collect()
    assert len(got) == odd.count()
    t = Tokenizer.from_file(r.default_path())
    crc = lambda x: zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
    assert sorted(((x["doc_id"] or -1), x["ids_crc32"]) for x in got) == sorted(((x["doc_id"] or -1), crc(x["text"])) for x in odd.collect())
    starts = sorted((x["start"], x["n_tokens"]) for x in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    to = staging.new_path(spark, "t")
    r.write(none, r.default_path(), to)
    assert r.read(spark, to).count() == 0


TEXTS = ["a b\nc", "One, two. Größe! größe? a; é.é b.. c.d, .", "!", "a  b", " a", "a ", "a\n\n\nb", "x\ty", "He's  it's\u00a0 we'll\n12 3456 (ok)!? \n", "<|endoftext|> a", "a\0b", "Straße日本語 👩‍👩‍👧\nİ", "é" * 300 + "\nz", "\n", "a \nb", "a\n b", "!\n!", "\x1c a"]


def test_encoder_is_the_library():
    e = r.Encoder(r.default_path())
    for _ in range(2):
        ids, counts = e.encode([*TEXTS, None, ""])
        start = 0
        for t, n in zip([*TEXTS, "", ""], counts):
            assert ids[start : start + n].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [0], t
            start += n
        assert start == len(ids)


@pytest.mark.parametrize("kind", ["skewed", "phrases", "constant"])
def test_no_frequent_pair_is_left(kind):
    draw = np.random.default_rng(3)
    phrase = draw.integers(0, 300, 700)
    ids = {
        "skewed": draw.zipf(1.3, 60_000) % 5000,
        "phrases": np.concatenate([np.concatenate([draw.integers(0, 5000, 50), phrase]) for _ in range(40)]),
        "constant": np.full(10_001, 7),
    }[kind].astype(np.uint16)
    symbols, rules = r.compress(ids, 5000)
    assert (r.expand(symbols, rules, r.rule_lengths(rules, 5000), 5000) == ids).all()
    left, n = np.unique(np.stack([symbols[:-1], symbols[1:]]), axis=1, return_counts=True)
    for a, b in left[:, n >= 8].T:  # what is left occurs so often only by overlapping with itself
        at = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b))
        uses, last = 0, -2
        for i in at:
            if i > last + 1:
                uses, last = uses + 1, i
        assert uses < 8
    if kind != "skewed":
        assert r.rule_lengths(rules, 5000).max() >= 512  # far more than a fixed number of rounds allows


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    monkeypatch.setattr(r._Pieces, "MOST_BYTES", 20_000)
    monkeypatch.setattr(r._Words, "MOST_BYTES", 20_000)
    e = r.Encoder(r.default_path())
    for i in range(20):
        e.encode([" ".join(f"w{i}x{k}" for k in range(300)), "z" * 10_000 + str(i)])
        assert e.pieces.bytes < 40_000 and e.words.bytes < 40_000 and all(len(w) <= 64 for w in [*e.words, *e.pieces])


def test_every_code_point_is_cut_as_by_the_library():
    """Before 's, between digits and after a space: what a character is taken for shows only there."""
    e = r.Encoder(r.default_path())
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4000):
        texts = [f"B{c}'s 7{c}7 {c}'s" for c in points[i : i + 4000]]
        flat, counts = e.encode(texts)
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for t, ids, whole in zip(texts, parts, e.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert ids.tolist() == whole.ids + [0], t


def test_words_of_settled_texts_are_cut_as_by_the_library():
    draw = np.random.default_rng(5)
    sets = ["a's ", "'stremvdl \n", "aé1\u00b2.\u00a0\n\t ", "ab c,'\n", "é\u00ad\u00aa\u00bc\u017f\u00d7 x\r\u00a0", "'\u00a0s\n", "<| a", "aЖ’ '\n"]
    texts = ["".join(draw.choice(list(sets[i % len(sets)]), draw.integers(0, 14))) for i in range(16_000)]
    e = r.Encoder(r.default_path())
    for size in (1, 7, 4000):
        for i in range(0, 300 * size if size < 4000 else len(texts), size):
            part = texts[i : i + size]
            flat, counts = e.encode(part)
            want = [x.ids + [0] for x in e.tokenizer.encode_batch(part, add_special_tokens=False)]
            assert counts.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])
    even = [t for t in texts if r.SETTLED.fullmatch(t) and not r.UNEVEN.search(t) and t[-1:] != " "]
    raw = [t.encode() for t in even]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts = r._word_starts(data, r._kinds(data), offsets)
    assert np.diff(np.append(starts, len(data))).tolist() == [len(w.encode()) for t in even for w in regex.findall(r.WORD, t)]


def test_every_word_of_a_batch_is_looked_up_once(monkeypatch):
    """However many texts hold it and whatever stands beside it; settled texts leave no pieces."""
    asked, of = [], r._Words.of
    monkeypatch.setattr(r._Words, "of", lambda self, words: asked.extend(words) or of(self, words))
    e = r.Encoder(r.default_path())
    e.encode([f"word word, größe{mark} word's\nword" for mark in ("", ".", "?!", ")", ";")] * 20)
    assert len(asked) == len(set(asked)) and not e.pieces


def test_pieces_beyond_latin_share_one_look_up(monkeypatch):
    calls, of = [], r._Words.of
    monkeypatch.setattr(r._Words, "of", lambda self, words: calls.append(list(words)) or of(self, words))
    e = r.Encoder(r.default_path())
    texts = [f"word’s word{i} größe “x{i}” {'日本語' * 30}" for i in range(50)]
    flat, _ = e.encode(texts)
    assert flat.tolist() == [i for t in texts for i in [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0]]
    assert len([c for c in calls if c]) == 1 and len(calls[0]) == len(set(calls[0]))
    assert all(len(p) <= 64 for p in e.pieces)
