import re

import numpy as np
import pytest

from quern.llm import graph, near_dup, staging


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets = {}
    for r in rows:
        sets[r["doc_id"]] = shingles(r["text"])
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {(i, len(sets[i]), find(i)) for i in ids}


def test_odd_rows(odd):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute(odd.collect())
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_whole_table_against_brute_force(spark, sf):
    docs = staging.table(spark, sf, "documents")
    got = near_dup.op9_setsketch_near_dup(spark, sf).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(docs.collect())


def test_chains_of_near_copies(spark):
    """Each text is near its neighbours only, so pivots alone do not connect the chain."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[4 * i : 4 * i + 200])) for i in range(40)] + [(100 + i, " ".join(base[2 * i : 2 * i + 120])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(docs.collect())


def test_empty(none):
    assert near_dup.near_duplicates(none).count() == 0


def test_keep_representatives(odd):
    kept = near_dup.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert {8, 10, 14} & {r["doc_id"] for r in kept.collect()} == set()


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(5)
    h = draw.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = h[:2200], h[300:2500]
    ra, rb, rab = (near_dup.registers_of([np.unique(x)])[0] for x in (a, b, h[:2500]))
    assert (near_dup.merge(ra, rb) == rab).all()
    up, down = np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()])
    j = near_dup.estimated(up, down, np.array([2200.0]), np.array([2200.0]))[0]
    assert abs(j - 1900 / 2500) < 4 * (0.76 * 0.24 / near_dup.REGISTERS) ** 0.5


def test_long_texts_are_hashed_alike_in_parts():
    text = " ".join(f"x{i % 501} y{i % 77}" for i in range(2000))
    assert (near_dup.shingle_sets([text], 100)[0] == near_dup.shingle_sets([text])[0]).all()
    assert len(near_dup.shingle_sets([text])[0]) == len(shingles(text))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    root = {n: n for p in pairs for n in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: r for n, r in root.items() if n in got} and all(r == n for n, r in root.items() if n not in got)


def test_group_without_a_text_that_is_near_all(spark, monkeypatch):
    """Copies of a text that is not there, edited so much that half of the pairs are links: blocks find the rest."""
    draw = np.random.default_rng(9)
    rows = []
    for i in range(150):
        words = [f"w{k}" for k in range(150)]
        for k in draw.choice(150, draw.integers(1, 5), replace=False):
            words[k] = f"e{i}-{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(docs.collect())
    for block in (512, 7):  # several blocks a bucket too
        monkeypatch.setattr(near_dup, "BLOCK", block)
        got = near_dup.near_duplicates(docs, 85).collect()
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == want


def test_bands_follow_the_threshold():
    assert near_dup.banding(85) == (32, 6) and near_dup.banding(80) == (38, 5)
    for percent in range(10, 101):
        bands, rows = near_dup.banding(percent)
        assert bands * rows <= near_dup.REGISTERS and (1 - (percent / 100) ** rows) ** bands <= near_dup.MISS


def test_a_caller_may_ask_for_80(spark):
    """200 words with four changed far from each other: 176 of 216 shingles are shared."""
    words = [f"w{i}" for i in range(200)]
    near = [f"x{i}" if i in (20, 70, 120, 170) else w for i, w in enumerate(words)]
    far = [f"y{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    for percent, kept in ((80, [1, 3]), (85, [1, 2, 3])):
        assert sorted(r["doc_id"] for r in near_dup.keep_representatives(docs, percent).collect()) == kept
