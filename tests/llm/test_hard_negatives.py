import numpy as np
import pytest

from quern.llm import hard_negatives as h

LONG = 2**63


def brute(rows, anchors, positives=5, negatives=5, low=80, high=100):
    """``rows``: (id, label, integer vector); anchors ask once with the least (label, vector)."""
    out, asking = [], {}
    for i, label, v in rows:
        if anchors(i):
            asking[i] = min(asking.get(i, (label, v)), (label, v))
    for a, (label, v) in asking.items():
        scored = [(sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in rows if i != a and len(w) == len(v)]
        order = lambda t: (-t[0], t[1])
        for p in sorted((t for t in scored if t[2]), key=order)[:positives]:
            hard = sorted((t for t in scored if not t[2] and low * p[0] <= 100 * t[0] <= high * p[0]), key=order)[:negatives]
            out += [(a, p[1], n + 1, t[1], p[0], t[0]) for n, t in enumerate(hard)]
    return sorted(out)


def usable(raw):
    out = []
    for i, v, label in raw:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if sum((x * 256) ** 2 for x in v) < 2.0**62:
            out.append((i, label, [int(np.floor(256 * x)) for x in v]))
    return out


def mined(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def odd(spark):
    draw = np.random.default_rng(3)
    raw = [(i, [float(x) for x in draw.integers(-3, 4, 4) / 256], int(draw.integers(0, 3))) for i in range(600)]  # many ties
    raw += [(i, [0.5, 0.25, 0.125, 1.0], i % 3) for i in range(600, 900)]  # a common vector
    raw += [(20, [1.0, 1.0, 1.0, 1.0], 0), (20, [0.0, 1.0, 1.0, 1.0], 0), (21, [1.0, 1.0, 1.0, 1.0], 1), (21, [1.0, 1.0, 1.0, 1.0], 1)]
    raw += [(40, None, 1), (60, [1.0, None, 1.0, 1.0], 1), (80, [float("nan")] * 4, 1), (100, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (120, [1.0] * 4, None)]
    raw += [(1000, [], 1), (1001, [], 2), (1020, [1.0, 2.0], 1), (1021, [2.0, 1.0], 1), (1022, [2.0, 1.0], 2), (1040, [1e6, 3e5, 7.0, 1.0], 1), (1041, [1e6, 3e5, 8.0, 1.0], 1), (1042, [1e6, 3e5, 6.9999, 1.0], 2), (1060, [1e20] * 4, 1)]
    raw += [(1080, [-9.0, -9.0, -9.0, -9.0], 7)]  # no positives
    return raw, spark.createDataFrame([(*r, 5, 1.0) for r in raw], "vec_id long, embedding array<double>, label int, rank int, score double").repartition(5)


@pytest.mark.parametrize("round_bytes", [h.ROUND_BYTES, 500])
def test_against_every_pair(odd, round_bytes):
    raw, df = odd
    rows = h.scaled(df)
    want = brute(usable(raw), lambda i: i % 20 == 0)
    assert len(want) > 300 and mined(h.mined(rows, rows.where("id % 20 = 0"), round_bytes=round_bytes)) == want


def test_other_windows_and_counts(odd):
    raw, df = odd
    rows = h.scaled(df)
    got = mined(h.mined(rows, rows.where("id % 50 = 0"), positives=2, negatives=7, low_percent=50, high_percent=90))
    assert got == brute(usable(raw), lambda i: i % 50 == 0, 2, 7, 50, 90)


def test_small_slices(odd, monkeypatch):
    raw, df = odd
    monkeypatch.setattr(h, "BLOCK_ROWS", 3)
    rows = h.scaled(df)
    assert mined(h.mined(rows, rows.where("id % 20 = 0"))) == brute(usable(raw), lambda i: i % 20 == 0)


def test_products_stay_exact():
    draw = np.random.default_rng(1)
    a, b = (draw.integers(-(2**30), 2**30, (3, 2)).astype(float) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert h.products(a, b).tolist() == want and h.products(a, b).dtype == np.int64
    assert h.products(a[:0], b).shape == (0, 3) if len(a[:0]) else True


def test_best_keeps_the_first_of_ties():
    best = h.Best(2, 3)
    scores = np.full((2, 4000), 5.0)
    scores[1, 3999] = 6
    best.add(scores, np.ones_like(scores, bool), np.arange(4000) + 10)
    best.add(scores[:, :5], np.ones((2, 5), bool), np.arange(5))
    assert best.id.tolist() == [[0, 1, 2], [4009, 0, 1]] and best.score.tolist() == [[5, 5, 5], [6, 5, 5]]


def test_query(spark, sf):
    from quern.llm import staging

    raw = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in staging.table(spark, sf, "embeddings").collect()]
    assert mined(h.op11_hard_negatives(spark, sf)) == brute(usable(raw), lambda i: i % 100 == 0)


def test_empty(odd):
    rows = h.scaled(odd[1].where("false"))
    assert h.mined(rows, rows).count() == 0
    rows = h.scaled(odd[1])
    assert h.mined(rows, rows.where("false")).count() == 0
