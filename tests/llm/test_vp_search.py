import numpy as np
import pytest

from quern.llm import staging, vp_search as v


def brute(rows, every=100, k=10):
    fine = {}
    for r in rows:
        e = r["embedding"]
        if r["vec_id"] is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            fine.setdefault(r["vec_id"], []).append(np.array(e, np.float64))
    out = set()
    for q in (i for i in fine if i % every == 0):
        point = min(fine[q], key=lambda e: e.tolist())
        near = sorted((float(np.sqrt(((e - point) ** 2).sum())), i) for i, es in fine.items() if i != q for e in es if len(e) == len(point))[:k]
        out |= {(q, n + 1, i, round(d, 12)) for n, (d, i) in enumerate(near)}
    return out


def rounded(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in df.collect()}


def test_query_is_exact(spark, sf):
    assert rounded(v.op6_vp_tree_search(spark, sf)) == brute(staging.table(spark, sf, "embeddings").collect())


def test_odd_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=5).tolist(), "x") for i in range(300)]
    rows += [(i, rows[0][1], "x") for i in range(300, 420)] + [(100, rows[7][1], "x"), (100, None, "x"), (500, [0.0] * 5, "x"), (600, [float("nan")] + [1.0] * 4, "x")]
    rows += [(700, [None, 1.0, 1.0, 1.0, 1.0], "x"), (800, [], "x"), (900, [1.0, 2.0], "x"), (901, [3.0, 2.0], "x"), (None, [1.0] * 5, "x"), (1000, [float("inf")] * 5, "x")]
    vectors = v.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, size string"))
    trees = v.index(vectors, shard_rows=100, leaf_rows=8)
    got = v.nearest(vectors.where("vec_id % 100 = 0"), trees, block_rows=3)
    assert rounded(got) == brute([{"vec_id": r[0], "embedding": r[1]} for r in rows])


def test_empty(spark):
    vectors = v.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert v.nearest(vectors, v.index(vectors)).count() == 0


@pytest.mark.parametrize("slack,least", [(1.0, 1.0), (0.6, 0.5)])
def test_slack_trades_recall_for_pruning(slack, least):
    draw = np.random.default_rng(0)
    rows = draw.normal(size=(4000, 8))
    tree, q = v.Tree(np.arange(4000), rows), draw.normal(size=(50, 8))
    _, ids = tree.search(np.full(50, -1), q, 10, slack)
    exact = np.argsort(((q[:, None] - rows[None]) ** 2).sum(-1), axis=1)[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, exact)])
    assert recall >= least and (slack < 1 or recall == 1)


def test_many_shards_and_blocks(spark):
    """Blocks meet one shard first and the others with that radius: still exact, ties and repeated rows included."""
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in draw.integers(0, 4, 6)]) for i in range(2500)] + [(7, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0])] * 400
    vectors = v.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8))
    trees = staging.staged(v.index(vectors, shard_rows=90, leaf_rows=8), "trees")
    assert trees.count() > 20
    got = v.nearest(vectors.where("vec_id % 20 = 0"), trees, block_rows=5)
    assert sorted(rounded_rows(got)) == sorted(brute_rows(rows, 20))


def rounded_rows(df):
    return [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in df.collect()]


def brute_rows(rows, every, k=10):
    ids, points = np.array([i for i, _ in rows]), np.array([e for _, e in rows])
    for q, e in {i: e for i, e in rows if i % every == 0 and any(e)}.items():
        d = np.sqrt(((points - np.array(e)) ** 2).sum(1))
        keep = np.flatnonzero((ids != q) & points.any(1))
        for n, j in enumerate(keep[np.lexsort((ids[keep], d[keep]))][:k], 1):
            yield (q, n, int(ids[j]), round(float(d[j]), 12))
