"""Nearest neighbours by vantage-point trees, one a shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of vec_id, vector and input partition, so rows that repeat a
vec_id, or are equal, spread too. A shard's tree takes a vantage point, splits the
rest at the median distance from it and goes on in both halves. A query first goes straight down to a leaf for a first
radius, then visits every part that the triangle inequality does not exclude: the inner part where
``d - radius * slack <= median``, the outer one where ``d + radius * slack >= median``. ``slack`` 1 is exact search;
smaller values prune more and may miss neighbours. The radius is the k-th distance so far, so equal distances at
the end are seen and smaller vec_ids win.

Queries are grouped in blocks of ``BLOCK_ROWS``. Every block first meets one shard; the distance of a query's k-th row there
is the radius with which it then meets all other shards, whose trees are so pruned from the start. A tree goes to a task with
``GROUP_BLOCKS`` blocks at a time, so neither all blocks of a shard nor all shards of a block come together in one task.
Only k rows of each query and shard go on. All trees and blocks are Spark rows; nothing passes the driver.

Distances are Euclidean in double precision on the original vectors. Defined results: a vector that is null, empty,
zero, or holds a null or non-finite component takes no part, nor does a row without vec_id; vectors meet only those of
their own length; rows that repeat a vec_id are candidates of their own, except for queries of that vec_id, which asks once,
with the least of its vectors; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import staging

SHARD_ROWS, BLOCK_ROWS, GROUP_BLOCKS, LEAF_ROWS, SLACK, K = 8192, 256, 8, 64, 1.0, 10


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(-1))


class Tree:
    """A vantage-point tree over ``vectors`` with ids; ties in order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.leaf_rows = ids[order], np.ascontiguousarray(vectors[order], np.float64), leaf_rows
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # (first, last, -1, 0, 0, 0) for a leaf, or (first, last, vantage, median, inner, outer)
        self._grow(0, len(ids), np.random.default_rng(1))

    def _grow(self, first: int, last: int, draw) -> int:
        at, rows = len(self.nodes), self.order[first:last]
        self.nodes.append((first, last, -1, 0.0, 0, 0))
        if last - first <= self.leaf_rows:
            return at
        vantage = int(rows[draw.integers(len(rows))])
        d = distances(self.vectors[rows], self.vectors[vantage])
        median = float(np.median(d))
        inner = d <= median
        if inner.all():  # at least half of the rows are as far as the farthest
            inner = d < median
            if not inner.any():
                return at  # all are equally far: nothing to prune by
            median = float(d[inner].max())
        self.order[first:last] = np.concatenate([rows[inner], rows[~inner]])
        middle = first + int(inner.sum())
        a = self._grow(first, middle, draw)
        b = self._grow(middle, last, draw)
        self.nodes[at] = (first, last, vantage, median, a, b)
        return at

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, slack: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids (inf and -1 where there are fewer than k) of each query's nearest rows but its own.

        ``within`` are distances beyond which rows are not asked for.
        """
        queries = np.ascontiguousarray(queries, np.float64)
        n = len(queries)
        best = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        within = np.full(n, np.inf) if within is None else within
        seen: dict[int, np.ndarray] = {}
        stack = [(0, np.flatnonzero(np.isinf(within)))]  # first straight down
        while stack and len(self.ids):
            at, who = stack.pop()
            first, last, vantage, median, a, b = self.nodes[at]
            if vantage < 0:
                self._leaf(at, who, own, queries, best, k)
                seen.setdefault(at, np.zeros(n, bool))[who] = True
                continue
            near = distances(queries[who], self.vectors[vantage]) <= median
            stack += [(c, w) for c, w in ((a, who[near]), (b, who[~near])) if len(w)]
        stack = [(0, np.arange(n))]
        while stack and len(self.ids):
            at, who = stack.pop()
            first, last, vantage, median, a, b = self.nodes[at]
            if vantage < 0:
                if at in seen:
                    who = who[~seen[at][who]]
                if len(who):
                    self._leaf(at, who, own, queries, best, k)
                continue
            d, radius = distances(queries[who], self.vectors[vantage]), np.minimum(best[0][who, -1], within[who]) * slack
            edge = 1e-9 * (1 + median)  # the bounds themselves are rounded
            stack += [(c, who[m]) for c, m in ((b, d + radius >= median - edge), (a, d - radius <= median + edge)) if m.any()]
        found, ids = best
        ids[np.isinf(found)] = -1
        return found, ids

    def _leaf(self, at: int, who: np.ndarray, own, queries, best, k: int) -> None:
        rows = self.order[self.nodes[at][0] : self.nodes[at][1]]
        step = max(1, (1 << 18) // len(rows))
        for i in range(0, len(who), step):
            w = who[i : i + step]
            d = distances(queries[w][:, None, :], self.vectors[rows][None, :, :])
            d[self.ids[rows][None, :] == own[w][:, None]] = np.inf
            both = np.concatenate([best[0][w], d], 1)
            ids = np.concatenate([best[1][w], np.where(np.isinf(d), np.iinfo(np.int64).max, self.ids[rows][None, :])], 1)
            order = np.lexsort((ids, both), axis=-1)[:, :k]
            best[0][w], best[1][w] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (as doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(len(column), -1)


def _grown(table, leaf_rows):
    tree = Tree(np.asarray(table.column("vec_id")), _matrix(table.column("embedding")), leaf_rows)
    return pa.table({"size": table.column("size")[:1], "shard": table.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _blocked(table):
    packed = np.asarray(table.column("vec_id")), _matrix(table.column("embedding")), np.asarray(table.column("within"))
    return pa.table({k: table.column(k)[:1] for k in ("size", "block")} | {"queries": pa.array([pickle.dumps(packed)], pa.binary())})


def _searched(batches, k: int, slack: float):
    for batch in batches:
        for tree, queries in zip(batch.column("tree"), batch.column("queries")):
            own, points, within = pickle.loads(queries.as_py())
            d, ids = pickle.loads(tree.as_py()).search(own, points, k, slack, within)
            hit = ids >= 0
            query = np.broadcast_to(own[:, None], ids.shape)
            yield pa.RecordBatch.from_arrays([pa.array(query[hit]), pa.array(ids[hit]), pa.array(d[hit])], ["query_id", "vec_id", "score"])


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per shard: size (of its vectors), shard, tree. ``vectors`` are usable ones."""
    shards = max(1, -(-vectors.count() // shard_rows))
    share = F.pmod(F.xxhash64("vec_id", "embedding", F.spark_partition_id()), F.lit(shards))
    dealt = vectors.select(F.size("embedding").alias("size"), share.alias("shard"), "vec_id", "embedding")
    return dealt.groupBy("size", "shard").applyInArrow(lambda rows: _grown(rows, leaf_rows), "size int, shard long, tree binary")


def nearest(queries: DataFrame, trees: DataFrame, k: int = K, slack: float = SLACK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of the index for every query, its own vec_id excepted.

    ``trees`` should be staged: it is read three times.
    """
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))  # a vec_id asks once
    blocks = max(1, -(-queries.count() // block_rows))
    dealt = queries.select(F.size("embedding").alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "embedding")
    dealt = staging.staged(dealt, "queries")
    places = trees.select("size", "shard", F.row_number().over(Window.partitionBy("size").orderBy("shard")).alias("place"))  # a row for each shard
    places = places.join(places.groupBy("size").agg(F.count(F.lit(1)).alias("shards")), "size")
    first = F.expr("place = 1 + pmod(block, shards)")
    group = F.expr(f"block div {GROUP_BLOCKS}")

    def met(asked: DataFrame, meets) -> DataFrame:
        packed = asked.groupBy("size", "block").applyInArrow(_blocked, "size int, block long, queries binary")
        wanted = packed.select("size", "block").join(places, "size").where(meets).select("size", "block", "shard", group.alias("group"))
        groups = wanted.select("size", "shard", "group").distinct()
        dealt_trees = trees.join(groups, ["size", "shard"])
        pairs = packed.join(wanted, ["size", "block"]).join(dealt_trees, ["size", "shard", "group"]).select("tree", "queries")
        return pairs.mapInArrow(functools.partial(_searched, k=k, slack=slack), "query_id long, vec_id long, score double")

    near = staging.staged(met(dealt.withColumn("within", F.lit(float("inf"))), first), "near")
    radius = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("d")).where(F.col("n") == k).select("vec_id", "d")
    asked = dealt.join(radius, "vec_id", "left").withColumn("within", F.coalesce("d", F.lit(float("inf")))).drop("d")
    found = near.unionByName(met(asked, ~first))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_vp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(staging.table(spark, sf_dir, "embeddings"))
    trees = staging.staged(index(vectors), "trees")
    return nearest(vectors.where(F.col("vec_id") % 100 == 0), trees)
