"""Hard negatives by blocked dense matrix products.

Anchors go to all tasks in rounds: a round broadcasts blocks of anchors of ``ROUND_BYTES`` at most, however many anchors
there are. Every task multiplies each block with its candidates, a slice of ``SLICE_ROWS`` at a time, and keeps only
the first k rows of each anchor, a state that merges with that of other tasks by a window over k rows a task. A first pass
finds an anchor's positives, its first ``positives`` rows of the same label. A second pass over the same candidates takes,
for each positive, the first ``negatives`` rows of other labels with
``low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score``.

Scores are integer inner products. Products of blocks run in float64 where the lengths of the rows prove that every
partial sum stays below 2^53, hence exact, and in int64 else. Higher scores come first, then smaller ids.

Defined results: rows with a null id, label, vector or component, or a component that is not finite, take no part, nor do
rows whose squared length reaches 2^62, as their scores need not fit a long; an empty vector has score 0; vectors meet only
those of their own length. Rows that repeat an id are candidates of their own, except for the anchor of that id, which asks
once, with the least of its (label, vector). An anchor without positives, or a positive without negatives, gives no row. An
empty table gives an empty result. Columns besides the three named ones are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import staging

ROUND_BYTES, BLOCK_ROWS, SLICE_ROWS = 32 << 20, 512, 4096
NONE = -(2**63 - 1)  # below every score


def scaled(rows: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label", scale: int = 256) -> DataFrame:
    """id, label, vector: the rows that take part, each component x as floor(scale * x)."""
    v = F.col(vector).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale)) < 2.0**62)
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), whole.alias("vector")).where("id IS NOT NULL AND label IS NOT NULL")


class Best:
    """The first k (score, id) of each of n rows: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE, np.int64), np.full((n, k), 2**63 - 1, np.int64)

    def add(self, scores: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> None:
        """Takes ``scores`` (n x candidates) where ``hit`` holds; ``ids`` ascend."""
        n, k = self.score.shape
        hit = hit & (scores >= self.score[:, -1:])
        if np.count_nonzero(hit) > 8 * n * k:
            shown = np.where(hit, scores, NONE)
            kth = np.partition(shown, -k, axis=1)[:, -k : shown.shape[1] - k + 1]
            level = hit & (shown == kth)
            hit &= (shown > kth) | (level & (np.cumsum(level, axis=1) <= k))
        row, column = np.nonzero(hit)
        if not len(row):
            return
        row = np.concatenate([np.repeat(np.arange(n), k), row])
        score = np.concatenate([self.score.ravel(), scores[hit].astype(np.int64)])
        who = np.concatenate([self.id.ravel(), ids[column]])
        order = np.lexsort((who, -score, row))
        first = np.searchsorted(row[order], np.arange(n))
        order = order[first[:, None] + np.arange(k)]
        self.score, self.id = score[order], who[order]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: float64 where no partial sum can reach 2^53, int64 else."""
    if not len(b):
        return np.zeros((len(a), 0))
    longest = np.sqrt((a * a).sum(1).max()) * np.sqrt((b * b).sum(1).max())
    return a @ b.T if longest < 2.0**53 - 2 else a.astype(np.int64) @ b.astype(np.int64).T


def _rows(table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) for each length of vectors, by id."""
    ids, labels = table.column("id").to_numpy(zero_copy_only=False), table.column("label").to_numpy(zero_copy_only=False)
    vectors = table.column("vector")
    width = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    found = []
    for n in np.unique(width):
        at = np.flatnonzero(width == n)
        at = at[np.argsort(ids[at], kind="stable")]
        flat = vectors.take(pa.array(at))
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        found.append((ids[at], labels[at], flat.flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)))
    return found


def _blocks(table) -> list[tuple]:
    return [tuple(x[i : i + BLOCK_ROWS] for x in rows) for rows in _rows(table) for i in range(0, len(rows[0]), BLOCK_ROWS)]


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield from _rows(batch.slice(i, SLICE_ROWS))


def _met(batches, blocks):
    """(number of the block, ids of the slice, products, of the same label, of another row) for each block and slice."""
    for ids, labels, vectors in _slices(batches):
        for i, (own, label, anchors, *_) in enumerate(blocks):
            if anchors.shape[1] == vectors.shape[1]:
                yield i, ids, products(anchors, vectors), label[:, None] == labels[None, :], own[:, None] != ids[None, :]


def _positives(batches, shared, k: int):
    blocks = shared.value
    best = [Best(len(b[0]), k) for b in blocks]
    for i, ids, scores, same, other in _met(batches, blocks):
        best[i].add(scores, same & other, ids)
    for (own, *_), b in zip(blocks, best):
        row, at = np.nonzero(b.score > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(b.id[row, at]), pa.array(b.score[row, at])], ["anchor_id", "positive_id", "positive_score"])


def _negatives(batches, shared, k: int):
    """Each block also brings (low, high) of each anchor and slot: the scores that its positive allows."""
    blocks = shared.value
    best = [[Best(len(b[0]), k) for _ in range(b[3].shape[1])] for b in blocks]
    for i, ids, scores, same, other in _met(batches, blocks):
        low, high = blocks[i][3], blocks[i][4]
        differ = other & ~same
        for slot, b in enumerate(best[i]):
            b.add(scores, differ & (scores >= low[:, slot, None]) & (scores <= high[:, slot, None]), ids)
    for (own, *_), slots in zip(blocks, best):
        for slot, b in enumerate(slots):
            row, at = np.nonzero(b.score > NONE)
            columns = [pa.array(own[row]), pa.array(np.full(len(row), slot + 1, np.int32)), pa.array(b.id[row, at]), pa.array(b.score[row, at])]
            yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "slot", "negative_id", "negative_score"])


def _first(rows: DataFrame, group: list[str], score: str, id: str, k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group: what merges the tasks' own first rows."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), id)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def _bounded(blocks: list[tuple], found, k: int, low_percent: int, high_percent: int) -> list[tuple]:
    """``blocks``, each with the lowest and highest score that the positives (anchor_id, slot, positive_score) allow."""
    kept = {a: {} for a in found.column("anchor_id").to_pylist()}
    for anchor, slot, score in zip(*(found.column(c).to_pylist() for c in ("anchor_id", "slot", "positive_score"))):
        kept[anchor][slot] = score
    out = []
    for own, label, vectors in blocks:
        low, high = np.full((len(own), k), 2**63 - 1, np.int64), np.full((len(own), k), NONE, np.int64)
        for i, anchor in enumerate(own.tolist()):
            for slot, score in kept.get(anchor, {}).items():
                low[i, slot - 1], high[i, slot - 1] = -(-low_percent * score // 100), high_percent * score // 100
        out.append((own, label, vectors, low, high))
    return out


def mined(candidates: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Both tables as ``scaled`` gives them."""
    least = F.min(F.struct("label", "vector")).alias("row")
    asking = staging.staged(anchors.groupBy("id").agg(least).select("id", "row.label", "row.vector"), "anchors")
    size = asking.agg(F.sum(F.size("vector") * 8 + 16)).first()[0] or 0
    rounds = -(-size // round_bytes)
    spark, results = candidates.sparkSession, []
    rows = staging.small_batches(candidates)
    for r in range(rounds):
        blocks = _blocks(asking.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).toArrow())
        shared = spark.sparkContext.broadcast(blocks)
        near = rows.mapInArrow(functools.partial(_positives, shared=shared, k=positives), "anchor_id long, positive_id long, positive_score long")
        near = staging.staged(_first(near, ["anchor_id"], "positive_score", "positive_id", positives, "slot"), "positives")
        shared.destroy()
        blocks = _bounded(blocks, near.select("anchor_id", "slot", "positive_score").toArrow(), positives, low_percent, high_percent)
        shared = spark.sparkContext.broadcast(blocks)
        hard = rows.mapInArrow(functools.partial(_negatives, shared=shared, k=negatives), "anchor_id long, slot int, negative_id long, negative_score long")
        hard = _first(hard, ["anchor_id", "slot"], "negative_score", "negative_id", negatives, "rank").join(near, ["anchor_id", "slot"])
        results.append(staging.staged(hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
        shared.destroy()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return functools.reduce(DataFrame.unionByName, results, empty)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staging.table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = scaled(rows.select("vec_id", "embedding", shifted.alias("label")))
    return mined(rows, rows.where("id % 100 = 0"))


ORACLE = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM fine a JOIN fine c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
near AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT n.anchor_id, n.positive_id, (row_number() OVER w)::INT AS rank, s.other_id AS negative_id, n.positive_score, s.score AS negative_score
FROM near n JOIN scored s ON s.anchor_id = n.anchor_id AND NOT s.same AND 80 * n.positive_score <= 100 * s.score AND s.score <= n.positive_score
WINDOW w AS (PARTITION BY n.anchor_id, n.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""
