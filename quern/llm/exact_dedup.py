"""Exact deduplication with a heavy-hitter split, in DataFrame and SQL operations only.

1. One pass over the texts computes a 32-byte digest per document; everything after works on
   ``(doc_id, digest)``, which is staged in the shared folder.
2. A mergeable Misra-Gries summary (Spark's ``approx_top_k`` keeps DataSketches' frequent-items sketch, which
   is Misra-Gries with batched decrements) names at most ``max_heavy`` candidate digests.
3. The candidates are verified by an exact count; those with ``heavy_rows`` rows or more win. There are at
   most ``max_heavy`` winners, so broadcasting them is bounded whatever the input. Their rows get their
   group's result map-side and are never shuffled.
4. The other digests go through one ordinary shuffle. A digest that the summary misses has at most
   ``rows / (0.75 * counters)`` rows, and its group is found there all the same: the summary decides where a
   group is resolved, never whether.

Defined results: a null text counts as empty; a null doc_id is never a keep_id unless its whole group has none;
rows that repeat a doc_id with the same text are kept or dropped together by ``exact_groups``, while ``keep_first`` keeps
just one row of a group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import staging

WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text):
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def with_groups(digests: DataFrame, max_heavy: int = 1024, counters: int = 8192, heavy_rows: int = 256) -> DataFrame:
    """``(doc_id, digest)`` with keep_id and group_size. ``digests`` should be cheap to read: it is read thrice."""
    heavy = (
        digests.select(F.lower(F.hex("digest")).alias("d"))
        .agg(F.expr(f"approx_top_k(d, {int(max_heavy)}, {int(counters)})").alias("top"))
        .select(F.explode("top").alias("t"))
        .where(F.col("t.count") >= heavy_rows)
        .select(F.unhex("t.item").alias("digest"))
    )
    won = (
        digests.join(F.broadcast(heavy), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= heavy_rows)
    )
    won = staging.staged(won, "heavy")  # at most max_heavy rows
    hot = digests.join(F.broadcast(won), "digest")
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(won), "digest", "left_anti").select(
        "digest", "doc_id", F.min("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    return hot.unionByName(rest)


def text_digest(text):
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def exact_groups(docs: DataFrame, **heavy) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = docs.select("doc_id", text_digest(F.col("text")).alias("digest"))
    return with_groups(staging.staged(digests, "digests"), **heavy).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, **heavy) -> DataFrame:
    """One row of each group, with all its columns: the smallest doc_id, null after all others; then by the row's hash.

    Rows are told apart by themselves, so what repeats a doc_id, or has none, neither stays nor goes along with another.
    """
    row = F.struct(F.col("row.doc_id").isNull().alias("none"), "row.doc_id", staging.H1, staging.H2)  # min() takes false first
    digests = staging.staged(staging.keyed(docs).select(row.alias("doc_id"), text_digest(F.col("row.text")).alias("digest")), "digests")
    groups = with_groups(digests, **heavy)
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    decided = groups.groupBy(F.col(f"doc_id.{staging.H1}"), F.col(f"doc_id.{staging.H2}")).agg(F.bool_or(first).alias("first"), F.count(F.lit(1)).alias("n"))
    return staging.keep_limits(docs, decided.select(staging.H1, staging.H2, F.col("first").cast("long").alias("left"), "n"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(staging.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
