"""Keep-first deduplication and rankings within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of the rows with equal keys the one with the smallest ``order``, which must be unique. Null keys are one group.

    The keys' 16-byte digests are pre-aggregated before the shuffle, so a key with a third of all rows costs no more than
    any other; the rows themselves move only to meet the ids that stay.
    """
    digest = F.coalesce(F.unhex(F.md5(key.cast("string"))), F.lit(b""))
    first = df.select(digest.alias("__key"), F.col(order).alias("__first")).groupBy("__key").agg(F.min("__first").alias("__first"))
    return df.join(first.select("__first"), df[order] == F.col("__first"), "left_semi")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int | Column, spread: str | None = None, parts: int = 32) -> DataFrame:
    """The first ``n`` rows of each group; a constant ``n`` is applied before the shuffle too.

    With a column ``n``, which must be the same in all rows of a group, name a column ``spread`` whose values vary: each group
    is then cut in ``parts`` by its hash and every part gives up to ``n`` rows to the group, so no task sorts a whole hot group.
    """
    if spread is not None:
        salted = df.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(parts)))
        rank = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
        df = salted.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__part", "__rank")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank_in_group", rank).where(F.col("rank_in_group") <= n)


def last_writer(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column] | None = None) -> DataFrame:
    """Union-distinct by key in which a row of ``new`` replaces that of ``old``; of several new ones the last by ``order`` does."""
    from quern.sources.tables import upsert

    return upsert(old, new, key, order)
