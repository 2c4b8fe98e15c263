"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are cut into blocks of ``block_rows``. Source i with ``u_i`` of ``D`` weight units owns the
fraction ``w_i = u_i / D`` of the mixture; its j-th block (from 0) is released at slot ``floor(j / w_i)`` and due
by ``ceil((j + 1) / w_i)``. Earliest deadline first over those windows is feasible on one lane because the weights
sum to one, so after any number of slots t each source has had ``w_i * t`` blocks, give or take less than one.

The windows repeat every ``D`` slots. So the driver schedules one period, a table of ``D`` rows whatever the input,
and every row's place follows from its rank in its source by arithmetic. Ranks are counted over hash ranges, so a
source with a third of all rows is spread over as many ranges as it needs.

Weights without units given are tempered counts in whole units of a resolution, at least one for every source with rows;
the resolution grows with the number of sources, so none is too small to have a weight.

The mixture ends at the first slot whose source has no rows left: rows beyond it are not selected, because
selecting them would leave the target weights. Only a source's last block can be short. ``repeats`` lets a source be gone
over several times before it counts as dry: its rows then have a place in each pass.

``whole`` goes on instead: when a source runs dry, the sources that still have rows are scheduled anew with their units
among themselves, and so on until all rows have a place. While all sources have rows this is the same schedule under
the same bound, but that every source with rows has one unit at least. The pipeline's stage mixes so: it keeps every
document and puts the table in the mixture's order.

Defined results: a null source is a source of its own; rows with equal or null doc_id are ranked by the order of
their hash and get different places; sources without weight units are not selected; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import staging

RESOLUTION, EXPONENT, BLOCK_ROWS, RANGE_ROWS = 1000, 0.7, 16, 2048


def tempered_units(counts: dict[str, int], exponent: float = EXPONENT, resolution: int = RESOLUTION) -> dict[str, int]:
    """Weight units proportional to ``count ** exponent``, summing to ``resolution`` (largest remainders, then by name)."""
    if len(counts) > resolution:
        raise ValueError(f"{len(counts)} sources need a resolution of as many units at least")
    mass = {k: n**exponent for k, n in sorted(counts.items()) if n}
    if not mass:
        return {}
    share = {k: resolution * m / math.fsum(mass.values()) for k, m in mass.items()}
    units = {k: math.floor(x) for k, x in share.items()}
    for k in sorted(share, key=lambda k: (units[k] - share[k], k))[: resolution - sum(units.values())]:
        units[k] += 1
    return units


def pfair_period(units: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block in the period, slot) for one period of ``sum(units)`` slots, by earliest deadline first."""
    period = sum(units.values())
    releases: list[list[tuple[int, str, int]]] = [[] for _ in range(period)]
    for source, u in units.items():
        for j in range(u):
            releases[j * period // u].append((-(-(j + 1) * period // u), source, j))
    ready, plan = [], []
    for slot in range(period):
        for task in releases[slot]:
            heappush(ready, task)
        deadline, source, j = heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        plan.append((source, j, slot))
    return plan


def whole_units(counts: dict[str, int], exponent: float = EXPONENT, resolution: int = RESOLUTION) -> dict[str, int]:
    """Tempered units, at least one for every source with rows; the resolution grows by what that takes."""
    counts = {k: n for k, n in counts.items() if n}
    return {k: max(1, u) for k, u in tempered_units(counts, exponent, max(resolution, len(counts))).items()}


def whole_plan(blocks: dict[str, int], units: dict[str, int]) -> tuple[list[tuple], list[tuple]]:
    """A schedule of all blocks in phases, each of which ends when a source runs dry.

    First (source, phase, first block, end, units, period), then (source, phase, block in the period, first slot).
    """
    left, done, start, spans, places = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, [], []
    while left:
        common = math.gcd(*(units[k] for k in left))
        live = {k: units[k] // common for k in left}
        plan, period, phase = pfair_period(live), sum(live.values()), len(blocks) - len(left)
        slot_of = {(source, j): slot for source, j, slot in plan}
        horizon = min(left[k] // u * period + slot_of[k, left[k] % u] for k, u in live.items())
        used = {k: horizon // period * u for k, u in live.items()}
        for source, j, slot in plan:
            used[source] += slot < horizon % period
            if slot < horizon:
                places.append((source, phase, j, start + slot))
        spans += [(k, phase, done[k], done[k] + used[k], u, period) for k, u in live.items()]
        start += horizon
        for k, n in used.items():
            done[k] += n
            left[k] -= n
        left = {k: n for k, n in left.items() if n}
    return spans, places


def ranked_in_source(docs: DataFrame, range_rows: int = RANGE_ROWS, ties: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, key, rank): the 0-based rank within the source by (md5 of doc_id, doc_id).

    ``ties`` are further columns, which order rows of one doc_id, spread those without any, and are kept.
    """
    none = F.md5(F.concat_ws(",", *ties)) if ties else F.lit("")
    rows = docs.select(
        "doc_id",
        "source",
        *ties,
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.md5(F.col("doc_id").cast("string")), none).alias("order"),
    )
    largest = rows.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    per_range = max(range_rows, math.sqrt(largest))  # so neither a range nor the list of ranges is more than one task's work
    digits = max(0, math.ceil(math.log(max(1, largest / per_range), 16)))
    rows = rows.withColumn("range", F.substring("order", 1, digits))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("key", "range").count().select("key", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("key", "range").orderBy("order", "doc_id", *ties)
    return (
        rows.withColumn("n", F.row_number().over(within))
        .join(offsets, ["key", "range"])
        .select("doc_id", "source", *ties, "key", (F.col("offset") + F.col("n") - 1).alias("rank"))
    )


def source_counts(docs: DataFrame) -> dict[str, int]:
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return {r["key"]: r["count"] for r in docs.groupBy(key.alias("key")).count().collect()}


def mixed(docs: DataFrame, units: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, ties: tuple[str, ...] = (), repeats: dict[str, int] | None = None) -> DataFrame:
    """One row per document: doc_id, source, ``ties``, block (in its source), slot, selected, position (null if not selected).

    ``units`` maps sources to weight units; a key is the source with ``=`` before it, or empty for the null source.
    Without it the weights are tempered counts. ``repeats`` maps such keys to the number of passes (1 where it has none);
    a document of a source with several passes has a row for each. The driver holds a number for each source.
    """
    spark = docs.sparkSession
    counts, repeats = source_counts(docs), {k: n for k, n in (repeats or {}).items() if n > 1}
    units = whole_units(counts) if units is None else {k: u for k, u in units.items() if u}
    plan, period = pfair_period(units), sum(units.values())
    slot_of = {(source, j): slot for source, j, slot in plan}
    ends = []
    for source, u in units.items():
        blocks = -(-counts.get(source, 0) * repeats.get(source, 1) // block_rows)
        ends.append(blocks // u * period + slot_of[source, blocks % u])
    horizon = min(ends, default=0)
    table = spark.createDataFrame([(s, j, slot, units[s]) for s, j, slot in plan], "key string, j long, slot0 long, units long")
    placed = ranked_in_source(docs, ties=ties)
    if repeats:
        passes = F.broadcast(spark.createDataFrame([(k, n, counts.get(k, 0)) for k, n in repeats.items()], "key string, passes int, n long"))
        placed = placed.join(passes, "key", "left").withColumn("pass", F.explode(F.expr("sequence(0, coalesce(passes, 1) - 1)")))
        placed = placed.withColumn("rank", F.expr("rank + pass * coalesce(n, 0)"))
    placed = placed.withColumn("block", F.floor(F.col("rank") / block_rows))
    weights = F.broadcast(spark.createDataFrame([(s, u) for s, u in units.items()], "key string, u long"))
    placed = placed.join(weights, "key", "left").withColumn("j", F.expr("block % u"))
    slot = F.expr(f"(block div units) * {period} + slot0")
    chosen = F.coalesce(F.col("slot") < horizon, F.lit(False))
    return (
        placed.join(F.broadcast(table), ["key", "j"], "left")  # sum(units) rows
        .withColumn("slot", slot)
        .select("doc_id", "source", *ties, "block", "slot", chosen.alias("selected"), F.when(chosen, F.col("slot") * block_rows + F.col("rank") % block_rows).alias("position"))
    )


def mixed_whole(docs: DataFrame, block_rows: int = BLOCK_ROWS, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per document, none left out: doc_id, source, ``ties``, slot, position."""
    spark, counts = docs.sparkSession, source_counts(docs)
    spans, places = whole_plan({k: -(-n // block_rows) for k, n in counts.items()}, whole_units(counts))
    spans = spark.createDataFrame(spans, "key string, phase long, first long, end long, units long, period long")
    places = spark.createDataFrame(places, "key string, phase long, j long, slot0 long")
    placed = ranked_in_source(docs, ties=ties).withColumn("block", F.expr(f"rank div {block_rows}"))
    placed = placed.join(F.broadcast(spans), "key").where("block >= first AND block < end").withColumn("j", F.expr("(block - first) % units"))
    placed = placed.join(F.broadcast(places), ["key", "phase", "j"]).withColumn("slot", F.expr("(block - first) div units * period + slot0"))
    return placed.select("doc_id", "source", *ties, "slot", F.expr(f"slot * {block_rows} + rank % {block_rows}").alias("position"))


def in_mixed_order(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All documents with all their columns, sorted by their position in the whole mixture."""
    key = [staging.H1, staging.H2]
    light = staging.staged(staging.keyed(docs).select("row.doc_id", "row.source", *key), "sources")
    placed = mixed_whole(light, block_rows, tuple(key)).groupBy(*key).agg(F.collect_list("position").alias("at"))
    placed = staging.staged(placed, "places")
    single = placed.where("size(at) = 1").select(*key, F.col("at")[0].alias("place"))
    several = placed.where("size(at) > 1")  # rows that are equal in all columns: one of them takes all their places
    found = staging.keyed(docs).join(staging.broadcast_if_few(single), key).select("row", "place")
    if not several.isEmpty():
        one = staging.keyed(docs).join(staging.broadcast_if_few(several), key).dropDuplicates(key)
        found = found.unionByName(one.select("row", F.explode("at").alias("place")))
    parts = max(1, docs.rdd.getNumPartitions())  # as large as those that were read, whatever a shuffle would make of them
    return found.repartitionByRange(parts, "place").sortWithinPartitions("place").select("row.*")


def keep_mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mixture that ends with its first source, with all their columns."""
    key = (staging.H1, staging.H2)
    light = staging.staged(staging.keyed(docs).select("row.doc_id", "row.source", *key), "sources")
    return staging.keep_rows(docs, mixed(light, ties=key, **how).select(*key, F.col("selected").alias("keep")))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(staging.table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS o FROM documents),
c AS (SELECT key, count(*) AS n FROM d GROUP BY key),
z AS (SELECT greatest({RESOLUTION}, count(*)) AS units FROM c),
s AS (SELECT key, n, (SELECT units FROM z) * pow(n, {EXPONENT}) / (SELECT sum(pow(n, {EXPONENT}) ORDER BY key) FROM c) AS share FROM c),
u AS (SELECT key, n, greatest(1, CAST(floor(share) AS BIGINT) + CAST(row_number() OVER (ORDER BY floor(share) - share, key)
        <= (SELECT units FROM z) - (SELECT CAST(sum(floor(share)) AS BIGINT) FROM s) AS BIGINT)) AS units FROM s),
p AS (SELECT CAST(sum(units) AS BIGINT) AS period FROM u),
k AS (SELECT list(key ORDER BY key) AS keys, list(units ORDER BY key) AS us FROM u WHERE units > 0),
e(slot, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(us, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM k
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, i: x + CAST(i = p AS BIGINT)), p FROM (
    SELECT slot, done, list_min(list_transform(range(1, len(us) + 1), lambda i:
      CASE WHEN done[i] < us[i] AND (done[i] * period) // us[i] <= slot + 1
           THEN (((done[i] + 1) * period + us[i] - 1) // us[i]) * 1000000 + i END)) % 1000000 AS p
    FROM e, k, p WHERE slot + 1 < period)),
plan AS (SELECT keys[pick] AS key, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM e, k WHERE slot >= 0),
r AS (SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY o, doc_id) - 1 AS rank FROM d),
b AS (SELECT r.*, rank // {BLOCK_ROWS} AS block, units FROM r JOIN u USING (key)),
h AS (SELECT min(m // units * (SELECT period FROM p) + plan.slot) AS horizon
      FROM (SELECT key, units, (n + {BLOCK_ROWS} - 1) // {BLOCK_ROWS} AS m FROM u WHERE units > 0) x
      JOIN plan ON plan.key = x.key AND plan.j = m % units)
SELECT doc_id, source, block, block // units * period + plan.slot AS slot,
       coalesce(block // units * period + plan.slot < horizon, false) AS selected,
       CASE WHEN block // units * period + plan.slot < horizon
            THEN (block // units * period + plan.slot) * {BLOCK_ROWS} + rank % {BLOCK_ROWS} END AS position
FROM b LEFT JOIN plan ON plan.key = b.key AND plan.j = CASE WHEN units > 0 THEN block % units END CROSS JOIN h CROSS JOIN p
"""
