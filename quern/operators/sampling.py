"""Stratified, balanced and gap-filling selection of documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import dedup


def stratum(label: Column, kind: Column) -> Column:
    """``label::kind``; a missing or generic label is Unknown, a missing kind unknown."""
    generic = label.isNull() | F.lower(label).isin("other", "unknown", "")
    return F.concat_ws("::", F.when(generic, F.lit("Unknown")).otherwise(label), F.coalesce(kind, F.lit("unknown")))


def allocate_seats(strata: DataFrame, target: int, floor: int = 50) -> DataFrame:
    """stratum, rows, seats: strata of up to ``floor`` rows keep all; what is left of ``target`` is shared among the others in
    proportion, by largest remainders (equal ones in order of ``first_seen``), and capped by their rows.

    ``strata`` has one row per stratum: a small table, which is why its windows may be global.
    """
    total, every = Window.partitionBy(), Window.orderBy(F.col("part").desc(), "first_seen")
    counted = strata.withColumn("large", F.col("rows") > floor)
    counted = counted.withColumn("left", F.lit(target) - F.coalesce(F.sum(F.when(~F.col("large"), F.col("rows"))).over(total), F.lit(0)))
    counted = counted.withColumn("mass", F.sum(F.when(F.col("large"), F.col("rows"))).over(total))
    raw = F.when(F.col("large") & (F.col("left") > 0), F.col("rows") / F.col("mass") * F.col("left"))
    counted = counted.withColumn("raw", raw).withColumn("whole", F.floor("raw")).withColumn("part", F.col("raw") - F.col("whole"))
    counted = counted.withColumn("spare", F.col("left") - F.coalesce(F.sum("whole").over(total), F.lit(0)))
    counted = counted.withColumn("turn", F.row_number().over(every))
    extra = F.when(F.col("part").isNotNull() & (F.col("turn") <= F.col("spare")), 1).otherwise(0)
    seats = F.when(~F.col("large"), F.col("rows")).otherwise(F.least(F.coalesce(F.col("whole") + extra, F.lit(0)), F.col("rows")))
    return counted.select("stratum", "rows", seats.cast("long").alias("seats"))


def stratified(df: DataFrame, target: int, floor: int, score: str, key: str) -> DataFrame:
    """The best rows of each stratum by score, ties to the smaller key, as many as it has seats."""
    strata = df.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first_seen"))
    seated = df.join(F.broadcast(allocate_seats(strata, target, floor).drop("rows")), "stratum")
    return dedup.top_per_group(seated, ["stratum"], [F.col(score).desc(), F.col(key)], F.col("seats"), spread=key)


@dataclass(frozen=True)
class Phase:
    """One phase of ``phased``: rows that meet ``where``, the first by ``order``, as many of each label as it wants.

    ``wants`` maps labels to numbers in the order in which they are served; without ``label`` its one key is "". Rows chosen
    before that meet ``counted`` count towards the number (for phases without label); with ``gap`` those count that the
    collection already has.
    """

    name: str
    wants: Mapping[str, int]
    label: str | None = None
    where: Column | None = None
    counted: Column | None = None
    gap: bool = False
    order: Sequence[Column] | None = None

    def entry(self, i: int) -> Column:
        """(phase, label) of a row, null where it does not meet ``where``."""
        label = F.lit("") if self.label is None else F.col(self.label).cast("string")
        return F.when(F.lit(True) if self.where is None else self.where, F.struct(F.lit(i).alias("__phase"), label.alias("__label")))


def _entries(phases: Mapping[int, Phase]) -> Column:
    return F.inline(F.array_compact(F.array(*[p.entry(i) for i, p in phases.items()])))


def _asked(df: DataFrame, phases: Sequence[Phase], have: DataFrame | None) -> DataFrame:
    """__phase, __label, __need, __place, __limit: one row for each number asked for, none where nothing is needed.

    Rows chosen before a phase are at most all that was asked for before it, so the first ``__limit`` rows hold its choice.
    """
    rows, before = [], 0
    for i, p in enumerate(phases):
        rows += [(i, label, n, place, before) for place, (label, n) in enumerate(p.wants.items())]
        before += sum(p.wants.values())
    asked = df.sparkSession.createDataFrame(rows, "__phase int, __label string, __need int, __place int, __before int")
    gaps = {i: p for i, p in enumerate(phases) if p.gap}
    if gaps:
        held = have.select(_entries(gaps)).groupBy("__phase", "__label").agg(F.count(F.lit(1)).alias("__held"))
        asked = asked.join(held, ["__phase", "__label"], "left").withColumn("__need", F.greatest(F.lit(0), F.col("__need") - F.coalesce("__held", F.lit(0))).cast("int"))
    widest_first = F.when(F.col("__phase").isin(*gaps), -F.col("__need")).otherwise(0)
    limit = (F.col("__before") + F.col("__need")).alias("__limit")
    return asked.where("__need > 0").select("__phase", "__label", "__need", F.struct(widest_first.alias("first"), F.col("__place").alias("second")).alias("__place"), limit)


def phased(df: DataFrame, phases: Sequence[Phase], key: str, order: Sequence[Column], target: int | None = None, have: DataFrame | None = None) -> DataFrame:
    """Rows chosen phase by phase, each row once, with ``phase`` (its name) and ``turn`` (from 1, in the order of choice: by
    phase, then label as served, gaps widest first, then ``order``). ``target`` cuts what comes after that turn.

    ``key`` must be unique and not null and ``order`` total; a null label, ``where`` or ``counted`` meets nothing; fewer
    rows than wanted give what there is. ``df`` should be narrow: join the rest by key afterwards.

    The table is read once for each order in use. Every phase keeps as many first rows of a label as it and all phases
    before it may take, found in two steps; the phases then run by windows over these candidates alone, whose number is
    bounded by the numbers asked for, not by the table, and no count passes through the driver.
    """
    asked, runs = _asked(df, phases, have), {}
    for i, p in enumerate(phases):
        runs.setdefault(None if p.order is None else id(p.order), {})[i] = p
    some = None
    for members in runs.values():
        by = next(iter(members.values())).order or order
        tried = df.select("*", _entries(members)).join(F.broadcast(asked), ["__phase", "__label"])
        first = dedup.top_per_group(tried, ["__phase", "__label"], by, F.col("__limit"), spread=key)
        some = first if some is None else some.unionByName(first)
    needs = F.map_from_entries(F.collect_list(F.struct("__phase", F.struct("__label", "__need", "__place"))))
    row = F.any_value(F.struct(*[F.col(c) for c in df.columns])).alias("__row")
    state = some.groupBy(F.col(key).alias("__id")).agg(row, needs.alias("__needs")).select("__row.*", "__needs")
    state = state.withColumns({"__chosen": F.lit(None).cast("int"), "__rank": F.lit(None).cast("int"), "__place": F.lit(None).cast("struct<first:int,second:int>")})
    for i, p in enumerate(phases):
        ask = F.try_element_at("__needs", F.lit(i))
        state = state.withColumns({"__ask": ask, "__fits": F.col("__chosen").isNull() & ask.isNotNull()})
        need = F.col("__ask.__need")
        if p.counted is not None:
            held = F.count(F.when(F.col("__chosen").isNotNull() & p.counted, 1)).over(Window.partitionBy())
            need = need - held
        rank = F.row_number().over(Window.partitionBy("__fits", "__ask.__label").orderBy(*(p.order or order)))
        state = state.withColumns({"__turn": rank, "__want": need}).withColumn("__now", F.col("__fits") & (F.col("__turn") <= F.col("__want")))
        taken = {"__chosen": F.lit(i), "__rank": F.col("__turn"), "__place": F.col("__ask.__place")}
        state = state.withColumns({c: F.when(F.col("__now"), v).otherwise(F.col(c)) for c, v in taken.items()}).drop("__ask", "__fits", "__turn", "__want", "__now")
    name = F.element_at(F.array(*[F.lit(p.name) for p in phases]), F.col("__chosen") + 1).alias("phase")
    turn = F.row_number().over(Window.orderBy("__chosen", "__place", "__rank")).alias("turn")
    chosen = state.where("__chosen IS NOT NULL").select(*[F.col(c) for c in df.columns], name, turn)
    return chosen if target is None else chosen.where(F.col("turn") <= target)


def with_minimums(df: DataFrame, label: str, quotas: Mapping[str, int], minimums: Mapping[str, int], target: int, key: str, order: Sequence[Column]) -> DataFrame:
    """``phased`` by quotas of labels, then minimum numbers of rows with a flag, then the best of the rest up to ``target``.

    Titles must be unique beforehand (``dedup.keep_first``): each phase is then set-based. Quotas may exceed the target,
    and the last chosen then go.
    """
    flagged = [Phase(flag, {"": least}, where=F.col(flag), counted=F.col(flag)) for flag, least in minimums.items()]
    return phased(df, [Phase("quota", quotas, label), *flagged, Phase("rest", {"": target}, counted=F.lit(True))], key, order, target)


def balanced(df: DataFrame, label: str, quotas: Mapping[str, int], minimums: Mapping[str, int], target: int, key: str, order: Sequence[Column]) -> DataFrame:
    """``with_minimums`` whose trim keeps the best by ``order``, whatever the phase that chose them."""
    flagged = [Phase(flag, {"": least}, where=F.col(flag), counted=F.col(flag)) for flag, least in minimums.items()]
    chosen = phased(df, [Phase("quota", quotas, label), *flagged, Phase("rest", {"": target}, counted=F.lit(True))], key, order)
    return chosen.orderBy(*order).limit(target).drop("phase", "turn")


def gap_fill(df: DataFrame, have: DataFrame, label: str, targets: Mapping[str, int], key: str, order: Sequence[Column]) -> DataFrame:
    """New rows for the labels of which ``have`` holds fewer than their target, up to the gap."""
    table = df.sparkSession.createDataFrame([*targets.items()], f"{label} string, __target int")
    counts = have.groupBy(label).count()
    gaps = table.join(counts, label, "left").select(label, F.greatest(F.lit(0), F.col("__target") - F.coalesce("count", F.lit(0))).alias("__gap"))
    pool = df.join(have.select(key), key, "left_anti").join(F.broadcast(gaps), label)
    return dedup.top_per_group(pool, [label], order, F.col("__gap"), spread=key).drop("__gap", "rank_in_group")
