"""Phased selection against a walk through the phases in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import dedup, sampling

SCHEMA = "id long, label string, kind string, score int, a boolean, b boolean"


def rows(seed, n):
    r = random.Random(seed)
    return [(i, r.choice(["x", "x", "x", "y", "z", None]), r.choice(["k", "l", None]), r.randint(0, 5), r.choice([True, False, None]), r.random() < 0.2) for i in range(n)]


def walk(table, phases, target, held=()):
    """phases: (name, wants, label's place, rule, counted rule, gap, key of the order)."""
    chosen, out = set(), []
    for name, wants, label, rule, counted, gap, order in phases:
        fits = lambda row, want: rule(row) and (label is None or row[label] == want)
        needs = {want: n - (sum(fits(h, want) for h in held) if gap else 0) for want, n in wants.items()}
        served = sorted(needs, key=lambda w: -needs[w]) if gap else list(needs)
        for want in served:
            need = needs[want] - (sum(bool(counted(r)) for r in table if r[0] in chosen) if counted else 0)
            new = sorted((r for r in table if r[0] not in chosen and fits(r, want)), key=order)[: max(need, 0)]
            chosen |= {r[0] for r in new}
            out += [(r[0], name) for r in new]
    return out[:target]


@pytest.mark.parametrize("seed,n", [(1, 400), (2, 90), (3, 0), (4, 5)])
def test_minimums(spark, seed, n):
    table = rows(seed, n)
    df = spark.createDataFrame(table, SCHEMA)
    got = sampling.with_minimums(df, "label", {"x": 30, "y": 20, "w": 9}, {"a": 60, "b": 25}, 95, "id", [F.col("score").desc(), F.col("id")])
    best, every = (lambda r: (-r[3], r[0])), (lambda r: True)
    want = walk(table, [("quota", {"x": 30, "y": 20, "w": 9}, 1, every, None, False, best), ("a", {"": 60}, None, lambda r: r[4], lambda r: r[4], False, best), ("b", {"": 25}, None, lambda r: r[5], lambda r: r[5], False, best), ("rest", {"": 95}, None, every, every, False, best)], 95)
    assert [(r.id, r.phase) for r in got.orderBy("turn").collect()] == want


@pytest.mark.parametrize("seed,n", [(5, 500), (6, 60), (7, 0)])
def test_gaps(spark, seed, n):
    table, held = rows(seed, n), rows(seed + 100, n // 4)
    df, have = spark.createDataFrame(table, SCHEMA), spark.createDataFrame(held, SCHEMA)
    last = [F.col("id").desc()]
    phases = [
        sampling.Phase("labels", {"y": 30, "x": 90, "z": 41}, "label", gap=True),
        sampling.Phase("kinds", {"l": 60, "k": 62}, "kind", gap=True),
        sampling.Phase("b", {"": 40}, where=F.col("b"), gap=True),
        sampling.Phase("others", {"": 170}, where=F.col("label") != "x", counted=F.lit(True), order=last),
        sampling.Phase("rest", {"": 200}, counted=F.lit(True), order=last),
    ]
    got = sampling.phased(df, phases, "id", [F.col("score").desc(), F.col("id")], have=have)
    best, back, every = (lambda r: (-r[3], r[0])), (lambda r: -r[0]), (lambda r: True)
    plain = [("labels", {"y": 30, "x": 90, "z": 41}, 1, every, None, True, best), ("kinds", {"l": 60, "k": 62}, 2, every, None, True, best), ("b", {"": 40}, None, lambda r: r[5], None, True, best), ("others", {"": 170}, None, lambda r: r[1] not in ("x", None), every, False, back), ("rest", {"": 200}, None, every, every, False, back)]
    assert [(r.id, r.phase) for r in got.orderBy("turn").collect()] == walk(table, plain, None, held)


def test_first_n_of_a_hot_group_in_two_steps(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"), (F.col("id") % 7).alias("s")).withColumn("n", F.when(F.col("g") == "hot", 40).otherwise(600))
    order = [F.col("s").desc(), F.col("id")]
    got, want = (dedup.top_per_group(df, ["g"], order, F.col("n"), spread=spread) for spread in ("id", None))
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 540
