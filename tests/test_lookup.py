import random

import pytest
from pyspark.sql import functions as F

from quern.operators import dedup, lookup
from quern.plans import streams
from quern.sources import tables
from quern.streaming import events


def plain_lookup(name, entries):
    """The same by trying every entry."""
    if name in entries:
        return name, 1
    for p in lookup.PHRASES:
        if name + p in entries:
            return name + p, 2
    starts = [e for e in entries if e.startswith((name + ",", name + " "))]
    if starts:
        pool = [e for e in starts if "raw" in e] or [e for e in starts if "cooked" in e or "steamed" in e] or starts
        return min(pool, key=lambda e: (len(e), e)), 3
    scored = sorted(((-lookup.likeness(name, e), len(e), e) for e in entries if lookup.likeness(name, e) >= 70))[:10]
    if not scored:
        return None
    plain = [r for r in scored if len(r[2].split(",")) <= 4 and (name in r[2].split(",")[0] or -r[0] >= 85)] or scored[:3]
    near = [r for r in plain if r[0] <= plain[0][0] + 10]
    return min(near, key=lambda r: (r[1], r[0], r[2]))[2], 4


def test_against_trying_every_entry(spark):
    draw = random.Random(4)
    bases = ["tomato", "tomatoes", "chicken", "chicken breast", "rice", "brown rice", "olive oil", "olives", "cheese", "egg", "eggplant"]
    tails = ["", ", raw", ", cooked", ", steamed, plain", " soup", ", white", " (average)", ", a, b, c, d", ", green, with much salt"]
    entries = sorted({draw.choice(bases) + draw.choice(tails) for _ in range(60)})
    names = sorted({*bases, *(b[:-1] for b in bases), *(b + "s" for b in bases), "breast chicken", "oil olive", "hcicken", "htmatoes", "ggeplnt", "unknown", "tomatoe soups", " Rice "})
    tiers = {"first": entries[:25], "second": entries[25:]}
    want = {}
    for n in {n.strip().lower() for n in names}:
        for tier, part in tiers.items():
            if (found := plain_lookup(n, set(part))) is not None:
                want[n] = (tier, *found)
                break
    frame = lambda column, items: spark.createDataFrame([(x,) for x in items], f"{column} string")
    got = lookup.tiered(frame("name", names), {t: frame("entry", part) for t, part in tiers.items()})
    assert {r["name"]: (r.tier, r.entry, r.rule) for r in got.collect()} == want and {v[2] for v in want.values()} == {1, 2, 3, 4}
    assert lookup.tiered(frame("name", []), {"t": frame("entry", entries)}).count() == 0 == lookup.tiered(frame("name", names), {"t": frame("entry", [])}).count()


@pytest.mark.parametrize("letters", ["ab ", "aé🍜, \u00a0", "abcdefghijklmnopqrstuvwxyz "])
def test_no_pair_that_is_alike_is_left_out(spark, letters):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, 16))).strip()
    entries = sorted({word() for _ in range(150)} - {""})

    def changed(e):
        e = list(e)
        for _ in range(draw.randint(0, 1 + len(e) // 3)):
            at = draw.randrange(len(e) + 1)
            e[at : at + draw.randint(0, 1)] = draw.choice(["", draw.choice(letters)])
        return "".join(e).strip()

    names = sorted({word() for _ in range(50)} | {changed(e) for e in entries} - {""})
    tries = {n: draw.randint(0, 2) for n in names}
    asked = spark.createDataFrame(list(tries.items()), "name string, tries int")
    got = [tuple(r) for r in lookup.alike_pairs(asked, spark.createDataFrame([(i % 2, e) for i, e in enumerate(entries)], "tier int, entry string")).collect()]
    want = {(n, i % 2, e) for n in names for i, e in enumerate(entries) if i % 2 < tries[n] and len("".join(n.split())) > 1 and lookup.likeness(n, e) >= 70}
    assert want <= set(got) and len(set(got)) == len(got) and len(want) > 30
    if len(letters) > 20:  # few others are tried
        assert len(got) < 0.05 * sum(tries.values()) * len(entries) / 2


@pytest.mark.parametrize("a,b,score", [("rice brown", "brown rice", 100.0), ("abc", "abd", 200 * 2 / 6), ("", "x", 0.0), ("", "", 100.0), ("kitten", "sitting", 200 * 4 / 13)])
def test_likeness(a, b, score):
    assert lookup.likeness(a, b) == pytest.approx(score) == pytest.approx(lookup.likeness(b, a))


def test_nutrition_by_serving(spark):
    nutrition = spark.createDataFrame([("rice", 100.0, *[1.26] * 7), ("salt", 0.5, *[0.0] * 7)], "name string, " + ", ".join(f"{n} double" for n in lookup.NUTRIENTS))
    docs = spark.createDataFrame([(1, ["Rice ", "rice", "x"], 3), (2, ["salt"], 0), (3, ["x"], 2), (4, [], 2), (5, None, None)], "id int, names array<string>, serves int")
    got = {r.id: (r.kcal, r.protein_g, r.salt_g) for r in lookup.nutrition_per_serving(docs, "id", F.col("names"), F.col("serves"), nutrition).collect()}
    assert got == {1: (66, 0.8, 0.84), 2: (1, 0.0, 0.0), 3: (None,) * 3, 4: (None,) * 3, 5: (None,) * 3}


def test_last_writer_is_the_last(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 9), (2, "e", 7), (3, "f", 1)], "k int, v string, t int")
    for merge in (dedup.last_writer, tables.upsert):
        assert sorted((r.k, r.v) for r in merge(old, new, "k", [F.col("t")]).collect()) == [(1, "a"), (2, "d"), (3, "f")]
    assert sorted(r.k for r in tables.upsert(old, new, "k").collect()) == [1, 2, 3]


def test_changes_of_tables(spark):
    r = spark.range(1).select(tables.merged_object(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"), tables.merged_object(F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>")).alias("n")).first()
    assert r.m == {"a": "1", "b": "3"} and r.n == {}
    for _ in range(2):
        tables.insert(spark.range(3), "inserted")
    assert spark.table("inserted").count() == 6
    profiles = spark.createDataFrame([(1, '{"skill": "advanced"}'), (2, None)], "user_id long, profile_data string")
    assert tuple(tables.profile_of(profiles, 1, "user_id long, skill string").first()) == (1, "advanced") and tables.profile_of(profiles, 9, "skill string").count() == 0
    with tables.cached(spark.range(5)) as kept:
        assert kept.count() == 5 and kept.is_cached


def test_streams_resume(spark, sf, tmp_path):
    """A second run over the same checkpoint takes only what has arrived since."""
    whole = spark.read.parquet(f"{sf}/events.parquet")
    for part in (0, 1):
        whole.where(f"event_id % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = events.first_sightings(events.read_events(spark, str(tmp_path / "in")), late="1000 days")
        events.run_appending(stream.select("event_id"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == whole.count() == got.distinct().count()


def test_sessions_of_a_stream(spark, sf, tmp_path):
    stream = events.sessions(events.read_events(spark, f"{sf}/events.parquet*"))
    events.run_complete(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    assert streams.stream_first_sightings(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
