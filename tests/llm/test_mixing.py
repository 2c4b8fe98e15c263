import pytest

from quern.llm import mixing


@pytest.mark.parametrize("units", [{"a": 1}, {"a": 1, "b": 1}, {"a": 700, "b": 299, "c": 1}, {"a": 3, "b": 5, "c": 7, "d": 11, "e": 13}, {f"s{i}": 37 + i for i in range(20)}])
def test_less_than_one_block_of_deviation(units):
    period, done = sum(units.values()), dict.fromkeys(units, 0)
    for slot, (source, j, at) in enumerate(pairs := mixing.pfair_period(units)):
        assert at == slot and j == done[source]
        done[source] += 1
        assert all(abs(done[s] - u * (slot + 1) / period) < 1 for s, u in units.items())
    assert len(pairs) == period and done == units


def test_units_sum_to_the_resolution():
    assert sum(mixing.tempered_units({"a": 5, "b": 17, "c": 10**9}).values()) == 1000
    assert mixing.tempered_units({}) == {} and mixing.tempered_units({"a": 0}) == {}
    with pytest.raises(ValueError):
        mixing.tempered_units({str(i): 1 for i in range(9)}, resolution=8)


def test_positions_follow_the_plan(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN null ELSE concat('s', id % 4) END AS source")
    got = mixing.mixed(docs, block_rows=4).collect()
    assert len(got) == 900
    chosen = sorted((r["position"], r["source"]) for r in got if r["selected"])
    counts = {}
    for r in docs.collect():
        counts["=" + r["source"] if r["source"] else ""] = counts.get("=" + r["source"] if r["source"] else "", 0) + 1
    units = mixing.tempered_units(counts)
    plan = mixing.pfair_period(units)
    for position, source in chosen:
        assert plan[position // 4 % len(plan)][0] == ("=" + source if source else "")
    # only a source's last block can be short, so positions have few gaps and none repeats
    assert len({p for p, _ in chosen}) == len(chosen) and chosen[-1][0] + 1 - len(chosen) < 4 * len(units)
    again = mixing.mixed(docs.repartition(7), block_rows=4).collect()
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(again, key=lambda r: r["doc_id"])


def test_weights_given(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "if(id < 50, 'a', 'b') AS source")
    got = mixing.mixed(docs, {"=a": 3, "=b": 1}, block_rows=1).collect()
    n = {s: sum(r["selected"] for r in got if r["source"] == s) for s in "ab"}
    assert n["a"] == 50 and abs(n["b"] - 50 / 3) < 1.5
    assert not any(r["selected"] for r in mixing.mixed(docs, {"=a": 1, "=b": 0}, block_rows=1).collect() if r["source"] == "b")


def test_odd_rows(odd, none):
    assert mixing.mixed(odd).count() == odd.count()
    assert mixing.mixed(none).count() == 0 and mixing.keep_mixed(none).count() == 0
    assert mixing.keep_mixed(odd).columns == odd.columns


def test_sources_beyond_the_resolution_are_counted(spark):
    docs = spark.range(2200).selectExpr("id AS doc_id", "concat('s', id % 1100) AS source")
    got = mixing.mixed(docs, {f"=s{i}": 1 for i in range(1100)}, block_rows=1)
    assert got.where("selected").count() == 2200


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 900, "b": 3}, {"a": 50_000, "b": 1}, {f"s{i}": int(9000 / i**1.5) for i in range(1, 41)}])
def test_a_dry_source_does_not_end_the_whole_mixture(counts):
    units = mixing.whole_units(counts)
    assert set(units) == set(counts) and min(units.values()) >= 1
    spans, places = mixing.whole_plan(counts, units)
    slots = {(s, p, j): slot for s, p, j, slot in places}
    at = sorted((slots[s, p, (b - first) % u] + (b - first) // u * period, s) for s, p, first, end, u, period in spans for b in range(first, end))
    assert [t for t, _ in at] == list(range(sum(counts.values())))  # every slot once
    done = dict.fromkeys(counts, 0)
    for t, s in at:
        done[s] += 1
        assert all(abs(done[k] - u * (t + 1) / sum(units.values())) < 1 for k, u in units.items())
        if any(done[k] == n for k, n in counts.items()):
            break


def test_the_stage_keeps_rare_and_common_sources(spark):
    """One source of 40 rows among common ones; rows without doc_id, and equal rows, keep their number too."""
    docs = spark.range(6040).selectExpr("if(id % 50 = 3, null, id div 2 * 2) AS doc_id", "concat('text ', id div 2) AS text", "if(id < 40, 'rare', concat('s', id % 6 div 2)) AS source")
    got = mixing.in_mixed_order(docs, block_rows=4)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == docs.columns and sorted(rows, key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    units = mixing.whole_units({"rare": 40, "s0": 2000, "s1": 2000, "s2": 2000})
    done = dict.fromkeys(units, 0)
    for n, (_, _, source) in enumerate(rows[:800], 1):
        done[source] += 1
        assert all(abs(done[s] - u * n / sum(units.values())) < 8 for s, u in units.items())


def test_rows_are_kept_one_by_one(spark):
    """Rows that share a doc_id, have none, or are equal: as many stay as are selected, of each source."""
    docs = spark.range(400).selectExpr("if(id % 5 = 0, null, id % 40) AS doc_id", "if(id % 2 = 0, 'same', concat('t', id)) AS text", "if(id < 30, 'a', 'b') AS source")
    want = mixing.mixed(docs, {"=a": 1, "=b": 1}, block_rows=1).where("selected").groupBy("source").count().collect()
    got = mixing.keep_mixed(docs, units={"=a": 1, "=b": 1}, block_rows=1)
    assert sorted(map(tuple, want)) == sorted(map(tuple, got.groupBy("source").count().collect())) == [("a", 30), ("b", 30)]
    assert got.exceptAll(docs).count() == 0


def test_weights_for_two_of_two_thousand_sources(spark):
    docs = spark.range(24_000).selectExpr("id AS doc_id", "concat('s', id % 2000) AS source")
    for keys in (("s3", "s1999"), ("s0", "s1"), ("s77", "s1500")):
        got = mixing.mixed(docs, {f"={keys[0]}": 2, f"={keys[1]}": 1}, block_rows=1).where("selected").groupBy("source").count().collect()
        assert dict(map(tuple, got)) == {keys[0]: 12, keys[1]: 6}


def test_tempered_weights_of_many_and_of_small_sources(spark):
    """More sources than the resolution, one of them with most rows: each has a unit, and its rows have places."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "if(id < 2000, concat('s', id), 'large') AS source")
    got = mixing.mixed(docs, block_rows=1)
    assert got.count() == 9000 and got.where("slot IS NULL").count() == 0
    counts = {f"=s{i}": 1 for i in range(2000)} | {"=large": 7000}
    assert min(mixing.whole_units(counts).values()) >= 1
    assert got.where("selected").count() > 1500


def test_sources_that_are_repeated(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "if(id < 100, 'small', 'large') AS source")
    units = {"=small": 1, "=large": 3}
    once = mixing.mixed(docs, units, block_rows=1).where("selected")
    often = mixing.mixed(docs, units, block_rows=1, repeats={"=small": 3}).where("selected")
    for df, small in ((once, 100), (often, 300)):  # the mixture ends before the slot in which small would come again
        n = {r["source"]: r["count"] for r in df.groupBy("source").count().collect()}
        assert n["small"] == small and 0 <= n["large"] - 3 * small < 4
        assert df.select("position").distinct().count() == sum(n.values())
    assert often.where("source = 'small'").groupBy("doc_id").count().where("count <> 3").count() == 0
