import pytest

from quern.llm import shards, staging


def log_of(spark, docs, **how):
    return shards.ShardLog(spark, staging.new_path(spark, "log"), docs.schema, **how)


def test_arrivals_compact_and_keep_every_row(spark, odd):
    log = log_of(spark, odd)
    for i in range(5):
        assert log.append(odd.coalesce(1)) == i + 1
    before = sorted(map(repr, log.read().collect()))
    assert before == sorted(5 * [*map(repr, odd.collect())])
    assert len(log.shards()) == 5
    version = log.compact()
    assert version == 6 and len(log.shards()) == 1
    assert sorted(map(repr, log.read().collect())) == before
    assert len(log.shards(5)) == 5 and log.read(5).count() == 5 * odd.count()  # the older version can still be read
    log.vacuum()
    assert sorted(map(repr, log.read().collect())) == before


def test_tiers_merge_alike_sizes_only(spark):
    log = shards.ShardLog(spark, staging.new_path(spark, "log"), "id long", target_bytes=1 << 40, ratio=4.0, min_runs=3)
    for n in (10, 20, 200_000, 15):
        log.append(spark.range(n).coalesce(1))
    sizes = sorted(s["bytes"] for s in log.shards())
    log.compact()
    left = sorted(s["bytes"] for s in log.shards())
    assert len(left) == 2 and left[-1] == sizes[-1]
    assert log.read().count() == 200_045


def test_two_writers_cannot_commit_one_version(spark, odd):
    log = log_of(spark, odd)
    log.append(odd)
    base = log.version()
    assert log.commit(base, []) == base + 1
    with pytest.raises(shards.CommitConflict):
        log.commit(base, [])
    assert log.shards() == []


def test_a_compaction_that_lost_its_shards_gives_up(spark, odd):
    log = log_of(spark, odd)
    log.append(odd)
    with pytest.raises(shards.CommitConflict):
        log._commit_change([{"path": "gone", "bytes": 1}], [])


def test_empty(spark, odd, none):
    log = log_of(spark, odd)
    assert log.read().count() == 0 and log.compact() == 0
    log.append(none)
    assert log.version() == 1 and log.read().count() == 0
    assert log.read().columns == odd.columns


def test_query_returns_every_row(spark, sf):
    got = shards.op2_shard_compaction(spark, sf)
    assert got.count() == staging.table(spark, sf, "documents").count()


def test_files_do_not_miss_the_target(spark):
    """Many small shards and a small target: no output of more than the target by half, whatever the number of cores."""
    docs = spark.range(48_000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 512) AS text", "id % 16 AS arrival")
    log = shards.ShardLog(spark, staging.new_path(spark, "log"), docs.schema, target_bytes=1 << 20)
    log.append_each(docs.coalesce(1), "arrival")
    before = [s["bytes"] for s in log.shards()]
    assert len(before) == 16 and max(before) < 1 << 19
    log.compact()
    after = [s["bytes"] for s in log.shards()]
    assert max(after) <= 1.5 * (1 << 20) and len(after) <= 2 * sum(before) / (1 << 20) + 4
    assert log.read().count() == 48_000 and log.read().select("doc_id").distinct().count() == 48_000


def test_batches_hold_all_shards_once(spark):
    log = shards.ShardLog(spark, "unused", "id long", target_bytes=100)
    run = [{"path": str(i), "bytes": 1 + i * 37 % 49} for i in range(500)]
    cut = log.batches(run, 3)
    assert sorted(s["path"] for b in cut for s in b) == sorted(s["path"] for s in run)
    assert all(sum(s["bytes"] for s in b) <= 300 and len(b) > 1 for b in cut)
    assert log.batches([], 3) == []


def test_columns_named_like_the_arrival_stay(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "id * 2 AS arrival", "id * 3 AS __arrival", "id % 3 AS by")
    log = log_of(spark, docs)
    log.append_each(docs, "by")
    assert sorted(map(tuple, log.read().collect())) == sorted(map(tuple, docs.collect()))


def on_disk(log):
    files, size = log.fs.listFiles(log._path("data"), True), 0
    while files.hasNext():
        size += files.next().getLen()
    return size


def test_many_partitions_of_short_rows(spark):
    """211 partitions and 8 arrivals: a few shards each, and never 3 times the input on disk."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 512) AS text", "id % 8 AS arrival")
    at = staging.new_path(spark, "short")
    docs.repartition(211).write.parquet(at)
    arrivals = spark.read.parquet(at)
    log = shards.ShardLog(spark, staging.new_path(spark, "log"), arrivals.schema, target_bytes=1 << 20)
    whole = shards.ShardLog(spark, staging.new_path(spark, "whole"), arrivals.schema)
    whole.append(arrivals.coalesce(1))
    log.append_each(arrivals, "arrival")
    assert log.version() == 8 and len(log.shards()) <= 8 * spark.sparkContext.defaultParallelism
    log.compact()
    assert on_disk(log) < 3 * on_disk(whole)
    assert max(s["bytes"] for s in log.shards()) <= 1.5 * (1 << 20)
    assert sorted(map(tuple, log.read().collect())) == sorted(map(tuple, docs.collect()))


def test_what_a_compaction_wrote_and_merged_again_goes(spark):
    log = shards.ShardLog(spark, staging.new_path(spark, "log"), "id long", target_bytes=1 << 40, ratio=1.3, min_runs=2)
    for n in (1000, 1000, 2000, 2000, 5000, 5000):
        log.append(spark.range(n).coalesce(1))
    first = log.version()
    log.compact()
    assert log.version() > first + 1
    assert log.read(first).count() == log.read().count() == 16_000
    held = log._path("data")
    files, paths = log.fs.listFiles(held, True), set()
    while files.hasNext():
        f = files.next().getPath()
        if f.getName().endswith(".parquet"):
            paths.add(f.toUri().getPath()[len(held.toUri().getPath()) + 1 :])
    assert paths == {s["path"] for v in (first, log.version()) for s in log.shards(v)}
