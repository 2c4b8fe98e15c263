"""Shared helpers of the llm operators: reading tables and cutting lineage.

Intermediate tables are written below the folder that ``spark.checkpoint.dir`` names, which driver and
executors share, so a lost executor costs a re-read and never a recomputation of the whole plan.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quern-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def staged(df: DataFrame, name: str, keep: list | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again. ``keep`` is the list of a ``scratch`` block."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if keep is not None:
        keep.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python workers in batches of at most BATCH_BYTES, or one row: texts may be long.

    The session's own limit stays where it is lower; no result depends on it.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


BROADCAST_IDS = 2_000_000


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_few(ids: DataFrame) -> DataFrame:
    """Staged ``ids``, broadcast up to BROADCAST_IDS of them (some 50 MB at most): the texts then stay where they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids`` (one column), broadcast or shuffled as in ``without``."""
    name = free_name(docs, "__id")
    ids = broadcast_if_few(staged(ids.toDF(name), "ids"))
    return docs.join(ids, docs["doc_id"] == ids[name], "left_semi")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose doc_id is in ``gone`` (doc_id; null is an id like any other)."""
    name = free_name(docs, "__gone")
    ids = broadcast_if_few(staged(gone.select(F.col("doc_id").alias(name)), "gone"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[name]), "left_anti")


H1, H2 = "h1", "h2"


def keyed(docs: DataFrame) -> DataFrame:
    """(row, h1, h2): each row of ``docs`` as a struct, with two hashes of the whole row.

    So rows are told apart whatever their doc_id, and columns may have any names; equal rows share their hashes.
    """
    columns = [docs[f"`{c}`"] for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), F.xxhash64(*columns).alias(H1), F.xxhash64(F.lit("2"), *columns).alias(H2))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` but for the rows that ``decided`` (H1, H2, keep: one row each) drops, row by row and not by doc_id."""
    return keep_limits(docs, decided.groupBy(H1, H2).agg(F.count_if("keep").alias("left"), F.count(F.lit(1)).alias("n")))


def keep_limits(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``docs`` with ``left`` of the ``n`` rows that share H1 and H2, which are rows equal in all columns."""
    key = [H1, H2]
    limits = staged(counts.where("left < n").select(*key, "left"), "limits")
    kept = keyed(docs).join(broadcast_if_few(limits), key, "left_anti").select("row.*")
    partly = limits.where("left > 0")
    if partly.isEmpty():
        return kept
    one = keyed(docs).join(broadcast_if_few(partly), key).dropDuplicates(key)
    return kept.unionByName(one.withColumn("i", F.explode(F.expr("sequence(1, left)"))).select("row.*"))


@contextlib.contextmanager
def scratch():
    """Tables staged in this block are removed at its end, but for those whose path is added to the list it gives."""
    first, kept = len(_WRITTEN), []
    try:
        yield kept
    finally:
        mine = _WRITTEN[first:]
        _WRITTEN[first:] = [w for w in mine if w[1] in kept]
        for spark, path in mine:
            if path not in kept:
                remove(spark, path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and ``path`` as a Hadoop Path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have gone already; its files then stay in the shared folder
            return
