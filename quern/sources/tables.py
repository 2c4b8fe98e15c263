"""Readers and writers: driver tables, JSON lines, CSV with alternate headers, envelopes, and whole-table changes."""

from __future__ import annotations

import contextlib
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows and, apart from them, the lines that are not JSON. ``path`` may be a glob over chunks; blank lines are skipped."""
    read = spark.read.schema(f"{schema}, __bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad")
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return read.where(F.col("__bad").isNull()).drop("__bad"), parsed.where(F.col("r.__bad").isNotNull()).select(F.col("value").alias("line"))


def csv_table(spark: SparkSession, path: str, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """A CSV with a header; each column is the first of its alternate header names that the file has, else null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    known = {c.strip().lower(): c for c in raw.columns}
    pick = lambda names: next((F.col(f"`{known[n.lower()]}`") for n in names if n.lower() in known), F.lit(None).cast("string"))
    return raw.select(*[pick([name, *names]).alias(name) for name, names in columns.items()])


def json_envelope(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The items of an array or of an envelope's ``field``; a missing file is an empty table."""
    empty = spark.createDataFrame([], schema)
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    items = F.coalesce(F.from_json("value", f"{field} array<struct<{schema}>>")[field], F.from_json("value", f"array<struct<{schema}>>"))
    return whole.select(F.explode(items).alias("r")).select("r.*")


def select(df: DataFrame, columns: Sequence[str] = (), where: Mapping = {}, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:  # noqa: B006
    """Projection, equality filters, order and limit of a table; filters and columns reach the scan."""
    for name, value in where.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    df = df.orderBy(*order) if order else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*columns) if columns else df


def combined(sources: Mapping[str, DataFrame], mode: str) -> DataFrame:
    """The tables that a mode names: one of them, or all with ``combined``; an unknown mode is the first."""
    chosen = sources if mode == "combined" else {mode: sources[mode]} if mode in sources else dict([next(iter(sources.items()))])
    out = None
    for name, df in chosen.items():
        tagged = df.withColumn("source_table", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def without_internal(df: DataFrame) -> DataFrame:
    """The columns whose names do not begin with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def write_json(df: DataFrame, path: str) -> None:
    without_internal(df).write.json(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column] | None = None) -> DataFrame:
    """``old`` in which the rows of ``new`` replace or join those of the same key.

    Of several new rows of a key the last by ``order`` stays, or by all their columns where none is given.
    """
    last = Window.partitionBy(key).orderBy(*[c.desc() for c in order or [F.col(c) for c in new.columns if c != key] or [F.lit(0)]])
    chosen = new.withColumn("__last", F.row_number().over(last)).where("__last = 1").drop("__last")
    return old.join(chosen.select(key), key, "left_anti").unionByName(chosen)


def insert(df: DataFrame, table_name: str) -> None:
    """Append rows to a table."""
    df.write.mode("append").insertInto(table_name) if df.sparkSession.catalog.tableExists(table_name) else df.write.saveAsTable(table_name)


def merged_object(document: Column, patch: Column) -> Column:
    """A map with the keys of another one over its own; null counts as empty."""
    new = F.coalesce(patch, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(F.coalesce(document, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k)), new)


def profile_of(profiles: DataFrame, user_id, schema: str, column: str = "profile_data") -> DataFrame:
    """The profile of one user, at most one row: a JSON column read by ``schema``, with the user_id filled in."""
    row = profiles.where(F.col("user_id") == F.lit(user_id)).limit(1)
    return row.select("user_id", F.from_json(F.col(column), schema).alias("p")).select("user_id", *[f"p.{f.name}" for f in profiles.sparkSession.createDataFrame([], schema).schema if f.name != "user_id"])


@contextlib.contextmanager
def cached(df: DataFrame):
    """``df`` kept in memory and on disk for as long as the block lasts."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def update(df: DataFrame, changes: Mapping[str, Column], where: Column) -> DataFrame:
    return df.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in changes.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")
