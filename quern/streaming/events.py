"""Streams of events: trending windows, sessions, first sightings within a watermark, and runs that resume.

Every run takes what has arrived since its checkpoint (``availableNow``) and ends; run again with the same folders, it goes
on where it stopped. That is how long loads resume here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def trending(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and values by window and type; windows older than the watermark are final."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return n.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", F.round("value", 3).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start_s, end_s, n of the sessions that the watermark has closed."""
    n = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", F.unix_timestamp("w.start").alias("start_s"), F.unix_timestamp("w.end").alias("end_s"), "n")


def first_sightings(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once; its repeats are told for as long as the watermark keeps it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_appending(stream: DataFrame, to: str, checkpoint: str) -> None:
    """Append what is final to a Parquet folder, exactly once a row."""
    stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_complete(stream: DataFrame, to: str, checkpoint: str) -> None:
    """Write the whole aggregate of every trigger over the one before; it holds a row for each group."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(to)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """A sink and a checkpoint below the shared folder of the session; a folder of this machine only where Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quern-stream-")
    base = f"{where.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"
