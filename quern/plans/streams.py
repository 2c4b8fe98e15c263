"""Queries over the events as a stream, run until all that is there has been taken."""

from __future__ import annotations

from quern.streaming import events


def stream_trending(spark, sf_dir):
    to, checkpoint = events.folders(spark, "trending")
    events.run_complete(events.trending(events.read_events(spark, f"{sf_dir}/events.parquet*")), to, checkpoint)
    return spark.read.parquet(to)


def stream_first_sightings(spark, sf_dir):
    """The stream with every event twice, told apart again by the watermark's state."""
    to, checkpoint = events.folders(spark, "sightings")
    stream = events.read_events(spark, f"{sf_dir}/events.parquet*")  # a pattern: the table may be one file
    events.run_appending(events.first_sightings(stream.union(stream)).select("event_id", "user_id", "event_type", "value"), to, checkpoint)
    return spark.read.parquet(to)


QUERIES = {
    "stream_trending": (stream_trending, "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY 1, 2"),
    "stream_first_sightings": (stream_first_sightings, "SELECT event_id, user_id, event_type, value FROM events"),
}
