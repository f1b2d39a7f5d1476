"""Queries that run a stream over a test table and give what it wrote."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.storage import table
from loreweave.streaming import changes as st


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files: a folder of them, or one file in the scale's folder."""
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)  # bounds what a key has in one batch
    path = f"{sf_dir}/{name}.parquet"
    if Path(path.removeprefix("file:")).is_file():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def stream_event_counts(spark, sf_dir) -> DataFrame:
    """Events per six hours and kind; each batch gives the counts that it changed, and windows that the watermark has passed are dropped from the state."""
    events = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"))
    found = st.drain(st.counts_by_window(events, "6 hours"), "event-counts", "update")
    return found.groupBy(F.col("began").cast("timestamp_ntz").alias("began"), "event").agg(F.max_by("n", "batch").alias("n"))


def stream_change_queue(spark, sf_dir) -> DataFrame:
    """File changes by user from the event table; the state of each user's task after the last batch."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), kind.alias("event"))
    found = st.drain(st.change_queue(events), "change-queue", "update")
    return found.groupBy("path").agg(F.max_by(F.struct("kind", "status", "retries"), "batch").alias("t")).select("path", "t.*")


def stream_rate_limit(spark, sf_dir) -> DataFrame:
    """Per user, how many events pass a limit of three an hour, refused ones not counted."""
    requests = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("client"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("request"))
    found = st.drain(st.rate_limited(requests, 3, 3_600_000), "rate-limit")
    return found.groupBy("client").agg(F.count("*").alias("requests"), F.sum(F.col("passed").cast("int")).alias("passed"))


def stream_debounced(spark, sf_dir) -> DataFrame:
    """Events of each user gathered for an hour from the first one on: batches and events per user."""
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"))
    found = st.drain(st.debounced(events, 3_600_000, "1 day"), "debounced")
    return found.groupBy("path").agg(F.count("*").alias("batches"), F.sum("changes").alias("changes"))


def stream_handled_once(spark, sf_dir) -> DataFrame:
    """Files of the listings by version, each once however often delivered."""
    rows = _stream(spark, sf_dir, "file_snapshots").select(F.col("received_at").cast("timestamp").alias("ts"), "snapshot_no", "project_id", "path", "size", "mtime_ms")
    found = st.drain(st.handled_once(rows, ["snapshot_no", "project_id", "path", "size", "mtime_ms"], "30 days"), "handled-once")
    return found.groupBy("snapshot_no").agg(F.count("*").alias("files"))


QUERIES = {f.__name__: f for f in (stream_event_counts, stream_change_queue, stream_rate_limit, stream_debounced, stream_handled_once)}
SQL = {
    "stream_event_counts": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') AS began, event_type AS event, count(*) AS n FROM events GROUP BY ALL",
    "stream_change_queue": """WITH e AS (SELECT user_id::VARCHAR AS path, epoch_ms(ts) AS t, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS k FROM events)
SELECT path, list_reduce(list(k ORDER BY t, k), lambda a, b: CASE WHEN (a = 'deleted' AND b = 'created') OR (a = 'created' AND b = 'deleted') THEN 'modified' ELSE b END) AS kind, 'pending' AS status, 0 AS retries FROM e GROUP BY path""",
    "stream_handled_once": "SELECT snapshot_no, count(*) AS files FROM (SELECT DISTINCT snapshot_no, project_id, path, size, mtime_ms FROM file_snapshots) GROUP BY snapshot_no",
}
