"""Live views of running work, as Structured Streaming. Events later than the watermark are dropped.

What needs a timer, or state that ends, is in ``timed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_EVENT = "run_id string, task_id string, event string, status string, duration_s double, ready long, ts timestamp"


def task_events(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of task events from JSON lines below a folder: ready, start, end. Broken lines, and events of
    other kinds, are dropped."""
    rows = spark.readStream.schema(TASK_EVENT).option("maxFilesPerTrigger", max_files).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("event").isin("ready", "start", "end") & F.col("run_id").isNotNull())


def event_time(rows: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a time zone: session time, set to UTC."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def run_counters(events: DataFrame) -> DataFrame:
    """Per run: ready, running, completed, failed, and what is needed for the time saved so far.
    Events (run_id, event, status, duration_s, ts): ready, start and end of tasks."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    start, end = F.col("event") == "start", F.col("event") == "end"
    return events.groupBy("run_id").agg(
        (n(F.col("event") == "ready") - n(start)).alias("ready"), (n(start) - n(end)).alias("running"), n(end & (F.col("status") == "succeeded")).alias("completed"), n(end & F.col("status").isin("failed", "timed_out")).alias("failed"),
        F.coalesce(F.sum(F.when(end & (F.col("status") != "skipped"), F.col("duration_s"))), F.lit(0.0)).alias("done_s"), F.min(F.when(start, F.col("ts"))).alias("began"),
        F.sum(F.when(start, F.unix_micros("ts")).when(end, -(F.unix_micros("ts") - F.col("duration_s") * 1e6)).otherwise(0)).alias("open_start_us"),
    )


def saved_so_far(counters: DataFrame, now) -> DataFrame:
    """Completed and active runtime less the time elapsed, at least 0; 0 after any failure. ``now``: a time, or a column of them."""
    us = F.unix_micros(F.lit(now).cast("timestamp"))
    active = (F.col("running") * us - F.col("open_start_us")) / 1e6
    gone = (us - F.unix_micros("began")) / 1e6
    return counters.withColumn("saved_s", F.when(F.col("failed") > 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("done_s") + active - gone)))


def sessions(heartbeats: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """(session_id, first_at, stale_at, beats): spans of heartbeats; a session is stale ``gap`` after its last."""
    w = F.session_window("ts", gap)
    return event_time(heartbeats).withWatermark("ts", late).groupBy("session_id", w).agg(F.count("*").alias("beats")).select("session_id", F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("stale_at"), "beats")


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark: call ids, credits."""
    return event_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def capacity_signal(rows: DataFrame, late: str = "30 seconds", width: str = "5 seconds") -> DataFrame:
    """Least capacity and highest load per refresh window."""
    return event_time(rows).withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.min("capacity").alias("capacity"), F.max("load").alias("load")).select(F.col("window.start").alias("window_start"), "capacity", "load")
