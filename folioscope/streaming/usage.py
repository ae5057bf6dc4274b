"""Event-time streams over usage events; each has a batch form with the same result for closed windows.

Late policy: a watermark of ten minutes; later rows are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioscope.operators.graph import shared_dir

LATE = "10 minutes"


def read_events(spark: SparkSession, sf_dir: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parquet*")


def usage_trend(events: DataFrame, step: str = "1 hour") -> DataFrame:
    """Tumbling windows that the watermark has closed: page views, searches and the exact number of users.

    The events of one user and window become one row first (the state of the open windows), and closed windows are summed from these in a second
    aggregation of the same stream.
    """
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    per_user = events.withWatermark("created_at", LATE).groupBy(F.window("created_at", step), "user_id").agg(n("page_view").alias("page_views"), n("search").alias("searches"))
    w = per_user.groupBy(F.window("window", step)).agg(F.sum("page_views").alias("page_views"), F.sum("searches").alias("searches"), F.count("user_id").alias("users"))
    return w.select(F.col("window.start").alias("bucket"), "page_views", "searches", "users")


def sessions(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Session windows of each visitor."""
    w = events.withWatermark("created_at", LATE).groupBy("visitor_hash", F.session_window("created_at", gap))
    return w.agg(F.count("*").alias("events")).select("visitor_hash", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def failure_windows(events: DataFrame, limit: int = 5, length: str = "15 minutes", slide: str = "5 minutes") -> DataFrame:
    """Sliding windows in which a user fails at least ``limit`` times."""
    failed = events.filter("event_type = 'server_error' and user_id is not null").withWatermark("created_at", LATE)
    return failed.groupBy("user_id", F.window("created_at", length, slide)).agg(F.count("*").alias("failures")).filter(F.col("failures") >= limit).select("user_id", F.col("window.start").alias("started"), "failures")


def history(events: DataFrame) -> DataFrame:
    """Views per user and scholar, in update or complete mode."""
    return events.filter("event_type = 'page_view' and user_id is not null").groupBy("user_id", "scholar_id").agg(F.count("*").alias("view_count"), F.max("created_at").alias("last_viewed_at"))


def to_table(stream: DataFrame, spark: SparkSession, mode: str = "complete", path: str | None = None) -> DataFrame:
    """Runs the stream over all there is; complete results replace the table, others add to it, with the number of their batch.

    State and table lie in the shared folder. With the ``path`` of an earlier run the stream goes on where that one stopped; a batch that is
    run again replaces its own rows.
    """
    path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(schema if mode == "complete" else StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{path}/rows")
    return rows.select(stream.columns) if mode != "update" else rows


def latest_batch(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the rows of the last batch that has any."""
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.hint("merge").join(last, [key, "batch"]).drop("batch")
