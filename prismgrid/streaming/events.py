"""The append-only event log as a stream: tolerant reading, deduplication, stage pairing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.session import shared_folder

LOG = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_log(spark: SparkSession, folder: str, schema: str = LOG) -> DataFrame:
    """Stream of the JSON lines of a folder; cut and malformed lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def read_log_batch(spark: SparkSession, folder: str, schema: str = LOG) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def append_log(rows: DataFrame, folder: str) -> None:
    """Append rows as JSON lines, one object a line, nulls left out."""
    rows.write.mode("append").json(folder)


def run_to_end(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; files and their log make a restart exactly-once."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(target)
    q.awaitTermination()


def distinct_events(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Events delivered again within the lateness count once."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def stage_windows(stream: DataFrame, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Events and their sum per window and stage; closed windows only."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("starts_at"), "event_type", "events", "value")
    )


def replay(events: DataFrame) -> DataFrame:
    """Write events as a JSON log to the shared folder, stream it to a table, read that."""
    spark = events.sparkSession
    base = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    append_log(events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props"), f"{base}/log")
    run_to_end(read_log(spark, f"{base}/log"), f"{base}/table", f"{base}/state")
    return spark.read.schema(LOG).parquet(f"{base}/table")
