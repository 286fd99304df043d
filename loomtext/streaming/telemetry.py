"""Telemetry as a stream (an extension): windows over a log that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_type string, command string, trace_id string, timestamp string, duration_ms bigint, success boolean, warning_count int, document_id string, prompt_name string"


def read(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """A folder of JSON lines as a stream; what isn't JSON is skipped."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", most_files).json(path)
    return rows.withColumn("time", F.to_timestamp("timestamp")).where("time IS NOT NULL")


def _totals(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("event_count"), F.count_if("success").alias("success_count"), F.sum("duration_ms").alias("duration_ms_total"), F.max("duration_ms").alias("duration_ms_max"))


def windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Totals by command and window; windows tumble, or slide if slide is given. Rows later than ``late`` are left out."""
    w = F.window("time", length, slide) if slide else F.window("time", length)
    out = _totals(events.withWatermark("time", late).groupBy(w.alias("w"), "command"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "command", "event_count", "success_count", "duration_ms_total", "duration_ms_max")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Totals by document and session: events no farther apart than gap."""
    out = _totals(events.withWatermark("time", late).groupBy(F.session_window("time", gap).alias("w"), "document_id"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "document_id", "event_count", "success_count", "duration_ms_total", "duration_ms_max")


def write(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Append finished windows to Parquet; with trigger_once all that is there now, then stop."""
    out = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if trigger_once else out).start(path)
