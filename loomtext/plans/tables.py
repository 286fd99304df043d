"""The tables that queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: The columns of a glossary that a query is given.
KNOWN = StructType([StructField("term", StringType()), StructField("score", IntegerType()), StructField("count", IntegerType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as telemetry: type as command, user as document, value as duration; errors fail, and purchases warn."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("command"),
        F.col("user_id").cast("string").alias("document_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("event_type") == "purchase").cast("int").alias("warning_count"),
    )


#: The same in SQL.
RUNS = """runs AS (SELECT event_id AS seq, event_type AS command, CAST(user_id AS VARCHAR) AS document_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms, event_type <> 'error' AS success, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS warning_count FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as timed segments: five seconds a turn and one a ten characters, each conversation a document."""
    c = table(spark, sf_dir, "conversations")
    start = (F.col("turn") * 5).cast("double")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("id"), "text", "role", start.alias("start_time"), (start + F.least(F.lit(50), F.length("text")) / 10).alias("end_time"))


TURNS = """turns AS (SELECT conv_id AS doc_id, turn AS id, text, role, CAST(turn * 5 AS DOUBLE) AS start_time, CAST(turn * 5 AS DOUBLE) + least(50, length(text)) / 10.0 AS end_time FROM conversations)"""
