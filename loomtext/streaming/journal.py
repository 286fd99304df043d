"""A journal of events that each event enters once, whatever is sent or run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What tells an event from others.
KEYS = ("trace_id", "command", "timestamp")


def append_batch(events: DataFrame, path: str, batch: int) -> None:
    """Put the events of a batch into the journal: its own folder, which a rerun of the batch replaces."""
    events.write.mode("overwrite").json(f"{path}/batch={batch:012d}")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All events of a journal, without their batches."""
    return spark.read.schema(f"{schema}, batch bigint").json(path).drop("batch")


def keep(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = KEYS, late: str = "1 hour"):
    """Write a stream of events (with ``time``) to the journal at path, all that is there now; returns the started query.

    Events equal in keys enter once if they come within ``late`` of each other by event time: the keys met are state, dropped behind the watermark. A
    micro-batch that is run again, after a crash between its write and its commit, replaces its folder, so that each event is there once.
    """
    unique = stream.withWatermark("time", late).dropDuplicatesWithinWatermark(list(keys))
    writer = unique.drop("time").writeStream.foreachBatch(lambda batch, n: append_batch(batch, path, n))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
