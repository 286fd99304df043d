"""Run telemetry: filters, summaries, percentiles, the tail of the log."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ..functions.controller import Rules, Run
from . import lineage


def matching(events: DataFrame, command: str = "", trace_id: str = "", document_id: str = "", success: bool | None = None) -> DataFrame:
    """Events whose fields, trimmed, equal those given; a missing success is false."""
    for c, v in (("command", command), ("trace_id", trace_id), ("document_id", document_id)):
        if v.strip():
            events = events.where(F.btrim(c) == v.strip())
    return events if success is None else events.where(F.coalesce("success", F.lit(False)) == success)


def last_events(events: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The last n events in ascending order; all of them if n is 0."""
    return events.orderBy(order) if n == 0 else events.orderBy(F.desc(order)).limit(n).orderBy(order)


def summary(events: DataFrame, order: str = "seq") -> DataFrame:
    """One row: counts, sums and extremes of events, first and last time by order of arrival."""
    duration = F.greatest(F.coalesce("duration_ms", F.lit(0)), F.lit(0))
    ok = F.coalesce("success", F.lit(False))
    return events.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        F.count_if(F.col("warning_count") > 0).alias("warning_event_count"),
        F.coalesce(F.sum("warning_count"), F.lit(0)).alias("warning_total"),
        F.coalesce(F.sum(duration), F.lit(0)).alias("duration_ms_total"),
        F.coalesce(F.floor(F.avg(duration)), F.lit(0)).cast("bigint").alias("duration_ms_avg"),
        F.coalesce(F.max(duration), F.lit(0)).alias("duration_ms_max"),
        F.min_by("timestamp", order).alias("first_timestamp"),
        F.max_by("timestamp", order).alias("last_timestamp"),
    )


def counts_by(events: DataFrame, column: str, blank: str | None = None) -> DataFrame:
    """(value, n) by a trimmed column in its order; blank values are counted as blank, or left out."""
    value = F.nullif(F.btrim(F.coalesce(F.col(column), F.lit(""))), F.lit(""))
    rows = events.select((F.coalesce(value, F.lit(blank)) if blank else value).alias("value")).where("value IS NOT NULL")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy("value")


def count_map(events: DataFrame, column: str, blank: str | None = None) -> DataFrame:
    """One row with a map of counts_by, keys in order; its size is that of the column's domain."""
    counted = counts_by(events, column, blank)
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))


#: Values of one key that a task sorts at most, and parts that a range of values is cut into to get there.
SORTED, PARTS = 1_000_000, 1024


def p95(events: DataFrame, value: str, by: str, share: float = 0.95, most: int = SORTED) -> DataFrame:
    """(by, p95): nearest rank among the positive values; null without any.

    By selection: of a key with more than ``most`` values only the counts of PARTS ranges are made, by partial sums, until the range that holds
    the rank has no more; then the values left are counted and only these counts are sorted. Such keys are fewer than one in
    ``most`` of all events, which bounds what is sent to the tasks; no key's values come together in one buffer, however many they are.
    """
    rows = events.select(F.struct(F.col(by).alias("v")).alias("k"), F.when(F.col(value) > 0, F.col(value)).alias("x"))
    rank = lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(share)))
    ranges = rows.groupBy("k").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where(F.col("n") > most)
    done, open_ = None, lineage.cut(ranges.withColumn("rank", rank(F.col("n"))).select("k", "n", "rank", "lo", "hi"))
    while open_.take(1):
        wide = (F.col("n") > most) & (F.col("lo").cast("double") < F.col("hi").cast("double"))
        narrow, due = open_.where(~wide), open_.where(wide)
        done = narrow if done is None else done.unionByName(narrow)
        begin = F.col("lo").cast("double")
        part = F.least(F.floor((F.col("x").cast("double") - begin) / ((F.col("hi").cast("double") - begin) / PARTS)), F.lit(PARTS - 1))
        met = rows.join(F.broadcast(due.select("k", "rank", "lo", "hi")), "k").where("x BETWEEN lo AND hi")
        counts = met.groupBy("k", "rank", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("part"))  # at most PARTS rows a key
        held = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        open_ = lineage.cut(held.select("k", "n", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi"))
    if done is None:
        kept = rows.withColumn("rank", F.lit(None).cast("bigint"))
    else:
        kept = rows.join(F.broadcast(done.select("k", "rank", "lo", "hi")), "k", "left").where("rank IS NULL OR x BETWEEN lo AND hi").select("k", "x", "rank")
    counts = kept.groupBy("k", "rank", "x").agg(F.count("x").alias("n"))
    w = Window.partitionBy("k")
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy(F.col("x").asc_nulls_first()))).withColumn("rank", F.coalesce("rank", rank(F.sum("n").over(w))))
    return counts.groupBy("k").agg(F.min(F.when(F.col("upto") >= F.col("rank"), F.col("x"))).alias("p95")).select(F.col("k.v").alias(by), "p95")


def status_counts(chunks: DataFrame, by: str, status: str = "status", kinds: tuple[str, ...] = ("pending", "running", "done", "failed", "superseded")) -> DataFrame:
    """(by, total, one column for each kind, other): statuses as a pivot."""
    s = F.coalesce(F.nullif(F.btrim(status), F.lit("")), F.lit("unknown"))
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == k).alias(k) for k in kinds], F.count_if(~s.isin(*kinds)).alias("other"))


def control(events: DataFrame, by: str, order: str, rules: Rules = Rules()) -> DataFrame:
    """(by, order, success, timeout, target, event, timeouts, ended): the controller of each group after each event (by, order, success, timeout, latency_ms).

    A fold over each group's events in order: a latency whose 95th percentile over the last ``window`` is above the
    threshold, or a timeout, shrinks the target; ``window`` successes in a row grow it. ended tells that the run should have ended: ``replan``
    if the target shrank within the canary, ``stopped`` by as many timeouts in a row as allowed. Groups are dealt over tasks and sorted
    there; a task holds the last ``window`` latencies of one group at a time, however long the group is. streaming.controller does the same on a stream.
    """
    added = (("target", IntegerType()), ("event", StringType()), ("timeouts", IntegerType()), ("ended", StringType()))
    schema = events.select(by, F.col(order).cast("bigint").alias(order), "success", "timeout").schema
    for name, kind in added:
        schema = schema.add(name, kind)

    def run(batches):
        group, now = object(), Run(rules.start)
        for b in batches:
            out = []
            for g, ok, late, ms in zip(*(b.column(c).to_pylist() for c in (by, "success", "timeout", "latency_ms")), strict=True):
                if g != group:
                    group, now = g, Run(rules.start)
                event = now.step(rules, ok, late, ms)
                out.append((now.target, event, now.timeouts, now.ended))
            c = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["latency_ms"]).columns, *(pa.array(v, t) for v, t in zip(c, kinds, strict=True))], names=schema.names)

    rows = events.select(by, F.col(order).cast("bigint").alias(order), "success", "timeout", F.col("latency_ms").cast("bigint").alias("latency_ms"))
    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def autotune(events: DataFrame, by: str, order: str, **rules) -> DataFrame:
    """(by, order, success, timeout, target, event): what control() does to the target; rules as in controller.Rules."""
    return control(events, by, order, Rules(**rules)).drop("timeouts", "ended")


def run_totals(runs: DataFrame) -> DataFrame:
    """(doc_id, loops, processed, failed, skipped) over the loops of a run."""
    return runs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("loops"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("processed", "failed", "skipped")])


def token_source(chunks: DataFrame) -> DataFrame:
    """(doc_id, token_source): the one source of a document's token counts, ``mixed`` if there are more, empty if none."""
    some = F.sort_array(F.collect_set(F.nullif(F.btrim("token_source"), F.lit(""))))
    return chunks.groupBy("doc_id").agg(some.alias("s")).select("doc_id", F.when(F.size("s") > 1, "mixed").otherwise(F.coalesce(F.get("s", F.lit(0)), F.lit(""))).alias("token_source"))


def ledger(results: DataFrame) -> DataFrame:
    """Counters of results with absent ones as 0."""
    names = ("processed_count", "failed_count", "skipped_count", "warning_count", "replan_count", "timeout_count")
    have = set(results.columns)
    return results.select("doc_id", *[F.greatest(F.coalesce(F.col(n).try_cast("bigint"), F.lit(0)), F.lit(0)).alias(n) if n in have else F.lit(0).cast("bigint").alias(n) for n in names])
