"""The controller of chunk sizes as a stream: state for each run, kept from one micro-batch to the next and across restarts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.controller import Rules, Run

STATE = "target int, good int, seen int, timeouts int, ended string, last array<bigint>, due bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Controller(StatefulProcessor):
    """Steps each run's controller by the events of a micro-batch in their order; a run that is silent for idle_ms of event time is closed."""

    def __init__(self, by: str, order: str, rules: Rules, idle_ms: int):
        self.by, self.order, self.rules, self.idle_ms = by, order, rules, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)

    def row(self, key, seq, success, timeout, run: Run, event: str) -> Row:
        return Row(**{self.by: key[0], self.order: seq, "success": success, "timeout": timeout, "target": run.target, "event": event, "timeouts": run.timeouts, "ended": run.ended})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        had = self.run.get() if self.run.exists() else None
        run, due = (Run(*had[:5], list(had[5])), had[6]) if had else (Run(self.rules.start), 0)
        last = 0
        for r in sorted(rows, key=lambda r: r[self.order]):  # those of one run in one micro-batch
            event = run.step(self.rules, r["success"], r["timeout"], r["latency_ms"])
            last = max(last, int(r["time"].timestamp() * 1000))
            yield self.row(key, r[self.order], r["success"], r["timeout"], run, event)
        if last + self.idle_ms > due:
            if due:
                self.handle.deleteTimer(due)
            due = last + self.idle_ms
            self.handle.registerTimer(due)
        self.run.update((run.target, run.good, run.seen, run.timeouts, run.ended, run.last, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        had = self.run.get()
        if had:
            yield self.row(key, None, None, None, Run(*had[:5], list(had[5])), "closed")
        self.run.clear()

    def close(self) -> None:
        pass


def control(events: DataFrame, by: str, order: str, rules: Rules = Rules(), idle_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """(by, order, success, timeout, target, event, timeouts, ended) of a stream of events (by, order, time, success, timeout, latency_ms).

    Equal to operators.telemetry.control on the same events if they come in order: the events of a micro-batch are sorted, those of earlier
    ones have had their effect. Events later than ``late`` are left out. A run without events for idle_ms of event time is closed: one row with
    the event ``closed``, then its state is gone, and it begins anew if it comes again. State is one row a run, with the last ``window`` latencies.
    """
    kind = lambda c: events.schema[c].dataType.simpleString()
    schema = f"{by} {kind(by)}, {order} {kind(order)}, success boolean, timeout boolean, target int, event string, timeouts int, ended string"
    rows = events.select(by, order, "time", "success", "timeout", "latency_ms").withWatermark("time", late)
    return rows.groupBy(by).transformWithState(Controller(by, order, rules, idle_ms), schema, "append", "EventTime")
