"""Percentiles by selection, and the controller as a batch and as a stream."""

import json
import math
import os
import random

import pytest
from loomtext.functions.controller import Rules
from loomtext.operators import telemetry
from loomtext.streaming import controller
from pyspark.sql import functions as F


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_p95_by_selection(spark, kind):
    """Keys above and below the limit, ties, one value very often, values far apart, nothing positive, null keys and values."""
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([1, 1, 2, rnd.randrange(10**6), 10**15 + rnd.randrange(9)])) for _ in range(4000)]
    rows += [("same", 7)] * 900 + [("few", v) for v in (3, 1, 2)] + [("none", -1), ("none", 0), ("none", None), (None, 5), (None, 6)]
    rows += [("wide", v) for v in range(1, 2500)] + [("wide", None)] * 50
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "g string, v double").select("g", F.col("v").cast(kind).alias("v")).repartition(4)
    values = {}
    for k, v in rows:
        values.setdefault(k, [])
        if v is not None and v > 0:
            values[k].append(v)
    want = {k: sorted(v)[math.ceil(len(v) * 0.95) - 1] if v else None for k, v in values.items()}
    for most in (10, 1000, telemetry.SORTED):
        assert {r["g"]: r["p95"] for r in telemetry.p95(df, "v", "g", most=most).collect()} == want
    assert telemetry.p95(df.limit(0), "v", "g").collect() == []


RULES = Rules(start=1000, window=4, threshold_ms=900, canary=3, stop_after_timeouts=2)


def events():
    rnd = random.Random(8)
    rows = []
    for seq in range(240):
        late = rnd.random() < 0.15
        ok = not late and rnd.random() < 0.85
        rows.append({"run": f"r{seq % 7}", "seq": seq, "time": f"2024-01-01T00:{seq // 60:02d}:{seq % 60:02d}Z", "success": ok, "timeout": late, "latency_ms": rnd.choice([100, 300, 1000]) if ok else None})
    return rows


def test_controller_ends_runs(spark):
    rows = [("a", k, k == 0, k > 0, 10) for k in range(4)] + [("b", k, True, False, 5000) for k in range(2)] + [("c", k, k % 2 == 0, k % 2 == 1, 10) for k in range(9)]
    df = spark.createDataFrame(rows, "run string, seq long, success boolean, timeout boolean, latency_ms long")
    got = {}
    for r in telemetry.control(df, "run", "seq", Rules(stop_after_timeouts=2)).orderBy("run", "seq").collect():
        got.setdefault(r["run"], []).append(r["ended"])
    assert got == {"a": ["", "", "stopped", "stopped"], "b": ["", ""], "c": [""] * 9}
    early = telemetry.control(df, "run", "seq", Rules(canary=1, threshold_ms=1000)).where("ended <> ''").groupBy("run").agg(F.min("seq").alias("at")).collect()
    assert [(r["run"], r["at"]) for r in early] == [("b", 0)]


def test_controller_as_a_stream_across_a_restart(spark, tmp_path):
    """Three files, a stop, three more: what comes out is what the batch gives, and silent runs are closed."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    controller.prepare(spark)
    try:
        rows, folder = events(), tmp_path / "in"
        folder.mkdir()
        schema = "run string, seq long, time timestamp, success boolean, timeout boolean, latency_ms long"

        def put(n, some):
            (folder / f"{n}.json").write_text("\n".join(map(json.dumps, some)))
            os.utime(folder / f"{n}.json", (1.7e9 + 10 * n,) * 2)  # files come by their times

        def go():
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
            out = controller.control(stream, "run", "seq", RULES, idle_ms=3_600_000, late="1 minute")
            query = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
            assert query.awaitTermination(240)

        for n in range(3):
            put(n, rows[n * 40 : n * 40 + 40])
        go()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 120
        for n in range(3, 6):
            put(n, rows[n * 40 : n * 40 + 40])
        put(6, [{**rows[0], "run": "later", "seq": 999, "time": "2024-01-03T00:00:00Z"}])
        put(7, [{**rows[0], "run": "later", "seq": 1000, "time": "2024-01-03T00:00:01Z"}])
        go()
        out = spark.read.parquet(str(tmp_path / "out"))
        batch = telemetry.control(spark.createDataFrame(rows).select("run", "seq", "success", "timeout", "latency_ms"), "run", "seq", RULES)
        key = ["run", "seq", "success", "timeout", "target", "event", "timeouts", "ended"]
        assert sorted(map(tuple, out.where("seq < 900").select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))
        last = {r["run"]: (r["target"], r["ended"]) for r in batch.orderBy("seq").collect()}
        assert {r["run"]: (r["target"], r["ended"]) for r in out.where("event = 'closed'").collect()} == last
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
