"""The journal: events sent twice, and batches run twice, enter once."""

import json
import os

from loomtext.streaming import journal, telemetry


def test_each_event_enters_once(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    events = [{"trace_id": f"t{k % 50}", "command": f"c{k % 3}", "timestamp": f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}", "duration_ms": k, "success": True} for k in range(300)]

    def put(n, some):
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, some)))
        os.utime(folder / f"{n}.json", (1.7e9 + 10 * n,) * 2)

    def go():
        query = journal.keep(telemetry.read(spark, str(folder), 1), out, check)
        assert query.awaitTermination(240)
        return sorted((r["trace_id"], r["command"], r["timestamp"]) for r in journal.read(spark, out, telemetry.SCHEMA).collect())

    want = lambda n: sorted((e["trace_id"], e["command"], e["timestamp"]) for e in events[:n])
    put(0, events[:100])
    put(1, events[50:150])  # half of it again
    assert go() == want(150)
    put(2, events[150:200])
    put(3, events)  # all of it again, and the rest
    assert go() == want(300)
    # the last batch was written, but its commit is lost: it is run again
    commits = sorted(int(f) for f in os.listdir(f"{check}/commits") if f.isdigit())
    for name in (str(commits[-1]), f".{commits[-1]}.crc"):
        if os.path.exists(f"{check}/commits/{name}"):
            os.remove(f"{check}/commits/{name}")
    assert go() == want(300)
