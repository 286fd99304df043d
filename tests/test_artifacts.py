"""Artifacts of results, and the cycles of their graph against reachability in plain Python."""

import json
import random

from loomtext.operators import artifacts


def test_artifacts_of_results(spark):
    listed = {"artifacts": [{"artifact_id": "a1", "artifact_type": "x", "path": " /p/one ", "version": 3, "parent_artifacts": ["a0", " ", None]}, {"path": "/p/one", "artifact_id": "again"}, {"artifact_id": "bare", "source_action_id": "other"}], "output_file": "/p/one", "work_dir": "", "outputs": {"work_dir": "/w2", "output_file": "/p/two"}}
    rows = [("r", "act1", json.dumps(listed), json.dumps({"work_dir": "/w", "state_ref": "/s"})), ("r", "act2", json.dumps({"manifest_path": "/m"}), None), ("r", "act3", "not json", "{}"), ("q", "act1", None, None)]
    df = artifacts.derive(spark.createDataFrame(rows, "run_id string, action_id string, result string, context string"))
    got = {}
    for r in df.orderBy("action_id", "k").collect():
        got.setdefault(r["action_id"], []).append((r["artifact_type"], r["path"], r["source_action_id"], r["version"], r["parent_artifacts"]))
    assert got["act1"] == [("x", "/p/one", "act1", 3, ["a0"]), ("unknown", "", "other", 1, []), ("work_dir", "/w", "act1", 1, []), ("state", "/s", "act1", 1, []), ("work_dir", "/w2", "act1", 1, []), ("output_file", "/p/two", "act1", 1, [])]
    assert got["act2"] == [("manifest", "/m", "act2", 1, [])] and "act3" not in got
    ids = [r["artifact_id"] for r in df.collect()]
    assert {"a1", "bare"} < set(ids) and all(i.startswith("artifact_") for i in set(ids) - {"a1", "bare"}) and len(set(ids)) == len(ids)
    nodes, edges = artifacts.graph(df)
    assert nodes.count() == len(ids) and [tuple(r) for r in edges.collect()] == [("r", "a0", "a1")]


def test_cycles(spark):
    rnd = random.Random(2)
    edges = [(f"n{rnd.randrange(40):02d}", f"n{rnd.randrange(40):02d}") for _ in range(52)] + [("x", "x"), ("y", "z"), (None, "z"), ("p", "q"), ("q", "p"), ("q", "y")]
    after = {}
    for a, b in edges:
        if a:
            after.setdefault(a, set()).add(b)
    reach = {}
    for a in after:
        seen, todo = set(), list(after[a])
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += after.get(v, ())
        reach[a] = seen
    want = {a: max(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]}
    got = {r["node"]: r["cycle"] for r in artifacts.cycles(spark.createDataFrame(edges, "from_id string, to_id string")).collect()}
    assert got == want and {"x", "p"} < set(got) and "y" not in got
