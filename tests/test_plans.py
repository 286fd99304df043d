"""Packing over rows against packing of arrays, and versions of plans against single steps."""

import random

import pytest
from loomtext.functions import folds
from loomtext.operators import chunking, packing, plans
from loomtext.operators import segments as S
from pyspark.sql import functions as F


@pytest.mark.parametrize(("block", "cell", "limit", "gap"), [(4096, 512, 60, 2), (7, 2, 60, 2), (16, 1, 5, 0)])
def test_packing_of_rows(spark, monkeypatch, block, cell, limit, gap):
    """Units larger than a budget, of no size, fresh ones, one unit; chunks over many blocks and blocks over many chunks."""
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing, "CELL", cell)
    rnd = random.Random(block)
    docs = [("long", 700), ("one", 1), ("two", 2), (None, 30), ("huge", 40), ("tiny", 90)]
    rows = [(d, k, 500 if d == "huge" else rnd.choice([0, 1]) if d == "tiny" else rnd.choice([0, 1, 9, 20, 61, 200]), rnd.random() < 0.05) for d, n in docs for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, size int, fresh boolean").repartition(3).where("doc_id IS NOT NULL")
    listed = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "size", "fresh"))).alias("u"))
    for fresh in (True, False):
        ranges = folds.chunk_ranges(F.col("u")["size"], F.col("u")["fresh"] if fresh else None, limit, gap)
        want = {(r["doc_id"], k): (c["first"], c["units"]) for r in listed.withColumn("r", ranges).collect() for k, c in enumerate(r["r"])}
        got = {(r["doc_id"], r["chunk"]): (r["first"], r["units"]) for r in packing.pack_rows(df if fresh else df.drop("fresh"), limit, gap).collect()}
        assert got == want
    assert packing.pack_rows(df.limit(0), limit, gap).collect() == []


def test_packing_of_one_very_long_document(spark):
    """Half a million units of one document; its blocks are dealt over tasks, and the chunks are those of one fold."""
    n = 500_000
    df = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("size"))
    sizes = [r["size"] for r in df.orderBy("pos").collect()]
    want, now, first = [], None, 0
    for k, s in enumerate(sizes):
        if now is not None and now + s + 2 > 2000:
            want.append((first, k - first))
            first, now = k, None
        now = s if now is None else now + s + 2
    want.append((first, n - first))
    got = [(r["first"], r["units"]) for r in packing.pack_rows(df, 2000, 2).orderBy("chunk").collect()]
    assert got == want


def test_three_plans_in_a_row(spark):
    """Chapter starts moved after each plan, and moved once over all: the same places; superseded chunks and counters name their plans."""
    text = lambda n: " ".join(f"Sentence number {k} of it." for k in range(n))
    chunks = spark.createDataFrame([("a", k, "done" if k == 0 else "pending", text(12), "p0", None) for k in range(6)] + [("b", 0, "done", "All of it.", "p0", None)], "doc_id string, id int, status string, text string, plan_id string, superseded_by string")
    history = spark.createDataFrame([("a", "p0", None), ("b", "p0", "")], "doc_id string, plan_id string, prior_plan_id string")
    start = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 3, 0), ("b", 1, 0)], "doc_id string, chapter int, start_chunk int")
    stepped, moves, n_new = start, [], []
    for name, size in (("p1", 60), ("p2", 40), ("p3", 25)):
        breaks = stepped.select("doc_id", F.col("start_chunk").alias("id")).distinct()
        chunks, history, moved, counters = plans.replan(chunks, history, name, breaks, size, size)
        stepped = S.remap_chapters(stepped.drop("original_start_chunk"), moved.select("doc_id", "old_id", "new_id"))
        moves.append(moved)
        c = counters.collect()
        assert [(r["doc_id"], r["plan_id"], r["prior_plan_id"]) for r in c] == [("a", name, f"p{int(name[1]) - 1}")]
        n_new.append((c[0]["superseded_count"], c[0]["new_chunk_count"]))
        chunks = chunks.drop("continuity_prev")
    every = moves[0].unionByName(moves[1]).unionByName(moves[2])
    once = plans.remap_over_versions(start, every)
    key = lambda df: sorted((r["doc_id"], r["chapter"], r["start_chunk"]) for r in df.collect())
    assert key(once) == key(stepped)
    assert {(r["chapter"], r["original_start_chunk"]) for r in once.where("doc_id = 'a'").collect()} == {(1, 1), (2, 3), (3, None)}
    assert n_new[0][0] == 5 and all(n_new[k][1] == n_new[k + 1][0] for k in range(2)) and n_new[2][1] > n_new[0][1]
    state = {(r["plan_id"], r["status"], r["superseded_by"]) for r in chunks.where("doc_id = 'a'").collect()}
    assert state == {("p0", "done", None), ("p0", "superseded", "p1"), ("p1", "superseded", "p2"), ("p2", "superseded", "p3"), ("p3", "pending", None)}
    chain = {(r["doc_id"], r["plan_id"]): (r["version"], r["first_plan_id"], r["current_plan_id"], r["superseded_by"]) for r in plans.chain(history).collect()}
    assert chain[("a", "p1")] == (1, "p0", "p3", "p2") and chain[("a", "p3")] == (3, "p0", "p3", None) and chain[("b", "p0")] == (0, "p0", "p0", None)


def test_cycles_are_errors(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("a", 3, 1)], "doc_id string, node int, next int")
    with pytest.raises(ValueError, match="cycle"):
        plans.follow(df)
