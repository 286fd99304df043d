"""Greedy packing of documents whose units are rows, however many: prefix sums, next breaks and pointers over blocks of places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lineage

#: Places that one task walks through, and ends of budgets that one window sorts, in budgets.
BLOCK, CELL = 4096, 512


def prefix_sums(units: DataFrame, size: str, out: str) -> DataFrame:
    """units (doc_id, pos, ...) with out: the sum of size over the units before in the document. pos runs from 0 without gaps.

    A block of places is summed alone; its base is a sum over the blocks' totals, two levels of them.
    """
    wide = F.expr(f"pos div {BLOCK * BLOCK}")
    cut = units.withColumn("_b", F.expr(f"pos div {BLOCK}")).withColumn("_w", wide)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    fine = cut.groupBy("doc_id", "_w", "_b").agg(F.sum(size).alias("_n"))
    coarse = fine.groupBy("doc_id", "_w").agg(F.sum("_n").alias("_m")).withColumn("_base", F.coalesce(F.sum("_m").over(before(Window.partitionBy("doc_id").orderBy("_w"))), F.lit(0)))
    fine = fine.withColumn("_in", F.coalesce(F.sum("_n").over(before(Window.partitionBy("doc_id", "_w").orderBy("_b"))), F.lit(0)))
    bases = fine.join(coarse, ["doc_id", "_w"]).select("doc_id", "_b", (F.col("_base") + F.col("_in")).alias("_base"))
    within = F.coalesce(F.sum(size).over(before(Window.partitionBy("doc_id", "_b").orderBy("pos"))), F.lit(0))
    return cut.withColumn(out, within).join(bases, ["doc_id", "_b"]).withColumn(out, F.col("_base") + F.col(out)).drop("_b", "_w", "_base")


def next_starts(units: DataFrame, limit: int, gap: int) -> DataFrame:
    """(doc_id, pos, next): where the chunk that follows one beginning at pos begins; null behind the last.

    That is the first unit with which sizes and gaps since pos pass limit, or that is fresh. As prefix sums ascend, it is found by
    one sort of sums and bounds in each stretch of CELL budgets; a bound with no sum above it there takes the first sum of the next stretch.
    """
    summed = prefix_sums(units.select("doc_id", "pos", "fresh", (F.col("size") + F.lit(gap)).cast("long").alias("w")), "w", "p")
    stretch = float((limit + gap + 1) * CELL)
    reach, bound = F.col("p") + F.col("w"), F.col("p") + F.lit(limit + gap)  # the sum with a unit, and what a chunk from it may come to
    cell = lambda v: F.floor(v / F.lit(stretch))
    ends = summed.select("doc_id", cell(reach).alias("c"), reach.alias("v"), F.lit(1).alias("kind"), "pos")
    asks = summed.select("doc_id", cell(bound).alias("c"), bound.alias("v"), F.lit(0).alias("kind"), "pos")
    # down from the highest sum, a bound before the sums equal to it: these don't pass it
    down = Window.partitionBy("doc_id", "c").orderBy(F.desc("v"), "kind", F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ends.unionByName(asks).withColumn("next", F.min(F.when(F.col("kind") == 1, F.col("pos"))).over(down)).where("kind = 0")
    firsts = ends.groupBy("doc_id", "c").agg(F.min("pos").alias("first")).select("doc_id", "c", F.lit(1).alias("kind"), "first")
    cells = met.select("doc_id", "c").distinct().select("doc_id", "c", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("first")).unionByName(firsts)
    after = Window.partitionBy("doc_id").orderBy(F.desc("c"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one or two rows a stretch
    later = cells.withColumn("later", F.min("first").over(after)).where("kind = 0").select("doc_id", "c", "later")
    by_size = met.join(later, ["doc_id", "c"]).select("doc_id", "pos", F.coalesce("next", "later").alias("by_size"))
    # a unit that is larger than a budget alone passes its own bound, but begins its chunk
    by_size = by_size.withColumn("by_size", F.when(F.col("by_size") <= F.col("pos"), F.col("pos") + 1).otherwise(F.col("by_size")))
    blocks = summed.withColumn("_b", F.expr(f"pos div {BLOCK}"))
    behind = Window.partitionBy("doc_id", "_b").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    fresh = blocks.withColumn("own", F.min(F.when(F.col("fresh"), F.col("pos"))).over(behind)).select("doc_id", "pos", "_b", "own")
    first = blocks.groupBy("doc_id", "_b").agg(F.min(F.when(F.col("fresh"), F.col("pos"))).alias("f"))
    first = first.withColumn("later", F.min("f").over(Window.partitionBy("doc_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))).select("doc_id", "_b", "later")
    by_fresh = fresh.join(first, ["doc_id", "_b"]).select("doc_id", "pos", F.coalesce("own", "later").alias("by_fresh"))
    last = units.groupBy("doc_id").agg(F.max("pos").alias("last"))
    out = by_size.join(by_fresh, ["doc_id", "pos"]).join(last, "doc_id").withColumn("next", F.least("by_size", "by_fresh"))
    return out.select("doc_id", "pos", F.when(F.col("next") <= F.col("last"), F.col("next")).alias("next"))


def _exits(first: int, after: np.ndarray) -> np.ndarray:
    """For each place of a block: the first start behind the block on the way from it; -1 if the way ends."""
    out, n = after.copy(), len(after)
    for k in range(n - 1, -1, -1):
        if 0 <= after[k] - first < n:
            out[k] = out[after[k] - first]
    return out


def pack_rows(units: DataFrame, limit: int, gap: int) -> DataFrame:
    """(doc_id, chunk, first, units): the chunks of documents whose units (doc_id, pos, size[, fresh]) are rows; as folds.chunk_ranges on arrays.

    Every place gets a pointer to the start of the chunk behind one that begins there (next_starts). A task composes the pointers
    of a block of BLOCK places into where each leads behind the block. Blocks are entered only where such ways lead, which are few places; along
    these a document's blocks are walked one after another, and each block then gives the starts on its own way. No task holds more
    than a block of places, or the entrances of one document.
    """
    rows = units if "fresh" in units.columns else units.withColumn("fresh", F.lit(False))
    rows = rows.withColumn("pos", F.col("pos").cast("long")).withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    kind = units.schema["doc_id"].dataType.simpleString()
    pointers = lineage.cut(next_starts(rows, limit, gap).withColumn("block", F.expr(f"pos div {BLOCK}")))

    def arrays(table: pa.Table) -> tuple[pa.Table, int, np.ndarray]:
        table = table.sort_by("pos").combine_chunks()
        return table, table["pos"][0].as_py(), np.array([-1 if v is None else v for v in table["next"].to_pylist()], np.int64)

    def exits(table: pa.Table) -> pa.Table:
        table, first, after = arrays(table)
        return pa.table([table["doc_id"], table["pos"], pa.array(_exits(first, after))], names=["doc_id", "pos", "exit"])

    ways = lineage.cut(pointers.groupBy("doc_id", "block").applyInArrow(exits, f"doc_id {kind}, pos long, exit long"))
    entered = ways.where("exit >= 0").select("doc_id", F.col("exit").alias("pos")).distinct()
    doors = ways.join(entered, ["doc_id", "pos"], "left_semi").unionByName(ways.where("pos = 0")).distinct()

    def walk(table: pa.Table) -> pa.Table:
        to = dict(zip(table["pos"].to_pylist(), table["exit"].to_pylist(), strict=True))
        at, way = 0, []
        while at >= 0:
            way.append(at)
            at = to[at]
        return pa.table([pa.array([table["doc_id"][0].as_py()] * len(way), table["doc_id"].type), pa.array(way, pa.int64())], names=["doc_id", "door"])

    doors = doors.groupBy("doc_id").applyInArrow(walk, f"doc_id {kind}, door long").withColumn("block", F.expr(f"door div {BLOCK}"))

    def starts(table: pa.Table) -> pa.Table:
        table, first, after = arrays(table)
        at, out = table["door"][0].as_py(), []
        while first <= at < first + len(after):
            out.append((at, after[at - first]))
            at = int(after[at - first])
        return pa.table([pa.array([table["doc_id"][0].as_py()] * len(out), table["doc_id"].type), pa.array([a for a, _ in out], pa.int64()), pa.array([b if b >= 0 else None for _, b in out], pa.int64())], names=["doc_id", "first", "next"])

    found = pointers.join(doors, ["doc_id", "block"]).groupBy("doc_id", "block").applyInArrow(starts, f"doc_id {kind}, first long, next long")
    sizes = rows.groupBy("doc_id").agg((F.max("pos") + 1).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("first")  # a row for each chunk
    return found.join(sizes, "doc_id").select("doc_id", (F.row_number().over(w) - 1).alias("chunk"), "first", (F.coalesce("next", "n") - F.col("first")).alias("units"))
