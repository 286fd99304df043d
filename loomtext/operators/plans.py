"""Versions of plans: which plan superseded which, and where old chunks have gone over several plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunking, lineage


def follow(edges: DataFrame) -> DataFrame:
    """(doc_id, node, next, steps): the end of the way from each node along edges (doc_id, node, next), at most one from a node.

    Pointers jump: each round doubles the steps, so that a chain of n takes log2(n) rounds of one join. A cycle is an error.
    """
    at = lineage.cut(edges.select("doc_id", "node", "next", F.lit(1).cast("long").alias("steps")))
    most = at.count()
    while True:
        hop = at.select("doc_id", F.col("node").alias("next"), F.col("next").alias("far"), F.col("steps").alias("more"))
        now = at.join(hop, ["doc_id", "next"], "left").select("doc_id", "node", F.coalesce("far", "next").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved"))
        now = lineage.cut(now)
        state = now.agg(F.bool_or("moved").alias("moved"), F.max("steps").alias("steps")).first()
        if not state["moved"]:
            return now.drop("moved")
        if state["steps"] > most:
            raise ValueError("edges form a cycle")
        at = now.drop("moved")


def chain(plans: DataFrame) -> DataFrame:
    """(doc_id, plan_id, prior_plan_id, version, first_plan_id, current_plan_id, superseded_by) of plans (doc_id, plan_id, prior_plan_id): version 0 has no prior plan."""
    prior = F.nullif(F.btrim(F.coalesce("prior_plan_id", F.lit(""))), F.lit(""))
    own = lineage.cut(plans.select("doc_id", "plan_id", prior.alias("prior_plan_id")))
    edges = own.where("prior_plan_id IS NOT NULL")
    back = follow(edges.select("doc_id", F.col("plan_id").alias("node"), F.col("prior_plan_id").alias("next"))).select("doc_id", F.col("node").alias("plan_id"), F.col("next").alias("_first"), F.col("steps").alias("_version"))
    ahead = follow(edges.select("doc_id", F.col("prior_plan_id").alias("node"), F.col("plan_id").alias("next"))).select("doc_id", F.col("node").alias("plan_id"), F.col("next").alias("_current"))
    by = edges.select("doc_id", F.col("prior_plan_id").alias("plan_id"), F.col("plan_id").alias("superseded_by"))
    out = own.join(back, ["doc_id", "plan_id"], "left").join(ahead, ["doc_id", "plan_id"], "left").join(by, ["doc_id", "plan_id"], "left")
    return out.select("doc_id", "plan_id", "prior_plan_id", F.coalesce("_version", F.lit(0)).alias("version"), F.coalesce("_first", "plan_id").alias("first_plan_id"), F.coalesce("_current", "plan_id").alias("current_plan_id"), "superseded_by")


def remap_over_versions(plan: DataFrame, remaps: DataFrame) -> DataFrame:
    """A chapter plan (doc_id, chapter, start_chunk, ...) moved to the newest chunks by remaps (doc_id, old_id, new_id) of all plans at once.

    original_start_chunk keeps the first start of a chapter that moved; starts that no plan replaced stay.
    """
    to = follow(remaps.select("doc_id", F.col("old_id").alias("node"), F.col("new_id").alias("next"))).select("doc_id", F.col("node").alias("start_chunk"), F.col("next").alias("_new"))
    had = F.col("original_start_chunk") if "original_start_chunk" in plan.columns else F.lit(None).cast(plan.schema["start_chunk"].dataType)
    both = plan.join(to, ["doc_id", "start_chunk"], "left").withColumn("original_start_chunk", F.coalesce(had, F.when(F.col("_new").isNotNull(), F.col("start_chunk"))))
    return both.withColumn("start_chunk", F.coalesce("_new", "start_chunk")).drop("_new")


def replan(chunks: DataFrame, plans: DataFrame, plan_id: str, breaks: DataFrame | None, target: int, cap: int, mode: str = "tokens") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, plans, old_to_new, counters): a new plan for the pending chunks of each document, with its place in the history.

    chunks: (doc_id, id, status, text, plan_id, superseded_by), plans: (doc_id, plan_id, prior_plan_id). Superseded chunks name the new plan, new ones
    belong to it and name the active chunk before them (continuity_prev). Documents without pending chunks keep their plan. counters:
    (doc_id, plan_id, prior_plan_id, superseded_count, new_chunk_count).
    """
    due = chunks.where(~F.col("status").isin("done", "superseded")).select("doc_id").distinct()
    own = lineage.cut(chunks.join(due, "doc_id", "left_semi"))
    made, old_to_new = chunking.replan(own.select("doc_id", "id", "status", "text"), breaks, target, cap, mode)
    made, old_to_new = lineage.cut(made), lineage.cut(old_to_new)
    had = own.select("doc_id", "id", F.col("status").alias("_was"), F.col("plan_id").alias("_plan"), F.col("superseded_by").alias("_by"))
    new = made.join(had, ["doc_id", "id"], "left")
    fresh = F.col("_was").isNull()
    gone = (F.col("status") == "superseded") & (F.col("_was") != "superseded")
    new = new.select("doc_id", "id", "status", "text", F.when(fresh, plan_id).otherwise(F.col("_plan")).alias("plan_id"), F.when(gone, plan_id).otherwise(F.col("_by")).alias("superseded_by"))
    whole = chunks.join(due, "doc_id", "left_anti").select("doc_id", "id", "status", "text", "plan_id", "superseded_by").unionByName(new)
    before = F.last(F.when(F.col("status") != "superseded", F.col("id")), True).over(Window.partitionBy("doc_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.withColumn("continuity_prev", F.when(F.col("status") != "superseded", before))
    current = chain(plans).where("superseded_by IS NULL").select("doc_id", F.col("plan_id").alias("prior_plan_id"))
    added = due.join(current, "doc_id", "left").select("doc_id", F.lit(plan_id).alias("plan_id"), "prior_plan_id")
    counts = new.groupBy("doc_id").agg(F.count_if((F.col("superseded_by") == plan_id)).alias("superseded_count"), F.count_if(F.col("plan_id") == plan_id).alias("new_chunk_count"))
    return whole, plans.select("doc_id", "plan_id", "prior_plan_id").unionByName(added), old_to_new, added.join(counts, "doc_id")
