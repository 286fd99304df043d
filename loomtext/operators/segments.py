"""Operators on timed segments: folds, temporal joins and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import text as T


def merge_repeats(segments: DataFrame) -> DataFrame:
    """(doc_id, id, text, start_time, end_time, merged): runs of equal text as one, from the first start to the last end."""
    w = Window.partitionBy("doc_id").orderBy("id")
    new = (~F.col("text").eqNullSafe(F.lag("text").over(w)) | F.lag("id").over(w).isNull()).cast("int")
    runs = segments.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("doc_id", "_run").agg(F.min("id").alias("id"), F.first("text").alias("text"), F.min_by("start_time", "id").alias("start_time"), F.max("end_time").alias("end_time"), F.count(F.lit(1)).alias("merged")).drop("_run")


def boundary_tolerance(items: DataFrame) -> DataFrame:
    """(doc_id, tolerance): a fifth of the shortest positive duration, between 0.05 and 0.35 s."""
    d = F.col("end_time") - F.col("start_time")
    shortest = F.coalesce(F.min(F.when(d > 0, d)), F.lit(0.35))
    return items.groupBy("doc_id").agg(F.greatest(F.lit(0.05), F.least(F.lit(0.35), shortest * 0.2)).alias("tolerance"))


def locate(points: DataFrame, items: DataFrame, next_strategy: str = "next_segment", after_last: str = "after_last_segment") -> DataFrame:
    """points (doc_id, key, t) with matched_id, strategy and confidence among the timed items (doc_id, id, start_time, end_time) of the same doc_id.

    Items are taken in id order. The first item decides for which t lies in the tolerance before the next item's start
    (that next one matches), in the item, or before it; after the last item its end decides. A null t matches the
    first item.

    An item decides for t if t is below its end, or at most a little behind its start: with running maxima of these bounds the first
    such item is the one that follows t in one sort of items and points, and the near next start is that item's own or its follower's.
    """
    timed = items.where("start_time IS NOT NULL AND end_time IS NOT NULL").select("doc_id", "id", F.col("start_time").cast("double").alias("s"), F.col("end_time").cast("double").alias("e"))
    tolerance = boundary_tolerance(timed.withColumnsRenamed({"s": "start_time", "e": "end_time"}))
    w = Window.partitionBy("doc_id").orderBy("id")
    # bounds as (value, rank): a point is (t, 1), below an open end (e, 0) only if t < e and below a closed one (s, 2) also if t = s
    bound = lambda v, rank: F.struct(v.alias("v"), F.lit(rank).alias("rank"))
    slack = F.greatest(F.col("tolerance") / 4, F.abs("s") * 1e-9)
    item = F.struct((F.row_number().over(w) - 1).alias("k"), F.col("id"), F.col("s"), F.col("e"), F.lead("s").over(w).alias("after"), F.lead("id").over(w).alias("next"))
    own = timed.join(tolerance, "doc_id").withColumn("_own", F.greatest(bound(F.greatest("e", "s"), 0), bound(F.col("s") + slack, 2)))
    upto = F.max("_own").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = own.select("doc_id", item.alias("item"), upto.alias("at"))
    both = ranked.select("doc_id", "at", "item", F.lit(None).alias("point")).unionByName(points.select("doc_id", bound(F.col("t").cast("double"), 1).alias("at"), F.lit(None).alias("item"), F.struct("key", "t").alias("point")))
    down = Window.partitionBy("doc_id").orderBy(F.desc("at"), F.desc(F.coalesce("item.k", F.lit(-1)))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("x", F.last("item", True).over(down)).where("point IS NOT NULL").select("doc_id", "point.key", "point.t", "x")
    ends = timed.groupBy("doc_id").agg(F.min("id").alias("_first"), F.max("id").alias("_last"), F.max_by("e", "id").alias("_end"))
    met = met.join(ends, "doc_id", "left").join(tolerance, "doc_id", "left")
    t, tol, x = F.col("t"), F.col("tolerance"), F.col("x")
    say = lambda i, said, c: F.struct(i.alias("id"), F.lit(said).alias("strategy"), F.lit(c).alias("confidence"))
    inside = ((x["s"] <= t) & (t < x["e"])) | (F.abs(t - x["s"]) <= F.greatest(tol / 4, F.greatest(F.abs(t), F.abs(x["s"])) * 1e-9))
    late = say(F.col("_last"), after_last, "low")
    found = (
        F.when(F.col("_first").isNull(), say(F.lit(None).cast(items.schema["id"].dataType), after_last, "low"))
        .when(t.isNull(), say(F.col("_first"), "missing_time", "low"))
        .when(x.isNull(), F.when((t - F.col("_end")).between(0, tol), say(F.col("_last"), "near_last_end", "medium")).otherwise(late))
        .when((x["k"] > 0) & (x["s"] - t).between(0, tol), say(x["id"], "near_next_start", "high"))
        .when((x["after"] - t).between(0, tol), say(x["next"], "near_next_start", "high"))
        .when(inside, say(x["id"], "time_contains", "high"))
        .otherwise(say(x["id"], next_strategy, "medium"))
    )
    return met.withColumn("_m", found).select("doc_id", "key", "t", F.col("_m.id").alias("matched_id"), F.col("_m.strategy").alias("strategy"), F.col("_m.confidence").alias("confidence"), F.round("tolerance", 3).alias("tolerance"))


def chapter_breaks(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, id): the segments at which chapters (doc_id, chapter, start_time) begin, each once."""
    points = chapters.where("start_time IS NOT NULL").select("doc_id", F.col("chapter").alias("key"), F.col("start_time").alias("t"))
    return locate(points, segments).where("matched_id IS NOT NULL").select("doc_id", F.col("matched_id").alias("id")).distinct()


def chapter_plan(chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chapters with the chunks in which they begin and end; placeholder titles become empty and the Chinese title defaults to the title."""
    named = chapters.withColumn("title", F.when(F.lower(F.btrim("title")).isin("untitled", "<untitled chapter 1>") | F.lower("title").rlike(r"\A<?untitled chapter \d+>?\z"), "").otherwise(F.coalesce(F.btrim("title"), F.lit(""))))
    starts = locate(named.select("doc_id", F.col("chapter").alias("key"), F.col("start_time").alias("t")), chunks, "next_chunk", "after_last_chunk")
    ends = locate(named.select("doc_id", F.col("chapter").alias("key"), F.greatest(F.col("start_time"), F.col("end_time") - 1e-6).alias("t")), chunks, "next_chunk", "after_last_chunk")
    s = starts.select("doc_id", F.col("key").alias("chapter"), F.col("matched_id").alias("start_chunk"), "strategy", "confidence")
    e = ends.select("doc_id", F.col("key").alias("chapter"), F.col("matched_id").alias("end_chunk"))
    title_zh = F.coalesce(F.nullif(F.col("title_zh"), F.lit("")), F.col("title"))
    return named.withColumn("title_zh", title_zh).join(s, ["doc_id", "chapter"]).join(e, ["doc_id", "chapter"])


def remap_chapters(plan: DataFrame, old_to_new: DataFrame) -> DataFrame:
    """plan with start_chunk replaced by new_id from (doc_id, old_id, new_id) where there is one; the old one stays in original_start_chunk."""
    m = old_to_new.select("doc_id", F.col("old_id").alias("start_chunk"), "new_id")
    both = plan.join(m, ["doc_id", "start_chunk"], "left")
    return both.withColumn("original_start_chunk", F.col("start_chunk")).withColumn("start_chunk", F.coalesce("new_id", "start_chunk")).drop("new_id")


def split_timed(segments: DataFrame, size: int, mode: str = "chars", measured: str | None = None) -> DataFrame:
    """Segments longer than size cut into parts (part_index from 0); times are shared out by characters and rounded to 3 places.

    measured: a column with the size of each part, in the units of mode. Tokens are measured and cut by one function.
    """
    if mode == "chars":
        sized = segments.withColumn("_longer", F.length(T.text_of("text")) > size).withColumn("_parts", F.when(F.col("_longer"), T.hard_split("text", size)).otherwise(F.array("text")))
    else:
        fitted = segments.withColumn("_f", folds.fitted_units(F.array(T.text_of("text")), size))
        sized = fitted.withColumn("_longer", F.col("_f.pieces").isNotNull()).withColumn("_parts", F.coalesce("_f.pieces", F.array("text")))
    rows = T.exploded(sized, "_parts", "part_index", "_part")
    before = F.aggregate(F.slice("_parts", F.lit(1), F.col("part_index")), F.lit(0), lambda a, p: a + F.length(p))
    total = F.aggregate("_parts", F.lit(0), lambda a, p: a + F.length(p))
    span = F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))
    at = lambda n: F.when(F.col("_longer") & span.isNotNull(), F.round(F.col("start_time") + n / total * span, 3))
    rows = rows.withColumn("_s", F.coalesce(at(before), F.col("start_time"))).withColumn("_e", F.coalesce(at(before + F.length("_part")), F.col("end_time")))
    if measured:
        own = F.length(T.text_of("_part")) if mode == "chars" else F.get("_f.measures", F.col("part_index"))["tokens"]
        rows = rows.withColumn(measured, own.cast("long"))
    index = F.when(F.size("_parts") > 1, F.col("part_index"))
    return rows.withColumn("part_index", index).withColumn("text", F.col("_part")).withColumn("start_time", F.col("_s")).withColumn("end_time", F.col("_e")).drop("_parts", "_part", "_s", "_e", "_longer", "_f")


def bilingual_pairs(blocks: DataFrame) -> DataFrame:
    """(doc_id, pairs): adjacent blocks (doc_id, id, text) of which one has an ASCII letter and the next an ideograph."""
    w = Window.partitionBy("doc_id").orderBy("id")
    shown = blocks.where(T.strip(T.text_of("text")) != "")
    follows = F.lead("text").over(w).rlike("[\\u4E00-\\u9FFF]")
    return shown.withColumn("_p", F.col("text").rlike("[A-Za-z]") & follows).groupBy("doc_id").agg(F.count_if("_p").alias("pairs"))


def neighbours_overlap(blocks: DataFrame) -> DataFrame:
    """Each block (doc_id, id, text) with the overlap between it and the one before, and whether that is a seam fault."""
    w = Window.partitionBy("doc_id").orderBy("id")
    flat = blocks.withColumn("_t", T.collapse(T.text_of("text"))).where("_t <> ''").withColumn("_b", F.lag("_t").over(w))
    both = flat.withColumn("overlap", F.when(F.col("_b").isNotNull(), T.leading_overlap("_b", "_t")))
    same = F.col("_b") == F.col("_t")
    return both.select("doc_id", "id", F.length("overlap").alias("overlap_chars"), F.coalesce(same | T.is_strong_quality_overlap(F.col("overlap")), F.lit(False)).alias("seam_fault"))


def previous_active(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, id, status, text, ...) that are not superseded, with the one before: its id, its tail and its last section title."""
    w = Window.partitionBy("doc_id").orderBy("id")
    active = chunks.where("status <> 'superseded'")
    return active.withColumn("previous_id", F.lag("id").over(w)).withColumn("_t", F.lag("text").over(w)).withColumn("tail", F.when(F.col("_t").isNotNull(), T.tail_sentences("_t", 2)).otherwise("")).withColumn("section", F.when(F.col("_t").isNotNull(), T.last_section_title("_t")).otherwise("")).drop("_t")


_HEAD, _SECTION, _TAIL = "## Continuity Context\n\nThe chunk before, for reference only.\n{}\n{}", "Previous section title", "Previous chunk tail"
BOUNDARY, OUTPUT = "Work on the chunk below only.", "Leave this context out of the output."


def continuity_block(tail: str, section: str, boundary: str = BOUNDARY, output: str = OUTPUT) -> str:
    """The context_text of continuity() for one chunk in a worker."""
    parts = [f"{label}:\n{x}" for label, x in ((_SECTION, section), (_TAIL, tail)) if x]
    return "\n\n".join([_HEAD.format(boundary, output), *parts]).strip() if parts else ""


def continuity(chunks: DataFrame, input_key: str = "raw_path", sentences: int = 1, mode: str = "reference_only", boundary: str = BOUNDARY, output: str = OUTPUT) -> DataFrame:
    """chunks with what goes on from the active chunk before: context_tail, context_section, source_chunk_id, context_text, context_tokens, context_mode.

    chunks: (doc_id, id, status) and any of processed_input_tail_context_text, processed_tail_context_text, processed_text, tail_context_text,
    processed_input_section_title and last_section_title; absent ones are blank. In a chain over processed text the tail is the stored
    tail of the input, else that of the output, else the last sentences of processed_text if there is one, else the raw tail; over raw text it
    is the raw tail alone. The section title is the one stored for the input (processed text only), else the last one stored, else the last
    heading of processed_text. Without both there is no context: blank text, no source, no tokens.
    """
    w = Window.partitionBy("doc_id").orderBy("id")
    active = chunks.where("status <> 'superseded'")
    before = lambda c: F.lag(c).over(w) if c in chunks.columns else F.lit(None).cast("string")
    stored = lambda c: F.nullif(T.strip(T.text_of(before(c))), F.lit(""))
    processed, raw = before("processed_text"), stored("tail_context_text")
    again = F.when(processed.isNotNull(), T.tail_sentences(processed, sentences))
    chain = input_key == "processed_path"
    tail = F.coalesce(stored("processed_input_tail_context_text"), stored("processed_tail_context_text"), again, raw, F.lit("")) if chain else F.coalesce(raw, F.lit(""))
    titles = [stored("processed_input_section_title")] if chain else []
    section = F.coalesce(*titles, stored("last_section_title"), F.when(processed.isNotNull(), T.last_section_title(processed)), F.lit(""))
    out = active.withColumn("context_tail", tail).withColumn("context_section", section).withColumn("_from", F.lag("id").over(w))
    some = (F.col("context_tail") != "") | (F.col("context_section") != "")
    part = lambda c, label: F.when(F.col(c) != "", F.concat(F.lit(f"{label}:\n"), c))
    text = T.strip(F.concat_ws("\n\n", F.lit(_HEAD.format(boundary, output)), part("context_section", _SECTION), part("context_tail", _TAIL)))
    out = out.withColumn("source_chunk_id", F.when(some, F.col("_from"))).withColumn("context_text", F.when(some, text).otherwise("")).drop("_from")
    return out.withColumn("context_tokens", F.when(some, T.estimate_tokens("context_text")).otherwise(0)).withColumn("context_mode", F.lit(mode))


def streaks(events: DataFrame, flag: str, n: int, by: str = "doc_id", order: str = "id") -> DataFrame:
    """(by, streaks, longest, first_stop): runs of rows with flag in each group; first_stop is the place where the n-th in a row comes."""
    w = Window.partitionBy(by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = events.withColumn("_run", F.sum((~F.col(flag)).cast("int")).over(upto))
    length = F.row_number().over(Window.partitionBy(by, "_run").orderBy(order))
    counted = marked.where(flag).withColumn("_n", length)
    return counted.groupBy(by).agg(F.countDistinct("_run").alias("streaks"), F.max("_n").alias("longest"), F.min(F.when(F.col("_n") >= n, F.col(order))).alias("first_stop"))


def continue_ids(parts: DataFrame) -> DataFrame:
    """Segments of the chunks of a document (doc_id, chunk, pos, ...) numbered from 0 over all chunks."""
    return parts.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "pos")) - 1)
