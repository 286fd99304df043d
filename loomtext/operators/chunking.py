"""Packing sentences and segments into chunks under a budget."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds, scan
from ..functions import text as T
from . import segments as S

SEPARATOR = "\n\n"
# The budgets of the tasks in tokens, and those of other tasks.
TARGET = {"structure_only": 1200, "quick_cleanup": 1000, "cleanup_zh": 1000, "translate_only": 900, "summarize": 2500}
REQUEST_CAP = {"structure_only": 3000, "quick_cleanup": 4500, "cleanup_zh": 4500, "translate_only": 2600, "summarize": 4500}
OUTPUT_RATIO = {"structure_only": 1.15, "quick_cleanup": 1.05, "cleanup_zh": 1.05, "translate_only": 1.10, "summarize": 0.15}
MOST_OUTPUT = {"structure_only": 1800, "quick_cleanup": 3200, "cleanup_zh": 3200, "translate_only": 1500, "summarize": 384}
OTHER_TARGET, OTHER_CAP, OTHER_RATIO, OTHER_OUTPUT = 900, 2600, 1.0, 1400
#: Targets where sizes are characters.
CHARS, OTHER_CHARS = {"translate_only": 3000, "structure_only": 4000, "quick_cleanup": 4000, "summarize": 8000}, 8000
WINDOW, UTILISATION, BUFFER = 32_000, 0.12, 400


@dataclass(frozen=True)
class Budget:
    target: int
    hard_cap: int
    available: int
    #: Output that is expected, and what a request may ask for.
    output: int
    planned_output: int
    effective: int


def solve_budget(task: str, prompt_tokens: int, reserve: int = 0, multiplier: float = 1.33, window: int = WINDOW, buffer: int = BUFFER, target: int = 0) -> Budget:
    """Sizes for a task, on the driver. reserve: tokens for the text that goes on from the chunk before; target: the size wanted, if not the task's.

    A target that the budget has no room for shrinks, which shrinks the output expected, which makes room: two rounds settle it.
    """
    want = target or TARGET.get(task, OTHER_TARGET)
    ratio, most = OUTPUT_RATIO.get(task, OTHER_RATIO), MOST_OUTPUT.get(task, OTHER_OUTPUT)
    effective = min(REQUEST_CAP.get(task, OTHER_CAP), int(max(1024, window) * UTILISATION))
    free = effective - prompt_tokens - reserve - buffer
    expected = lambda n: min(most, math.ceil(n * ratio))
    room = lambda n: max(1, free - expected(n))
    for _ in range(2):
        want = min(want, room(want))
    cap = max(want, min(math.ceil(want * min(2.0, max(1.0, multiplier))), room(want)))
    return Budget(want, cap, room(want), expected(want), max(expected(want), min(most, free - want)), effective)


def plan_sizes(task: str = "", size: int = 0, mode: str = "tokens", prompt_tokens: int = 0, multiplier: float = 1.33, reserve: int = 0) -> dict:
    """mode, recommended, target and cap of a run: a size without a task counts characters; tokens are bounded by the task's budget."""
    if mode == "chars" or (size > 0 and not task):
        recommended = CHARS.get(task, OTHER_CHARS)
        return {"mode": "chars", "recommended": recommended, "target": size or recommended, "cap": size or recommended}
    b = solve_budget(task, prompt_tokens, reserve, multiplier)
    target = max(1, min(size or b.target, b.available))
    return {"mode": "tokens", "recommended": TARGET.get(task, OTHER_TARGET), "target": target, "cap": max(target, min(math.ceil(target * multiplier), b.hard_cap))}


def _gap(mode: str) -> int:
    return len(SEPARATOR) if mode == "chars" else 1


def pack(units: Column, target: int, cap: int, mode: str = "tokens", fresh: Column | None = None, measures: Column | None = None, tokens: bool = True) -> Column:
    """Array of chunks, each struct(content, units, first, chars, tokens), of an array of texts in order, greedily.

    fresh: an array of booleans beside units; a unit with true begins a chunk. measures: scan.unit_counts of the units, if known. One scan
    measures the units; only sizes go through the fold, a chunk is a slice of the units, and its tokens are sums. With mode ``chars`` and
    without tokens (0 then) no text goes to Python.
    """
    if mode == "chars" and not tokens and measures is None:
        sizes = F.transform(units, lambda u: F.coalesce(F.length(u), F.lit(0)))
    else:
        measures = scan.unit_counts(units) if measures is None else measures
        sizes = measures["chars" if mode == "chars" else "tokens"]
    ranges = folds.chunk_ranges(sizes, fresh, min(target, cap), _gap(mode), measures)

    def chunk(u: Column, r: Column) -> Column:
        content = F.array_join(F.slice(u, r["first"] + 1, r["units"]), SEPARATOR)
        return T.let(content, lambda c: F.struct(c.alias("content"), r["units"].alias("units"), r["first"].alias("first"), F.length(c).alias("chars"), r["tokens"].cast("long").alias("tokens")))

    return T.let(F.struct(units.alias("u"), ranges.alias("r")), lambda b: F.transform(b["r"], lambda r: chunk(b["u"], r)))


def fitted(docs: DataFrame, units: Column, cap: int, mode: str, out: str = "f") -> DataFrame:
    """docs with out: struct(u, m), units and their measures (scan.unit_counts), those larger than cap cut into pieces that are not. Tokens are
    measured, cut and measured again by one function (folds.fitted_units), so that the units are made and passed on once."""
    if mode == "chars":
        cut = F.flatten(F.transform(units, lambda u: F.when(F.length(u) > cap, T.hard_split(u, cap)).otherwise(F.array(u))))
        return docs.withColumn("_u", cut).withColumn(out, F.struct(F.col("_u").alias("u"), scan.unit_counts(F.col("_u")).alias("m"))).drop("_u")
    made = docs.withColumn("_u", units).withColumn("_f", folds.fitted_units(F.col("_u"), cap))
    return made.withColumn(out, F.struct(F.coalesce("_f.pieces", "_u").alias("u"), F.col("_f.measures").alias("m"))).drop("_u", "_f")


def chunk_text(docs: DataFrame, target: int = 1200, cap: int = 1596, mode: str = "tokens") -> DataFrame:
    """(doc_id, chunk_id, content, n_sentences, chars, tokens): documents (doc_id, text) split into sentences and packed."""
    units = fitted(docs.select("doc_id", T.split_sentences("text").alias("_s")), F.col("_s"), cap, mode).select("doc_id", "f")
    chunks = pack(F.col("f.u"), target, cap, mode, measures=F.col("f.m"))
    return units.select("doc_id", F.posexplode(chunks).alias("chunk_id", "c")).select("doc_id", "chunk_id", "c.content", F.col("c.units").alias("n_sentences"), "c.chars", "c.tokens")


def _numbered(listed: DataFrame, units: str, limit: int, gap: int) -> DataFrame:
    """A row for each of the array column units (struct with size and fresh): its fields, k, its place, and chunk_id."""
    u = F.col(units)
    ranged = listed.withColumn("_r", folds.chunk_ranges(u["size"], u["fresh"], limit, gap))
    each = T.exploded(ranged, "_r", "chunk_id", "_c")
    parts = F.transform(F.slice(u, F.col("_c.first") + 1, F.col("_c.units")), lambda v, i: F.struct((F.col("_c.first") + i).alias("k"), v.alias("v")))
    rest = [c for c in listed.columns if c != units]
    return each.select(*rest, "chunk_id", F.inline(parts)).select(*rest, "chunk_id", "k", "v.*")


def joined_starts(chunks: list[dict], target: int, cap: int, mode: str) -> list[int]:
    """The places of the chunks (size_, segments, fresh) of one document at which joined chunks begin. Sizes of joined chunks are sums, with the separator between.

    The cursor moves back after a merge, which no fold over an array does.
    """
    floor = max(60, min(120, max(1, target // 6))) if mode == "tokens" else max(40, min(80, max(1, target // 6)))
    slack, gap = max(10, floor // 2), _gap(mode)
    specs = [{"at": i, "size": c["size_"], "segments": c["segments"], "fresh": bool(c["fresh"])} for i, c in enumerate(chunks)]
    k = 0
    while len(specs) >= 2 and k < len(specs) and len(chunks) >= 3:
        now = specs[k]
        if now["size"] >= floor or (now["segments"] > 1 and now["size"] > max(20, floor // 2)):
            k += 1
            continue
        ways = []
        if k + 1 < len(specs):
            total = now["size"] + specs[k + 1]["size"] + gap
            ways.append((total > cap, 0 if now["fresh"] else 1, total, 1))
        if k and not now["fresh"]:
            total = now["size"] + specs[k - 1]["size"] + gap
            ways.append((total > cap, 0, total, -1))
        if not ways or (min(ways)[0] and min(ways)[2] > cap + slack):
            k += 1
            continue
        side = min(ways)[3]
        at = k + min(0, side)
        left, right = specs[at], specs.pop(at + 1)
        specs[at] = {"at": left["at"], "size": left["size"] + right["size"] + gap, "segments": left["segments"] + right["segments"], "fresh": left["fresh"]}
        k = at
    return [s["at"] for s in specs]


def _starts(chunks: Column, target: int, cap: int, mode: str) -> Column:
    """array<int>: joined_starts of an array of struct(size_, segments, fresh); no texts."""

    @F.arrow_udf("array<int>")
    def starts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([None if own is None else joined_starts(own, target, cap, mode) for own in lists.to_pylist()], pa.list_(pa.int32()))

    return starts(chunks)


def coalesce_small(chunks: DataFrame, target: int, cap: int, mode: str = "tokens") -> DataFrame:
    """(doc_id, chunk_id, merged_id): undersized chunks (doc_id, chunk_id, size_, segments, fresh) joined to a neighbour.

    A document's chunks are one array of sizes, and go through Python with those of other documents.
    """
    whole = F.array_sort(F.collect_list(F.struct(F.col("chunk_id").cast("int").alias("chunk_id"), "size_", "segments", "fresh")))
    listed = chunks.groupBy("doc_id").agg(whole.alias("c"))
    sizes = F.transform("c", lambda c: F.struct(c["size_"].cast("long").alias("size_"), c["segments"].cast("long").alias("segments"), c["fresh"].alias("fresh")))
    begun = listed.withColumn("_s", _starts(sizes, target, cap, mode))
    to = F.flatten(F.transform("_s", lambda s, j: F.array_repeat(j, F.coalesce(F.get("_s", j + 1), F.size("c")) - s)))
    return begun.select("doc_id", F.inline(F.arrays_zip(F.col("c.chunk_id").alias("chunk_id"), to.alias("merged_id")))).select("doc_id", "chunk_id", F.col("merged_id").cast("int").alias("merged_id"))


def chunk_segments(segments: DataFrame, target: int, cap: int, mode: str = "tokens", breaks: DataFrame | None = None, join_small: bool = True) -> DataFrame:
    """(doc_id, chunk_id, content, start_time, end_time, duration_sec, first_segment, last_segment, n_segments, starts_chapter).

    Segments (doc_id, id, text, start_time, end_time) longer than cap are cut, then packed in order; a segment of
    breaks (doc_id, id) begins a chunk. Undersized chunks are joined to a neighbour if the document has three. A document's parts are
    brought together once; its chunks are stretches of that array.
    """
    parts = S.split_timed(segments, cap, mode, "size").withColumn("part_index", F.coalesce("part_index", F.lit(0)))
    if breaks is None:
        parts = parts.withColumn("fresh", F.lit(False))
    else:
        parts = parts.join(breaks.select("doc_id", "id", F.lit(True).alias("_b")), ["doc_id", "id"], "left").withColumn("fresh", F.coalesce("_b", F.lit(False)) & (F.col("part_index") == 0)).drop("_b")
    listed = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "part_index", "text", "start_time", "end_time", "fresh", "size"))).alias("p"))
    ranged = listed.withColumn("_r", folds.chunk_ranges(F.col("p.size"), F.col("p.fresh"), min(target, cap), _gap(mode)))
    if join_small:
        ranged = ranged.withColumn("_s", _starts(F.transform("_r", lambda r: _size_of(F.slice("p", r["first"] + 1, r["units"]), mode)), target, cap, mode))
        ranged = ranged.withColumn("_at", F.transform("_s", lambda s: F.get("_r", s)["first"]))
    else:
        ranged = ranged.withColumn("_at", F.col("_r.first"))
    stretch = lambda a, i: F.slice("p", a + 1, F.coalesce(F.get("_at", i + 1), F.size("p")) - a)
    chunks = ranged.select("doc_id", F.transform("_at", lambda a, i: T.let(stretch(a, i), _chunk_of)).alias("_c"))
    out = T.exploded(chunks, "_c", "chunk_id", "c").select("doc_id", "chunk_id", "c.*")
    return out.withColumn("duration_sec", F.round(F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time")), 3))


def _size_of(parts: Column, mode: str) -> Column:
    """struct(size_, segments, fresh) of a chunk's parts."""

    def whole(v: Column) -> Column:
        size = F.aggregate(v["size"], F.lit(0).cast("long"), lambda a, n: a + n) + _gap(mode) * (F.size(v) - 1)
        return F.struct(size.cast("long").alias("size_"), _distinct(v["id"]).alias("segments"), F.get(v["fresh"], F.lit(0)).alias("fresh"))

    return T.let(parts, whole)


def _distinct(ids: Column) -> Column:
    return F.size(F.array_distinct(F.array_compact(ids))).cast("long")


def _chunk_of(v: Column) -> Column:
    """A chunk as a struct, of its parts (id, text, start_time, end_time, fresh) in order; missing times are passed over."""
    known = lambda c, k: F.try_element_at(F.array_compact(v[c]), F.lit(k))
    return F.struct(
        F.array_join(v["text"], SEPARATOR).alias("content"),
        known("start_time", 1).alias("start_time"),
        known("end_time", -1).alias("end_time"),
        F.get(v["id"], F.lit(0)).alias("first_segment"),
        F.try_element_at(v["id"], F.lit(-1)).alias("last_segment"),
        _distinct(v["id"]).alias("n_segments"),
        F.get(v["fresh"], F.lit(0)).alias("starts_chapter"),
    )


def chunk_documents(docs: DataFrame, target: int, cap: int, mode: str = "tokens", chapters: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_id, source_kind, content, start_time, end_time, chars, tokens): each document chunked from the source it prefers.

    docs: (doc_id, text, segments, preferred_chunk_source), segments an array of struct(id, text, start_time, end_time). Documents that
    prefer segments and have some go by these, with chunks that begin where chapters (doc_id, chapter, start_time) do; all
    others go by the sentences of their text, without times.
    """
    timed = (F.col("preferred_chunk_source") == "segments") & (F.size(F.coalesce("segments", F.array().cast(docs.schema["segments"].dataType))) > 0)
    rows = docs.where(timed).select("doc_id", F.inline("segments")).select("doc_id", F.col("id").cast("int").alias("id"), "text", "start_time", "end_time")
    breaks = S.chapter_breaks(chapters, rows) if chapters is not None else None
    of = lambda df, kind, *times: df.select("doc_id", "chunk_id", F.lit(kind).alias("source_kind"), "content", *times, F.length("content").alias("chars"), T.estimate_tokens("content").alias("tokens"))
    by_segments = of(chunk_segments(rows, target, cap, mode, breaks), "segments", "start_time", "end_time")
    none = F.lit(None).cast("double")
    by_text = of(chunk_text(docs.where(~F.coalesce(timed, F.lit(False))).select("doc_id", "text"), target, cap, mode), "text", none.alias("start_time"), none.alias("end_time"))
    return by_segments.unionByName(by_text)


def manifest(chunks: DataFrame, plan_id: str, tail: int = 2) -> DataFrame:
    """Entries for a run from chunks (doc_id, chunk_id, content, ...): names, sizes, tails, pending."""
    number = F.lpad(F.col("chunk_id").cast("string"), 3, "0")
    return chunks.select(
        "doc_id",
        F.lit(plan_id).alias("plan_id"),
        F.col("chunk_id").alias("id"),
        F.concat(F.lit("chunk_"), number, F.lit(".txt")).alias("raw_path"),
        F.concat(F.lit("processed_"), number, F.lit(".md")).alias("processed_path"),
        F.lit("pending").alias("status"),
        F.length("content").alias("char_count"),
        scan.text_counts(F.col("content"))["tokens"].alias("estimated_input_tokens"),
        T.tail_sentences("content", tail).alias("tail_context_text"),
        F.lit(0).alias("attempts"),
    )


def replan(chunks: DataFrame, breaks: DataFrame | None, target: int, cap: int, mode: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(all chunks, old_to_new): pending chunks (doc_id, id, status, text) superseded and packed anew behind the largest id.

    Text is split at the chunks that begin a chapter (breaks: doc_id, id). old_to_new has, for each old chunk, the
    new one in which its text begins.
    """
    pending = chunks.where(~F.col("status").isin("done", "superseded"))
    top = chunks.groupBy("doc_id").agg(F.max("id").alias("top"))
    units = fitted(pending.select("doc_id", "id", T.split_sentences("text").alias("_s")), F.col("_s"), cap, mode)
    size = F.transform("f.m", lambda m: m["chars" if mode == "chars" else "tokens"])
    units = units.select("doc_id", "id", F.posexplode(F.arrays_zip(F.col("f.u").alias("u"), size.alias("size"))).alias("s", "f")).select("doc_id", "id", "s", F.col("f.u").alias("u"), F.col("f.size").alias("size"))
    if breaks is not None:
        units = units.join(breaks.select("doc_id", "id", F.lit(True).alias("_b")), ["doc_id", "id"], "left").withColumn("fresh", F.coalesce("_b", F.lit(False)) & (F.col("s") == 0))
    else:
        units = units.withColumn("fresh", F.lit(False))
    listed = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "s", "u", "fresh", "size"))).alias("x"))
    rows = _numbered(listed, "x", min(target, cap), _gap(mode)).withColumnRenamed("chunk_id", "n").join(top, "doc_id")
    rows = rows.withColumn("new_id", F.col("top") + 1 + F.col("n"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("id", "s", "u"))), lambda v: v["u"])
    made = rows.groupBy("doc_id", "new_id").agg(F.array_join(texts, SEPARATOR).alias("text")).select("doc_id", F.col("new_id").alias("id"), F.lit("pending").alias("status"), "text")
    kept = chunks.select("doc_id", "id", F.when(F.col("status").isin("done", "superseded"), F.col("status")).otherwise("superseded").alias("status"), "text")
    return kept.unionByName(made), rows.groupBy("doc_id", F.col("id").alias("old_id")).agg(F.min("new_id").alias("new_id"))
