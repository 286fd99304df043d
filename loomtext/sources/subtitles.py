"""Subtitle sources: WebVTT files to one row for each cue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def timestamp_seconds(x: Column) -> Column:
    """H:M:S.ms or M:S.ms, with a point or a comma, as seconds rounded to 3 places; null for anything else."""
    parts = F.transform(F.split(F.replace(F.btrim(x), F.lit(","), F.lit(".")), ":"), lambda p: p.try_cast("double"))
    whole = F.forall(parts, lambda p: p.isNotNull())
    seconds = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    return F.when(F.size(parts).isin(2, 3) & whole, F.round(seconds, 3))


def time_range(line: Column) -> Column:
    """struct(start_time, end_time) of a ``-->`` line; settings behind the end are ignored."""
    sides = F.split(line, "-->", 2)
    token = lambda s: F.get(F.split(T.strip(s), r"(?U)\s+"), F.lit(0))
    return F.struct(timestamp_seconds(token(F.get(sides, F.lit(0)))).alias("start_time"), timestamp_seconds(token(F.get(sides, F.lit(1)))).alias("end_time"))


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """Files as (doc_id, text): doc_id is the path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def cues(docs: DataFrame) -> DataFrame:
    """(doc_id, cue, start_time, end_time, text, language) from (doc_id, text): the raw cues of WebVTT texts.

    A line with ``-->`` begins a cue and a blank one ends it; lines outside cues are dropped, NOTE blocks
    and lines that begin like headers everywhere. A NOTE may stand in a cue: the blank line behind it ends the note alone. Each
    document's lines are numbered and folded with windows over that document alone.
    """
    return cues_of_lines(docs.select("doc_id", F.posexplode(F.split(F.replace(T.text_of("text"), F.lit("﻿"), F.lit("")), r"\r\n|\r|\n")).alias("k", "raw")))


def cues_of_lines(lines: DataFrame) -> DataFrame:
    """cues() of lines (doc_id, k, raw) in the order of k, as files.read_lines gives them."""
    lines = lines.withColumn("line", T.strip(F.replace(F.col("raw"), F.lit("﻿"), F.lit(""))))
    w = Window.partitionBy("doc_id").orderBy("k")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blank = F.col("line") == ""
    # The state of a line is set by the last line that changes it: a blank one or a NOTE.
    lines = lines.withColumn("stretch", F.sum(blank.cast("int")).over(upto))
    in_stretch = Window.partitionBy("doc_id", "stretch").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("noted", F.max(F.col("line").startswith("NOTE").cast("int")).over(in_stretch) == 1)
    header = F.col("line").rlike(r"\A(?:WEBVTT|Kind:|Style:|STYLE|REGION)")
    language = F.regexp_extract("line", r"\ALanguage:\s*(.*)\z", 1)
    spoken = lines.withColumn("language", F.first(F.when(F.col("line").startswith("Language:"), language), True).over(Window.partitionBy("doc_id")))
    ends_note = blank & F.coalesce(F.lag("noted").over(w), F.lit(False))
    kept = spoken.withColumn("ends_note", ends_note).where(~F.col("noted") & ~header & ~F.col("ends_note"))
    timing = F.col("line").contains("-->")
    kept = kept.withColumn("part", F.sum((timing | blank).cast("int")).over(upto)).withColumn("timed", timing)
    cue = kept.groupBy("doc_id", "part").agg(
        F.max(F.when(F.col("timed"), F.col("line"))).alias("timing"),
        F.array_sort(F.collect_list(F.when(~F.col("timed") & ~blank, F.struct("k", "line")))).alias("body"),
        F.first("language", True).alias("language"),
    )
    cue = cue.where("timing IS NOT NULL").withColumn("t", time_range(F.col("timing"))).where("t.start_time IS NOT NULL AND t.end_time IS NOT NULL")
    text = F.array_join(F.transform("body", lambda b: b["line"]), "\n")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return cue.select("doc_id", number.alias("cue"), F.col("t.start_time").alias("start_time"), F.col("t.end_time").alias("end_time"), text.alias("text"), "language")


def fold_cues(cues: DataFrame) -> DataFrame:
    """Segments and counters of documents from their cues: (doc_id, segments, diagnostics).

    Cues are folded in order. One equal to the last segment extends it; one that begins with the end of the last
    segment, as already trimmed, loses that overlap, and extends it if nothing is left. A document's cues
    are one array; documents are folded in parallel.
    """
    ready = cues.withColumn("line", T.cue_line("text")).withColumn("clean", F.col("line.text")).withColumn("markup", T.markup_counts("text"))
    ready = ready.withColumn("gaps", T.tighten_counts(F.regexp_replace(T.normalize_body(T.strip_markup("text")), r"[ \t]+", " ")))
    per_doc = ready.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("cue", "clean", "start_time", "end_time"))).alias("cues"),
        F.count(F.lit(1)).alias("cue_count"),
        F.count_if(F.col("clean") == "").alias("empty_cue_count"),
        F.sum("line.inserted").alias("inserted_ascii_space_count"),
        *[F.sum(f"markup.{c}").alias(c) for c in ("markup_tag_count", "nbsp_entity_count")],
        *[F.sum(f"gaps.{c}").alias(c) for c in ("collapsed_cjk_spacing_count", "tightened_punctuation_spacing_count", "tightened_bracket_spacing_count")],
    )
    segment = "array<struct<text:string,start_time:double,end_time:double>>"
    start = F.struct(F.array().cast(segment).alias("out"), F.lit(0).alias("same"), F.lit(0).alias("trimmed"), F.lit(0).alias("collapsed"), F.lit(0).alias("chars"))

    def step(a: Column, c: Column) -> Column:
        last = F.try_element_at(a["out"], F.lit(-1))
        none, same = F.size(a["out"]) == 0, last["text"] == c["clean"]
        cut = F.when(none, F.struct(c["clean"].alias("text"), F.lit(False).alias("overlap_trimmed"), F.lit(False).alias("collapsed_to_empty"), F.lit(0).alias("overlap_chars"))).otherwise(T.trim_overlap(last["text"], c["clean"]))
        # One array element keeps the parts together, so that the costly overlap is worked out once.
        return F.get(F.transform(F.array(cut), lambda t: _folded(a, c, t, last, none, same)), F.lit(0))

    folded = F.aggregate(F.filter("cues", lambda c: c["clean"] != ""), start, step)
    out = per_doc.withColumn("f", folded)
    segments = F.transform("f.out", lambda s, i: F.struct(i.alias("id"), s["text"].alias("text"), s["start_time"].alias("start_time"), s["end_time"].alias("end_time"), F.lit(None).cast("string").alias("speaker")))
    counters = F.struct(
        "cue_count", "empty_cue_count", F.col("f.same").alias("exact_duplicate_cue_count"), F.col("f.trimmed").alias("overlap_trim_count"),
        F.col("f.chars").alias("overlap_trimmed_chars"), F.col("f.collapsed").alias("overlap_collapsed_cue_count"), "markup_tag_count", "nbsp_entity_count",
        "inserted_ascii_space_count", "collapsed_cjk_spacing_count", "tightened_punctuation_spacing_count", "tightened_bracket_spacing_count",
    )
    return out.select("doc_id", segments.alias("segments"), counters.alias("diagnostics"))


def _folded(a: Column, c: Column, t: Column, last: Column, none: Column, same: Column) -> Column:
    extend = ~none & (same | (t["overlap_trimmed"] & t["collapsed_to_empty"]))
    later = F.greatest(last["end_time"], c["end_time"])
    longer = F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.struct(last["text"].alias("text"), last["start_time"].alias("start_time"), later.alias("end_time"))))
    added = F.concat(a["out"], F.array(F.struct(t["text"].alias("text"), c["start_time"].alias("start_time"), c["end_time"].alias("end_time"))))
    trimmed = ~none & ~same & t["overlap_trimmed"]
    return F.struct(
        F.when(extend, longer).otherwise(added).alias("out"),
        (a["same"] + (~none & same).cast("int")).alias("same"),
        (a["trimmed"] + trimmed.cast("int")).alias("trimmed"),
        (a["collapsed"] + (trimmed & t["collapsed_to_empty"]).cast("int")).alias("collapsed"),
        (a["chars"] + F.when(trimmed, t["overlap_chars"]).otherwise(0)).alias("chars"),
    )


def vtt_segments(docs: DataFrame) -> DataFrame:
    """(doc_id, id, text, start_time, end_time, speaker): one row for each segment of WebVTT texts."""
    return fold_cues(cues(docs)).select("doc_id", F.inline("segments"))


def vtt_text(segments: DataFrame) -> DataFrame:
    """(doc_id, text): the segments as lines, normalised as one text; a line feed between CJK characters is closed."""
    lines = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("s"))
    return lines.select("doc_id", T.normalize_subtitle(F.array_join(F.transform("s", lambda s: s["text"]), "\n")).alias("text"))


def subtitle_candidates(metadata: DataFrame) -> DataFrame:
    """(doc_id, rank, language, mode) from (doc_id, subtitles, automatic_captions: maps of language to tracks).

    Chinese before English, manual before automatic; a language matches zh or en, or begins so with a hyphen; each
    language once.
    """
    modes = [("manual", "subtitles"), ("auto", "automatic_captions")]
    tracks = None
    for k, (mode, column) in enumerate(modes):
        part = metadata.select("doc_id", F.explode(F.map_keys(F.col(column))).alias("language"), F.lit(mode).alias("mode"), F.lit(k).alias("m"))
        tracks = part if tracks is None else tracks.unionByName(part)
    family = F.when(F.col("language").rlike(r"\A(?:zh)(?:-|\z)"), 0).when(F.col("language").rlike(r"\A(?:en)(?:-|\z)"), 1)
    tracks = tracks.withColumn("family", family).where("family IS NOT NULL")
    exact = (~F.col("language").isin("zh", "en")).cast("int")
    tracks = tracks.groupBy("doc_id", "language", "family").agg(F.min("m").alias("m"), F.min_by("mode", "m").alias("mode"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("family", "m", exact, "language"))
    return tracks.select("doc_id", rank.alias("rank"), "language", "mode")


def classify_download_failure(log: Column | str) -> Column:
    t = F.lower(T.text_of(log))
    return F.when(t.contains("429") | t.contains("too many requests"), "rate_limited").when(t.contains("not a bot") | t.contains("sign in to confirm"), "bot_verification").otherwise("download_failed")


def first_success(attempts: DataFrame) -> DataFrame:
    """(doc_id, language, mode) of the successful attempt with the least rank, from (doc_id, rank, language, mode, success)."""
    won = attempts.where("success").groupBy("doc_id").agg(F.min_by(F.struct("language", "mode"), "rank").alias("a"))
    return won.select("doc_id", "a.language", "a.mode")


def pick_audio(formats: Column) -> Column:
    """format_id of the best of an array of struct(format_id, vcodec, acodec, language): audio alone; Chinese, then 140, then the first."""
    audio = F.filter(formats, lambda f: (f["vcodec"] == "none") & (f["acodec"] != "none"))
    chinese = F.filter(audio, lambda f: F.coalesce(f["language"], F.lit("")).startswith("zh"))
    usual = F.filter(audio, lambda f: f["format_id"] == "140")
    return F.coalesce(F.get(chinese, F.lit(0))["format_id"], F.get(usual, F.lit(0))["format_id"], F.get(audio, F.lit(0))["format_id"])
