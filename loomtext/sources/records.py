"""Sources of records: segments, chapters, documents, metadata, state files and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SEGMENT = "struct<id:string,text:string,start_time:string,end_time:string,speaker:string>"
CHAPTER = "struct<title:string,title_en:string,title_zh:string,start_time:string,end_time:string>"
EVENT = "event_type string, command string, trace_id string, timestamp string, duration_ms string, success string, warning_count string, document_id string, prompt_name string"


def _array(json: Column, field: str, element: str) -> Column:
    """The array in field of an object, or the top-level array."""
    inside = F.from_json(json, f"struct<{field}:array<{element}>>")[field]
    return F.when(F.btrim(json).startswith("["), F.from_json(json, f"array<{element}>")).otherwise(inside)


def load_segments(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """(doc_id, id, text, start_time, end_time, speaker): entries that are objects with text; an id that is missing is the entry's place."""
    rows = docs.select("doc_id", F.posexplode(_array(F.col(json_col), "segments", SEGMENT)).alias("k", "s")).where(T.strip(T.text_of(F.col("s.text"))) != "")
    return rows.select("doc_id", F.coalesce(F.col("s.id").try_cast("int"), F.col("k")).alias("id"), T.strip(F.col("s.text")).alias("text"), T.lenient_double("s.start_time").alias("start_time"), T.lenient_double("s.end_time").alias("end_time"), F.col("s.speaker").alias("speaker"))


def load_chapters(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """(doc_id, chapter, title, title_en, title_zh, start_time, end_time) from an object with chapters, or an array."""
    rows = docs.select("doc_id", F.posexplode(_array(F.col(json_col), "chapters", CHAPTER)).alias("chapter", "c")).where("c IS NOT NULL")
    return rows.select("doc_id", "chapter", "c.title", "c.title_en", "c.title_zh", T.lenient_double("c.start_time").alias("start_time"), T.lenient_double("c.end_time").alias("end_time"))


def load_documents(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """(doc_id, source_type, mode, text, segments): normalised again by the family of the source."""
    ddl = f"struct<source:struct<type:string,url:string,title:string,channel:string,subtitle_source:string>,workflow:struct<mode:string>,content:struct<text:string>,segments:array<{SEGMENT}>>"
    d = docs.withColumn("d", F.from_json(json_col, ddl))
    subtitles = F.col("d.source.type") == "youtube"
    text = F.when(subtitles, T.normalize_subtitle("d.content.text")).otherwise(T.normalize_body("d.content.text"))
    each = lambda s: F.struct(s["id"].try_cast("int").alias("id"), F.when(subtitles, T.normalize_cue(s["text"])).otherwise(T.normalize_body(s["text"])).alias("text"), s["start_time"].try_cast("double").alias("start_time"), s["end_time"].try_cast("double").alias("end_time"), s["speaker"].alias("speaker"))
    return d.select("doc_id", F.col("d.source.type").alias("source_type"), F.col("d.workflow.mode").alias("mode"), text.alias("text"), F.filter(F.transform("d.segments", each), lambda s: s["text"] != "").alias("segments"))


def state_map(text: Column | str) -> Column:
    """Map of the ``key: value`` lines of a state file; lines that begin with # or - are left out and the last of a key counts."""
    lines = F.filter(F.transform(F.split(T.text_of(text), r"\r\n|\r|\n"), T.strip), lambda s: s.contains(":") & ~s.startswith("#") & ~s.startswith("-"))
    pairs = F.transform(lines, lambda s: F.struct(T.strip(F.split_part(s, F.lit(":"), F.lit(1))).alias("k"), T.strip(F.regexp_replace(s, r"(?s)\A[^:]*:", "")).alias("v")))
    latest = T.let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"])))
    return F.map_from_entries(latest)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON log as (seq, value): seq is the place in the file."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("seq"), "value")


def parse_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, faults) from (seq, value): typed events, and one row of malformed and non_object counts."""
    blank = F.btrim("value") == ""
    known = lines.where(~blank).withColumn("v", F.try_parse_json("value"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    faults = known.agg(F.count_if(F.col("v").isNull()).alias("malformed"), F.count_if(F.col("v").isNotNull() & ~is_object).alias("non_object"))
    e = known.where(F.col("v").isNotNull() & is_object).withColumn("e", F.from_json("value", EVENT))
    number = lambda c: F.greatest(T.lenient_long(f"e.{c}"), F.lit(0))
    events = e.select("seq", "e.event_type", "e.command", "e.trace_id", "e.timestamp", number("duration_ms").alias("duration_ms"), T.lenient_bool("e.success").alias("success"), number("warning_count").alias("warning_count"), "e.document_id", "e.prompt_name")
    return events, faults


def video_metadata(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """(doc_id, video_id, title, duration, upload_date, channel) from the JSON of a downloader; rows without an id are left out.

    duration is in whole seconds, 0 if it is missing, NA or no number; texts that are missing are empty.
    """
    e = F.from_json(json_col, "struct<id:string,title:string,duration:string,upload_date:string,channel:string>")
    d = docs.withColumn("_e", e).where(F.btrim(F.coalesce("_e.id", F.lit(""))) != "")
    seconds = F.coalesce(F.col("_e.duration").try_cast("double").cast("bigint"), F.lit(0))
    return d.select("doc_id", F.btrim("_e.id").alias("video_id"), *[T.text_of(f"_e.{c}").alias(c) for c in ("title", "upload_date", "channel")], seconds.alias("duration"))


def listed_chapters(docs: DataFrame, output_col: str = "output") -> DataFrame:
    """(doc_id, has_chapters, chapters) from what a downloader prints: ``NA``, ``null``, ``None``, nothing, or what is no list of objects, is no chapters."""
    text = F.btrim(T.text_of(output_col))
    some = F.when(text.startswith("["), F.from_json(text, f"array<{CHAPTER}>"))
    chapters = F.filter(F.coalesce(some, F.array().cast(f"array<{CHAPTER}>")), lambda c: c.isNotNull())
    return docs.select("doc_id", chapters.alias("chapters")).select("doc_id", (F.size("chapters") > 0).alias("has_chapters"), "chapters")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
