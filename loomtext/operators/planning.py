"""Normalised documents, source routing and the plan of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import subtitles
from . import chunking, quality

# Required fields by stage, and the limit of a short duration.
_METADATA = ("vid", "url", "title", "channel", "upload_date", "duration", "output_dir")
_SOURCE = ("mode", "src", "source_language", "subtitle_source")
REQUIRED = {"metadata": _METADATA, "post-source": _METADATA + _SOURCE, "pre-assemble": _METADATA + _SOURCE, "final": _METADATA + _SOURCE + ("output_file",)}
LONG_SECONDS = 1800
ASR_HINT = (
    "Source is Deepgram ASR. Also repair obvious ASR artifacts such as broken Chinese spacing, missing punctuation, and repeated fragments when confidence is high."
)
#: What was recognised from speech goes by this name.
SPEECH = "deepgram"


def is_subtitle(source: Column) -> Column:
    return F.lower(F.btrim(source)) == "youtube"


def normalize(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mode, text, char_count, line_count, segment_count, has_timing, preferred_chunk_source) from (doc_id, source, mode, raw, segments)."""
    parts = F.filter(F.coalesce("segments", F.array().cast(docs.schema["segments"].dataType)), lambda s: T.strip(T.text_of(s["text"])) != "")
    joined = F.array_join(F.transform(parts, lambda s: s["text"]), "\n")
    given = F.when(F.size(parts) > 0, joined).otherwise(T.text_of("raw"))
    text = F.when(is_subtitle(F.col("source")), T.normalize_subtitle(given)).otherwise(T.normalize_body(given))
    timed = F.exists(parts, lambda s: s["start_time"].isNotNull() & s["end_time"].isNotNull())
    d = docs.withColumn("_p", parts).withColumn("_text", text)
    prefer = F.when(F.size("_p") == 0, "text").when(is_subtitle(F.col("source")) & (F.lower("mode") == "chinese"), "text").otherwise("segments")
    lines = F.when(F.col("_text") == "", 0).otherwise(F.size(F.split("_text", "\n")))
    return d.select("doc_id", "source", "mode", F.col("_text").alias("text"), F.length("_text").alias("char_count"), lines.alias("line_count"), F.size("_p").alias("segment_count"), timed.alias("has_timing"), prefer.alias("preferred_chunk_source"))


def normalize_subtitles(files: DataFrame, mode: str = "chinese") -> DataFrame:
    """(doc_id, segments, text, diagnostics, and the score, band and reasons of quality.subtitle_quality) from subtitle files (doc_id, text)."""
    folded = subtitles.fold_cues(subtitles.cues(files))
    text = subtitles.vtt_text(subtitles.vtt_segments(files)).withColumnRenamed("text", "_text")
    d = folded.join(text, "doc_id", "left").withColumn("text", T.text_of("_text")).drop("_text")
    names = [f.name for f in folded.schema["diagnostics"].dataType.fields]
    wide = d.select("doc_id", "segments", "text", "diagnostics", *[F.col(f"diagnostics.{n}").alias(n) for n in names])
    return quality.subtitle_quality(wide, mode).drop(*names)


def route(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, mode, subtitle_quality_band, subtitle_quality_reasons) with the reason of their route and whether to take another."""
    source, mode, b = F.lower(F.btrim(T.text_of("source"))), F.lower(F.btrim(T.text_of("mode"))), T.text_of("subtitle_quality_band")
    critical = is_subtitle(F.col("source")) & (b == "critical")
    reason = (
        F.when(source == SPEECH, "deepgram_source_selected")
        .when(critical & (mode == "chinese"), "subtitle_quality_critical_deepgram_recommended")
        .when(critical, "subtitle_quality_critical_manual_review_only")
        .when((source == "youtube") & (b == "poor"), "subtitle_quality_poor_review_subtitle_path")
        .when((source == "youtube") & (b != ""), "subtitle_quality_acceptable")
        .when(source == "youtube", "subtitle_quality_pending")
        .when(source != "", F.concat(source, F.lit("_source_selected")))
        .otherwise("source_route_unknown")
    )
    again = (source != SPEECH) & critical & (mode == "chinese")
    return docs.withColumn("source_route_reason", reason).withColumn("reroute_recommended", again).withColumn("reroute_target", F.when(again, SPEECH).otherwise("")).withColumn("reroute_reasons", F.when(again, F.col("subtitle_quality_reasons")).otherwise(F.array().cast("array<string>")))


def single_pass_limit(mode: Column, source: Column) -> Column:
    """Tokens of the largest text that is sent in one request: what structure_only, or for two languages also translate_only, may take and give."""
    one, two = (chunking.REQUEST_CAP[t] + chunking.MOST_OUTPUT[t] for t in ("structure_only", "translate_only"))
    limit = F.when(F.btrim(T.text_of(mode)) == "bilingual", F.lit(min(one, two))).otherwise(F.lit(one))
    limit = F.when(F.btrim(T.text_of(source)) == SPEECH, F.least(limit, F.lit(one - 300))).otherwise(limit)
    return F.greatest(limit, F.lit(3200))


def _operation(kind: str, prompt: Column | str, reads: Column, writes: Column, hint: Column, input_key: str = "", bilingual: bool = False) -> Column:
    """An operation of a plan with the contracts it runs under."""
    chunked, again = kind == "chunk", input_key == "raw_path"
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    when_due = ("auto_replan_remaining" if again else "stop_and_review") if chunked else "not_applicable"
    flags = F.array(F.lit("--auto-replan")) if chunked and again else F.array().cast("array<string>")
    execution = F.struct(F.lit("chunked" if chunked else "single_pass").alias("mode"), F.lit(chunked and again).alias("supports_auto_replan"), flags.alias("recommended_cli_flags"), F.lit(when_due).alias("on_replan_required"))
    control = F.struct(F.lit("chunk" if chunked else "single_pass").alias("kind"), prompt.alias("prompt_name"), F.lit(input_key).alias("input_key"), F.lit("bounded_retry" if chunked else "not_applicable").alias("repair_mode"), F.lit("document_abort_and_replan" if chunked else "not_applicable").alias("replan_mode"), F.lit(bilingual).alias("bilingual_gate"))
    return F.struct(F.lit(kind).alias("kind"), prompt.alias("prompt"), reads.alias("input"), writes.alias("output"), F.lit(input_key).alias("input_key"), hint.alias("extra_instruction"), execution.alias("execution"), control.alias("control"))


def plan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, mode, duration, text or tokens) with the plan of their optimisation.

    estimated_tokens, token_limit, duration_bucket, video_path, routing_reason, requires_llm_preflight and operations, an array of
    struct(kind, prompt, input, output, input_key, extra_instruction, execution, control). A document is long by its duration or
    by its tokens. Short ones take one request, or two for two languages; long ones are processed in chunks.
    Inputs and outputs are named by their role: raw_text, structured_text, optimized_text.
    """
    tokens = F.col("tokens") if "tokens" in docs.columns else T.estimate_tokens(T.normalize_body("text"))
    mode, source = F.btrim(T.text_of("mode")), F.btrim(T.text_of("source"))
    seconds = F.coalesce(F.col("duration").try_cast("bigint"), F.lit(0))
    d = docs.withColumn("estimated_tokens", tokens.cast("bigint")).withColumn("token_limit", single_pass_limit(mode, source)).withColumn("duration_bucket", F.when(seconds >= LONG_SECONDS, "long").otherwise("short"))
    oversized = F.col("estimated_tokens") > F.col("token_limit")
    d = d.withColumn("routing_reason", F.when(F.col("duration_bucket") == "long", "duration_threshold").when(oversized, "oversized_short_input").otherwise("duration_short_single_pass"))
    d = d.withColumn("video_path", F.when(F.col("routing_reason") == "duration_short_single_pass", "short").otherwise("long")).withColumn("requires_llm_preflight", F.col("video_path") == "long")
    none, hint = F.lit(""), F.when(source == SPEECH, ASR_HINT).otherwise("")
    raw, made, best = F.lit("raw_text"), F.lit("structured_text"), F.lit("optimized_text")
    two = F.array(_operation("prompt", "structure_only", raw, made, none), _operation("prompt", "translate_only", made, best, none, bilingual=True))
    one = F.array(_operation("prompt", "cleanup_zh", raw, best, hint))
    chinese = mode == "chinese"
    chunked = F.array(_operation("chunk", F.when(chinese, "cleanup_zh").otherwise("structure_only"), none, none, F.when(chinese, hint).otherwise(""), "raw_path"))
    translated = F.array(_operation("chunk", "translate_only", none, none, none, "processed_path", True))
    long = F.when(mode == "bilingual", F.concat(chunked, translated)).otherwise(chunked)
    return d.withColumn("operations", F.when(F.col("video_path") == "long", long).when(mode == "bilingual", two).otherwise(one))


def validate(states: DataFrame, stage: str = "", fields: str = "fields", require: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, present, missing, unknown, file_dates, passed): a stage's required fields, and those of require, in a map of fields.

    ``unknown`` is a placeholder. In the final stage a date in the file's name must be written with dashes: file_dates are
    those that aren't.
    """
    wanted = list(dict.fromkeys([*(REQUIRED[stage] if stage else ()), *require]))
    names = F.array(*map(F.lit, wanted)).cast("array<string>")
    value = lambda k: F.coalesce(F.try_element_at(F.col(fields), k), F.lit(""))
    gone, vague = F.filter(names, lambda k: value(k) == ""), F.filter(names, lambda k: F.lower(value(k)) == "unknown")
    dates = T.compact_dates(value(F.lit("output_file"))) if stage == "final" else F.array().cast("array<string>")
    out = states.withColumn("missing", gone).withColumn("unknown", vague).withColumn("file_dates", dates)
    faults = F.size("missing") + F.size("unknown") + F.size("file_dates")
    return out.select("doc_id", F.array_except(F.array_except(names, F.col("missing")), F.col("unknown")).alias("present"), "missing", "unknown", "file_dates", (faults == 0).alias("passed"))


def state_hash(fields: Column) -> Column:
    """sha256 of a map's ``key: value`` lines in the order of the keys."""
    lines = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit(": "), T.text_of(e["value"])))
    return F.sha2(F.array_join(lines, "\n"), 256)
