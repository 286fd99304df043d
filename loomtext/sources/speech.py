"""Speech recognition results: nested JSON to transcripts and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The part of a result that is read, as DDL.
_ALTERNATIVE = (
    "struct<transcript:string,words:array<struct<word:string,punctuated_word:string,start:double,end:double,speaker:int>>,"
    "paragraphs:struct<paragraphs:array<struct<speaker:int,sentences:array<struct<text:string,start:double,end:double,speaker:int>>>>>,"
    "utterances:array<struct<transcript:string,start:double,end:double,speaker:int>>>"
)
_UTTERANCES = "array<struct<transcript:string,start:double,end:double,speaker:int>>"
_RESULTS = f"struct<channels:array<struct<alternatives:array<{_ALTERNATIVE}>>>,utterances:{_UTTERANCES}>"
SCHEMA = f"results {_RESULTS}, payload struct<results:{_RESULTS}>"
_EPSILON = 1e-6


def parse(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """(doc_id, alternative, utterances, error) from (doc_id, json): a bare result, or one inside a cache's payload."""
    parsed = docs.withColumn("_p", F.from_json(json_col, SCHEMA))
    results = F.coalesce(F.col("_p.payload.results"), F.col("_p.results"))
    parsed = parsed.withColumn("_r", results)
    alternative = F.get(F.get(F.col("_r.channels"), F.lit(0))["alternatives"], F.lit(0))
    parsed = parsed.withColumn("alternative", alternative)
    utterances = F.coalesce(F.col("alternative.utterances"), F.col("_r.utterances"))
    return parsed.select("doc_id", "alternative", utterances.alias("utterances"), F.when(F.col("alternative").isNull(), "missing results").alias("error"))


def _sentences() -> Column:
    """All sentences in order, with paragraph and sentence number and the paragraph's speaker where they have none."""
    return F.flatten(
        F.transform(
            F.coalesce(F.col("alternative.paragraphs.paragraphs"), F.array().cast("array<struct<speaker:int,sentences:array<struct<text:string,start:double,end:double,speaker:int>>>>")),
            lambda p, i: F.transform(
                F.coalesce(p["sentences"], F.array().cast("array<struct<text:string,start:double,end:double,speaker:int>>")),
                lambda s, j: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["speaker"], p["speaker"]).alias("speaker"), i.alias("para"), j.alias("sent")),
            ),
        )
    )


def join_words(words: Column) -> Column:
    """Words as one text: the punctuated form where there is one."""
    form = F.transform(words, lambda w: F.btrim(F.coalesce(F.nullif(w["punctuated_word"], F.lit("")), w["word"], F.lit(""))))
    return F.array_join(F.filter(form, lambda w: w != ""), " ")


def inspect(parsed: DataFrame) -> DataFrame:
    """Counts of what a result holds, and its number of speakers, at least 1."""
    s = _sentences()
    words = F.coalesce(F.col("alternative.words"), F.array().cast("array<struct<word:string,punctuated_word:string,start:double,end:double,speaker:int>>"))
    speakers = F.array_distinct(F.filter(F.concat(F.transform(s, lambda x: x["speaker"]), F.transform(words, lambda w: w["speaker"])), lambda x: x.isNotNull()))
    return parsed.select(
        "doc_id",
        F.coalesce(F.size("alternative.paragraphs.paragraphs"), F.lit(0)).alias("paragraph_count"),
        F.size(s).alias("sentence_count"),
        F.size(F.filter(s, lambda x: T.strip(T.text_of(x["text"])) != "")).alias("sentence_with_text_count"),
        F.size(F.filter(s, lambda x: x["start"].isNotNull() & x["end"].isNotNull())).alias("timed_sentence_count"),
        F.size(words).alias("word_count"),
        F.coalesce(F.size("utterances"), F.lit(0)).alias("utterance_count"),
        F.greatest(F.size(speakers), F.lit(1)).alias("speaker_count"),
    )


def transcripts(parsed: DataFrame, structured: bool = True) -> DataFrame:
    """(doc_id, transcript, source): the first of utterances, sentences, words and the flat transcript that has text.

    structured False: the flat transcript first.
    """
    lines = lambda a, f: F.array_join(F.filter(F.transform(a, lambda x: T.normalize_speech(x[f])), lambda x: x != ""), "\n")
    ways = [
        ("utterances", F.coalesce(lines(F.col("utterances"), "transcript"), F.lit(""))),
        ("sentences", F.coalesce(lines(_sentences(), "text"), F.lit(""))),
        ("words", T.normalize_speech(F.coalesce(join_words(F.col("alternative.words")), F.lit("")))),
        ("transcript", T.normalize_speech(F.col("alternative.transcript"))),
    ]
    ways = ways if structured else [ways[-1], *ways[:-1]]
    out = parsed.select("doc_id", *[v.alias(k) for k, v in ways])
    tag = F.lit("none")
    for k, _ in reversed(ways):
        tag = F.when(F.col(k) != "", k).otherwise(tag)
    return out.select("doc_id", F.coalesce(*[F.nullif(F.col(k), F.lit("")) for k, _ in ways], F.lit("")).alias("transcript"), tag.alias("source"))


def segments(parsed: DataFrame, time_offset: float = 0.0, first_id: int = 0) -> DataFrame:
    """(doc_id, id, text, start_time, end_time, speaker, para, sent): a row for each utterance, else for each sentence with text."""
    said = F.transform("utterances", lambda u: F.struct(u["transcript"].alias("text"), u["start"].alias("start"), u["end"].alias("end"), u["speaker"].alias("speaker"), F.lit(None).cast("int").alias("para"), F.lit(None).cast("int").alias("sent")))
    parts = F.when(F.size("utterances") > 0, said).otherwise(_sentences())
    rows = parsed.select("doc_id", F.posexplode(parts).alias("k", "s")).withColumn("text", T.normalize_speech("s.text")).where("text <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1 + first_id
    shifted = lambda c: F.round(F.col(c) + time_offset, 3)
    return rows.select("doc_id", number.alias("id"), "text", shifted("s.start").alias("start_time"), shifted("s.end").alias("end_time"), F.col("s.speaker").alias("speaker"), "s.para", "s.sent")


def align_words(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, id, text): words (doc_id, word, punctuated_word, start, end) that overlap each sentence (doc_id, id, start, end), in order.

    An interval join within documents. Both sides are dealt into cells of the time line, so a long document
    is not compared all with all; a pair counts in the cell where it first meets.
    """
    cell = 30.0
    cells = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    s = sentences.select("doc_id", "id", F.col("start").alias("s0"), F.col("end").alias("s1")).withColumn("cell", F.explode(cells(F.col("s0") - _EPSILON, F.col("s1") + _EPSILON)))
    w = words.select("doc_id", "word", "punctuated_word", F.col("start").alias("w0"), F.col("end").alias("w1")).withColumn("cell", F.explode(cells(F.col("w0"), F.col("w1"))))
    met = s.join(w, ["doc_id", "cell"]).where((F.col("w1") > F.col("s0") - _EPSILON) & (F.col("w0") < F.col("s1") + _EPSILON))
    met = met.where(F.col("cell") == F.floor(F.greatest(F.col("s0") - _EPSILON, F.col("w0")) / cell))
    listed = met.groupBy("doc_id", "id").agg(F.array_sort(F.collect_list(F.struct("w0", "w1", "word", "punctuated_word"))).alias("words"))
    return listed.select("doc_id", "id", join_words(F.col("words")).alias("text"))


def combine_chunks(parts: DataFrame) -> DataFrame:
    """One row for each doc_id from the reports of its audio chunks (doc_id, chunk, counts..., speaker_count, source, warnings)."""
    counts = [c for c in parts.columns if c.endswith("_count") and c != "speaker_count"]
    sources = F.sort_array(F.collect_set(F.nullif(F.btrim("source"), F.lit(""))))
    warned = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "warnings"))), lambda x: x["warnings"])))
    out = parts.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in counts], F.max("speaker_count").alias("speaker_count"), sources.alias("_s"), warned.alias("warnings"))
    return out.withColumn("source", F.when(F.size("_s") > 1, "mixed").otherwise(F.coalesce(F.get("_s", F.lit(0)), F.lit("")))).drop("_s")


def cache_state(cached: Column, wanted: Column) -> Column:
    """Why a cached chunk can't be used: the first field of struct(index, count, size, sha256, request) that differs, or ``valid``."""
    out = F.lit("valid")
    for f in ("request", "sha256", "size", "count", "index"):
        out = F.when(~cached[f].eqNullSafe(wanted[f]), f"{f}_mismatch").otherwise(out)
    return F.when(cached.isNull(), "missing").otherwise(out)


def split_points(audio: DataFrame, silences: DataFrame, most_deviation: float = 60.0) -> DataFrame:
    """(doc_id, point): where to cut audio (doc_id, duration, parts), near each i/parts of its duration.

    The nearest middle of a silence (doc_id, start, end), the earlier of two as near, if it isn't farther than
    most_deviation; else the place itself.
    """
    rough = audio.where("parts > 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("i"), "duration", "parts").withColumn("rough", F.col("i") * F.col("duration") / F.col("parts"))
    cell = F.lit(2 * most_deviation)
    wide = rough.withColumn("cell", F.explode(F.sequence(F.floor((F.col("rough") - most_deviation) / cell), F.floor((F.col("rough") + most_deviation) / cell))))
    middle = silences.select("doc_id", ((F.col("start") + F.col("end")) / 2).alias("middle")).withColumn("cell", F.floor(F.col("middle") / cell))
    met = wide.join(middle, ["doc_id", "cell"]).where(F.abs(F.col("middle") - F.col("rough")) <= most_deviation)
    best = met.groupBy("doc_id", "i").agg(F.min_by("middle", F.struct(F.abs(F.col("middle") - F.col("rough")), F.col("middle"))).alias("middle"))
    return rough.join(best, ["doc_id", "i"], "left").select("doc_id", F.round(F.coalesce("middle", "rough"), 3).alias("point")).distinct()
