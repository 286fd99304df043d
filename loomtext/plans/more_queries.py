"""Queries on the smaller operators: name, function, and SQL that gives the same rows (None where SQL can't)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors as A
from ..operators import chunking, glossary, planning, runtime
from ..operators import segments as S
from ..operators import telemetry as E
from ..sources import speech, subtitles
from .tables import TURNS, events_as_runs, table, turns

Q: dict = {}


def query(sql: str | None = None):
    return lambda f: Q.setdefault(f.__name__, (f, sql)) and f


def pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))


@query("SELECT user_id AS doc_id, count(*) AS loops, CAST(sum(event_id % 3) AS BIGINT) AS processed, CAST(sum(event_id % 2) AS BIGINT) AS failed, CAST(sum(event_id % 5) AS BIGINT) AS skipped FROM events GROUP BY 1")
def run_totals(spark, d):
    e = table(spark, d, "events")
    return E.run_totals(e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).alias("processed"), (F.col("event_id") % 2).alias("failed"), (F.col("event_id") % 5).alias("skipped")))


@query("SELECT event_id AS doc_id, greatest(event_id % 4 - 1, 0) AS processed_count, CAST(0 AS BIGINT) AS failed_count, event_id % 2 AS warning_count FROM events")
def budget_ledger(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), (F.col("event_id") % 4 - 1).alias("processed_count"), (F.col("event_id") % 2).cast("string").alias("warning_count"))
    return E.ledger(e).select("doc_id", "processed_count", "failed_count", "warning_count")


_TRIES = "t AS (SELECT conv_id AS doc_id, turn AS rank, ['zh', 'en', 'fr'][turn % 3 + 1] AS language, CASE WHEN turn % 2 = 0 THEN 'manual' ELSE 'auto' END AS mode, (turn + conv_id) % 4 = 0 AS success FROM conversations)"


@query(f"WITH {_TRIES} SELECT doc_id, min_by(language, rank) AS language, min_by(mode, rank) AS mode FROM t WHERE success GROUP BY 1")
def first_success(spark, d):
    c = table(spark, d, "conversations")
    t = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("rank"), pick(("zh", "en", "fr"), F.col("turn") % 3).alias("language"), F.when(F.col("turn") % 2 == 0, "manual").otherwise("auto").alias("mode"), ((F.col("turn") + F.col("conv_id")) % 4 == 0).alias("success"))
    return subtitles.first_success(t)


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'zh1' WHEN page_id % 2 = 0 THEN '140' ELSE '250' END AS format_id FROM pages")
def audio_pick(spark, d):
    f = lambda i, v, a, lang: F.struct(i.alias("format_id"), F.lit(v).alias("vcodec"), F.lit(a).alias("acodec"), lang.alias("language"))
    none = F.lit(None).cast("string")
    formats = F.array(f(F.lit("18"), "avc", "mp4a", none), f(F.lit("250"), "none", "opus", none), f(F.when(F.col("page_id") % 2 == 0, "140").otherwise("251"), "none", "mp4a", F.lit("en")), f(F.lit("zh1"), "none", "opus", F.when(F.col("page_id") % 3 == 0, "zh-CN")))
    return table(spark, d, "pages").select("page_id", subtitles.pick_audio(formats).alias("format_id"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 2 = 1 THEN 'index_mismatch' WHEN event_id % 3 > 0 THEN 'sha256_mismatch' ELSE 'valid' END AS state FROM events")
def cache_states(spark, d):
    e = table(spark, d, "events")
    made = lambda i, s: F.struct(i.alias("index"), F.lit(2).alias("count"), F.lit(5).alias("size"), s.alias("sha256"), F.lit("r").alias("request"))
    cached = F.when(F.col("event_id") % 7 != 0, made(F.col("event_id") % 2, (F.col("event_id") % 3 > 0).cast("string")))
    return e.select("event_id", speech.cache_state(cached, made(F.lit(0).cast("long"), F.lit("false"))).alias("state"))


@query("""WITH p AS (SELECT conv_id AS doc_id, turn AS chunk, turn % 3 + 1 AS speakers, CASE WHEN conv_id % 2 = 0 THEN 'words' WHEN turn % 2 = 0 THEN 'utterances' ELSE 'words' END AS source FROM conversations)
SELECT doc_id, CAST(sum(chunk) AS BIGINT) AS word_count, max(speakers) AS speaker_count, CASE WHEN count(DISTINCT source) > 1 THEN 'mixed' ELSE min(source) END AS source FROM p GROUP BY 1""")
def speech_rollup(spark, d):
    c = table(spark, d, "conversations")
    source = F.when(F.col("conv_id") % 2 == 0, "words").when(F.col("turn") % 2 == 0, "utterances").otherwise("words")
    p = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), F.col("turn").alias("word_count"), (F.col("turn") % 3 + 1).alias("speaker_count"), source.alias("source"), F.array(F.lit("w")).alias("warnings"))
    return speech.combine_chunks(p).select("doc_id", "word_count", "speaker_count", "source")


@query(f"WITH {TURNS} SELECT doc_id, round(greatest(0.05::DOUBLE, least(0.35::DOUBLE, min(end_time - start_time) FILTER (end_time > start_time) * 0.2::DOUBLE)), 6) AS tolerance FROM turns GROUP BY 1")
def boundary_tolerance(spark, d):
    return S.boundary_tolerance(turns(spark, d)).select("doc_id", F.round("tolerance", 6).alias("tolerance"))


@query("SELECT conv_id AS doc_id, turn AS chunk, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3, turn) - 1 AS id FROM conversations")
def running_ids(spark, d):
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn"), (F.col("turn") % 3).alias("chunk"), F.col("turn").alias("pos"))
    return S.continue_ids(p).select("doc_id", F.col("turn").alias("chunk"), F.col("id").cast("long").alias("id"))


@query("SELECT conv_id AS doc_id, turn AS chapter, CASE WHEN turn % 2 = 0 THEN turn + 100 ELSE turn END AS start_chunk, turn AS original_start_chunk FROM conversations")
def remap_chapters(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chapter"), F.col("turn").alias("start_chunk"))
    moved = c.where("start_chunk % 2 = 0").select("doc_id", F.col("start_chunk").alias("old_id"), (F.col("start_chunk") + 100).alias("new_id"))
    return S.remap_chapters(c, moved).select("doc_id", "chapter", "start_chunk", "original_start_chunk")


@query("SELECT page_id, 'id ' || strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER), '%Y%m%d') || ' x20240101 20241399' AS s, strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER), '%Y%m%d') AS dates FROM pages")
def compact_dates(spark, d):
    day = F.date_format(F.expr("date_add(date'2024-01-01', cast(page_id % 300 as int))"), "yyyyMMdd")
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("id "), day, F.lit(" x20240101 20241399")).alias("s"))
    return p.select("page_id", "s", F.array_join(T.compact_dates("s"), ",").alias("dates"))


@query("SELECT conv_id AS doc_id, count(*) AS n, count(*) FILTER (trim(role) = 'user') AS users FROM conversations GROUP BY 1")
def role_counts(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "role")
    return E.status_counts(c, "doc_id", "role", ("user",)).select("doc_id", F.col("total").alias("n"), F.col("user").alias("users"))


@query()
def prompt_contexts(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    known = spark.createDataFrame([("the", 3, 1), ("and", 2, 1), ("leeux", 1, 1)], "term string, score int, count int")
    terms = glossary.prompt_context(glossary.select_terms(texts, known, 8, None))
    marks = texts.select("key", A.prompt_context(A.extract("text")).alias("anchors"))
    return marks.join(terms, "key", "left")


@query()
def small_chunks(spark, d):
    t = turns(spark, d).select("doc_id", F.col("id").alias("chunk_id"), T.estimate_tokens("text").alias("size_"), F.lit(1).alias("segments"), (F.col("id") % 4 == 0).alias("fresh"))
    return chunking.coalesce_small(t, 300, 400)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'text' WHEN doc_id % 3 = 1 THEN 'segments' ELSE 'text' END AS preferred_chunk_source, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS segment_count FROM documents")
def normalized_documents(spark, d):
    seg = lambda *t: F.array(*[F.struct(F.lit(x).alias("text"), F.lit(0.0).alias("start_time"), F.lit(1.0).alias("end_time")) for x in t])
    some = F.when(F.col("doc_id") % 3 == 0, F.filter(seg("x"), lambda s: F.lit(False))).otherwise(seg("a", " ", "b"))
    source = F.when(F.col("doc_id") % 3 == 2, "youtube").otherwise("upload")
    n = planning.normalize(table(spark, d, "documents").select("doc_id", source.alias("source"), F.lit("chinese").alias("mode"), F.col("text").alias("raw"), some.alias("segments")))
    return n.select("doc_id", "preferred_chunk_source", "segment_count")


@query("SELECT document_id, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS document_id FROM events WHERE event_type <> 'error') GROUP BY 1")
def telemetry_by_document(spark, d):
    return E.counts_by(E.matching(events_as_runs(spark, d), success=True), "document_id").select(F.col("value").alias("document_id"), "n")
