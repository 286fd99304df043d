"""Queries on segments, events, plans and runs: name, function, and SQL that gives the same rows (None where SQL can't)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, planning, quality, runtime
from ..operators import segments as S
from ..operators import telemetry as E
from ..sources import records, speech, subtitles
from .tables import RUNS, TURNS, events_as_runs, table, turns

Q: dict = {}


def query(sql: str | None = None):
    return lambda f: Q.setdefault(f.__name__, (f, sql)) and f


def long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


_SUMMARY = """count(*) AS event_count, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count, count(*) FILTER (warning_count > 0) AS warning_event_count,
  CAST(coalesce(sum(warning_count), 0) AS BIGINT) AS warning_total, CAST(coalesce(sum(greatest(duration_ms, 0)), 0) AS BIGINT) AS duration_ms_total,
  CAST(floor(avg(greatest(duration_ms, 0))) AS BIGINT) AS duration_ms_avg, max(greatest(duration_ms, 0)) AS duration_ms_max, min_by(timestamp, seq) AS first_timestamp, max_by(timestamp, seq) AS last_timestamp"""


@query(f"WITH {RUNS} SELECT {_SUMMARY} FROM runs")
def telemetry_summary(spark, d):
    return E.summary(events_as_runs(spark, d))


@query(f"WITH {RUNS} SELECT command AS value, count(*) AS n FROM runs GROUP BY 1")
def telemetry_by_command(spark, d):
    return E.counts_by(events_as_runs(spark, d), "command", "unknown")


@query(f"WITH {RUNS} SELECT seq, command, duration_ms FROM runs WHERE command = 'purchase' AND success AND document_id = '7'")
def telemetry_filter(spark, d):
    return E.matching(events_as_runs(spark, d), command=" purchase ", document_id="7", success=True).select("seq", "command", "duration_ms")


@query(f"WITH {RUNS} SELECT seq, command FROM runs WHERE NOT success ORDER BY seq DESC LIMIT 25")
def telemetry_tail(spark, d):
    return E.last_events(E.matching(events_as_runs(spark, d), success=False), 25).select("seq", "command")


@query(f"WITH {RUNS} SELECT document_id, quantile_disc(duration_ms, 0.95) FILTER (duration_ms > 0) AS p95 FROM runs GROUP BY 1")
def p95_latency(spark, d):
    return E.p95(events_as_runs(spark, d), "duration_ms", "document_id")


@query(f"WITH {RUNS} SELECT command, quantile_disc(duration_ms, 0.95) FILTER (duration_ms > 0) AS p95 FROM runs GROUP BY 1")
def p95_of_hot_commands(spark, d):
    """A few commands that share all events: by narrowing ranges until 200 values are left."""
    return E.p95(events_as_runs(spark, d), "duration_ms", "command", most=200)


@query("SELECT o_orderstatus, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1")
def p95_of_prices(spark, d):
    return E.p95(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", most=200)


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders GROUP BY 1")
def status_pivot(spark, d):
    return E.status_counts(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ("F", "O"))


@query()
def autotune_trace(spark, d):
    e = events_as_runs(spark, d).select("document_id", "seq", "success", (F.col("command") == "error").alias("timeout"), (F.col("duration_ms") * 100).alias("latency_ms"))
    return E.autotune(e, "document_id", "seq", window=5, threshold_ms=80_000)


@query(f"""WITH {RUNS}, m AS (SELECT document_id AS doc_id, seq AS id, command IN ('error', 'signup') AS f FROM runs),
g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY id) AS run FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY id) - CASE WHEN first_value(f) OVER (PARTITION BY doc_id, run ORDER BY id) THEN 0 ELSE 1 END AS k FROM g)
SELECT doc_id, count(DISTINCT run) AS streaks, max(k) AS longest, min(id) FILTER (k >= 3) AS first_stop FROM n WHERE f GROUP BY 1""")
def timeout_streaks(spark, d):
    e = events_as_runs(spark, d).select(F.col("document_id").alias("doc_id"), F.col("seq").alias("id"), F.col("command").isin("error", "signup").alias("f"))
    return S.streaks(e, "f", 3).select("doc_id", *long("streaks", "longest"), "first_stop")


_TOL = "tol AS (SELECT doc_id, greatest(0.05, least(0.35, min(end_time - start_time) FILTER (end_time > start_time) * 0.2)) AS tol FROM turns GROUP BY 1)"


@query(f"""WITH {TURNS}, {_TOL}, pts AS (SELECT doc_id, id AS key, id * 4.7 AS t FROM turns),
x AS (SELECT *, lead(start_time) OVER w AS next_start, lead(id) OVER w AS next_id FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY id)),
c AS (SELECT p.doc_id, p.key, p.t, x.id, CASE WHEN next_start - t BETWEEN 0 AND tol THEN next_id ELSE x.id END AS m,
    CASE WHEN next_start - t BETWEEN 0 AND tol THEN 'near_next_start' WHEN (start_time <= t AND t < end_time) OR abs(t - start_time) <= tol / 4 THEN 'time_contains' WHEN t < start_time THEN 'next_segment' END AS s
  FROM pts p JOIN x USING (doc_id) JOIN tol USING (doc_id)),
f AS (SELECT doc_id, key, min_by(m, id) AS m, min_by(s, id) AS s FROM c WHERE s IS NOT NULL GROUP BY 1, 2),
l AS (SELECT doc_id, max(id) AS id, max_by(end_time, id) AS e FROM turns GROUP BY 1)
SELECT p.doc_id, CAST(p.key AS BIGINT) AS key, CAST(coalesce(f.m, l.id) AS BIGINT) AS matched_id, coalesce(f.s, CASE WHEN p.t - l.e BETWEEN 0 AND tol THEN 'near_last_end' ELSE 'after_last_segment' END) AS strategy
FROM pts p LEFT JOIN f USING (doc_id, key) JOIN l USING (doc_id) JOIN tol USING (doc_id)""")
def chapter_asof(spark, d):
    t = turns(spark, d)
    points = t.select("doc_id", F.col("id").alias("key"), (F.col("id") * F.lit(4.7)).alias("t"))
    return S.locate(points, t).select("doc_id", *long("key", "matched_id"), "strategy")


@query(f"WITH {TURNS} SELECT DISTINCT doc_id, CAST(id AS BIGINT) AS id FROM turns WHERE id % 4 = 0")
def chapter_breaks(spark, d):
    t = turns(spark, d)
    chapters = t.where("id % 4 = 0").select("doc_id", F.col("id").alias("chapter"), "start_time")
    return S.chapter_breaks(chapters, t).select("doc_id", *long("id"))


@query()
def chapter_plan(spark, d):
    t = turns(spark, d)
    chapters = t.where("id % 4 = 0").select("doc_id", F.col("id").alias("chapter"), F.when(F.col("id") == 0, "Untitled Chapter 1").otherwise(F.col("role")).alias("title"), F.lit("").alias("title_zh"), "start_time", (F.col("start_time") + 20).alias("end_time"))
    return S.chapter_plan(chapters, t).select("doc_id", "chapter", "title", "title_zh", "start_chunk", "end_chunk", "strategy")


@query(f"""WITH {TURNS}, w AS (SELECT doc_id, 'w' || id AS word, start_time + 1.5 AS w0, start_time + 6.0 AS w1 FROM turns)
SELECT s.doc_id, CAST(s.id AS BIGINT) AS id, string_agg(word, ' ' ORDER BY w0, w1, word) AS text FROM turns s JOIN w ON w.doc_id = s.doc_id AND w1 > start_time - 1e-6 AND w0 < end_time + 1e-6 GROUP BY 1, 2""")
def interval_overlap(spark, d):
    t = turns(spark, d)
    words = t.select("doc_id", F.concat(F.lit("w"), "id").alias("word"), F.lit(None).cast("string").alias("punctuated_word"), (F.col("start_time") + 1.5).alias("start"), (F.col("start_time") + 6.0).alias("end"))
    sentences = t.select("doc_id", "id", F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    return speech.align_words(sentences, words).select("doc_id", *long("id"), "text")


@query("""WITH a AS (SELECT DISTINCT conv_id AS doc_id, 600.0 AS duration, 4 AS parts FROM conversations), r AS (SELECT doc_id, i * 150.0 AS rough FROM a, (VALUES (1), (2), (3)) AS v(i)),
s AS (SELECT conv_id AS doc_id, turn * 37.0 + 5.5 AS middle FROM conversations),
b AS (SELECT r.doc_id, r.rough, min_by(middle, (abs(middle - rough), middle)) AS m FROM r JOIN s ON s.doc_id = r.doc_id AND abs(middle - rough) <= 60 GROUP BY 1, 2)
SELECT DISTINCT r.doc_id, round(CAST(coalesce(m, r.rough) AS DOUBLE), 3) AS point FROM r LEFT JOIN b USING (doc_id, rough)""")
def nearest_point(spark, d):
    c = table(spark, d, "conversations")
    audio = c.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.lit(600.0).alias("duration"), F.lit(4).alias("parts"))
    silences = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 37.0 + 5.0).alias("start"), (F.col("turn") * 37.0 + 6.0).alias("end"))
    return speech.split_points(audio, silences)


@query(f"""WITH {TURNS}, a AS (SELECT doc_id, id, text FROM turns WHERE id % 3 <> 1)
SELECT doc_id, CAST(id AS BIGINT) AS id, CAST(lag(id) OVER (PARTITION BY doc_id ORDER BY id) AS BIGINT) AS previous_id FROM a""")
def continuity_lag(spark, d):
    c = turns(spark, d).withColumn("status", F.when(F.col("id") % 3 == 1, "superseded").otherwise("done"))
    return S.previous_active(c).select("doc_id", *long("id", "previous_id"))


_SAID = {"processed_input_tail_context_text": "CASE WHEN id % 4 = 0 THEN ' in ' || id || ' ' END", "processed_tail_context_text": "CASE WHEN id % 4 < 2 THEN 'out ' || id ELSE ' ' END", "processed_text": "CASE WHEN id % 4 < 3 THEN '## Part ' || id || chr(10) || chr(10) || 'said ' || id END", "tail_context_text": "CASE WHEN id % 5 > 0 THEN 'raw ' || id END", "last_section_title": "CASE WHEN id % 3 = 0 THEN 'Kept ' || id END"}
_BEFORE = ", ".join(f"lag({sql}) OVER w AS {name}" for name, sql in _SAID.items())


def _continuity_sql(chain: bool) -> str:
    tail = "coalesce(nullif(trim(processed_input_tail_context_text), ''), nullif(trim(processed_tail_context_text), ''), CASE WHEN processed_text IS NOT NULL THEN '## Part ' || previous || ' said ' || previous END, tail_context_text, '')" if chain else "coalesce(tail_context_text, '')"
    return f"""WITH {TURNS}, b AS (SELECT doc_id, id, lag(id) OVER w AS previous, {_BEFORE} FROM turns WHERE id % 7 <> 3 WINDOW w AS (PARTITION BY doc_id ORDER BY id)),
    c AS (SELECT doc_id, id, previous, {tail} AS context_tail, coalesce(last_section_title, CASE WHEN processed_text IS NOT NULL THEN 'Part ' || previous END, '') AS context_section FROM b)
    SELECT doc_id, CAST(id AS BIGINT) AS id, context_tail, context_section, CAST(CASE WHEN context_tail || context_section <> '' THEN previous END AS BIGINT) AS source_chunk_id, context_tail || context_section = '' AS blank FROM c"""


def _continuity(spark, d, key: str):
    said = {name: F.expr(sql.replace("chr(10)", "char(10)")) for name, sql in _SAID.items()}
    c = turns(spark, d).withColumn("status", F.when(F.col("id") % 7 == 3, "superseded").otherwise("done")).withColumns(said)
    return S.continuity(c, key).select("doc_id", *long("id"), "context_tail", "context_section", *long("source_chunk_id"), (F.col("context_text") == "").alias("blank"))


@query(_continuity_sql(True))
def continuity_context(spark, d):
    return _continuity(spark, d, "processed_path")


@query(_continuity_sql(False))
def continuity_of_raw(spark, d):
    return _continuity(spark, d, "raw_path")


@query()
def chunk_segments(spark, d):
    t = turns(spark, d)
    breaks = t.where("id % 4 = 0").select("doc_id", "id")
    return chunking.chunk_segments(t, 200, 260, "tokens", breaks).select("doc_id", "chunk_id", "start_time", "end_time", "first_segment", "last_segment", "n_segments", "starts_chapter", F.length("content").alias("chars"))


@query()
def replan_remaining(spark, d):
    t = turns(spark, d).withColumn("status", F.when(F.col("id") % 2 == 0, "done").otherwise("failed"))
    every, _ = chunking.replan(t.select("doc_id", "id", "status", "text"), None, 60, 80)
    return every.select("doc_id", "id", "status", F.length("text").alias("chars"))


@query("""SELECT doc_id, CASE WHEN s = 'deepgram' THEN 'deepgram_source_selected' WHEN s = 'youtube' AND b = 'critical' AND m = 'chinese' THEN 'subtitle_quality_critical_deepgram_recommended'
  WHEN s = 'youtube' AND b = 'critical' THEN 'subtitle_quality_critical_manual_review_only' WHEN s = 'youtube' AND b = 'poor' THEN 'subtitle_quality_poor_review_subtitle_path'
  WHEN s = 'youtube' AND b <> '' THEN 'subtitle_quality_acceptable' WHEN s = 'youtube' THEN 'subtitle_quality_pending' WHEN s <> '' THEN s || '_source_selected' ELSE 'source_route_unknown' END AS reason,
  s = 'youtube' AND b = 'critical' AND m = 'chinese' AS again
FROM (SELECT doc_id, ['youtube', 'deepgram', 'upload', ''][doc_id % 4 + 1] AS s, ['critical', 'poor', 'good', ''][doc_id // 4 % 4 + 1] AS b, CASE WHEN lang = 'de' THEN 'chinese' ELSE '' END AS m FROM documents)""")
def source_routing(spark, d):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    t = table(spark, d, "documents").select("doc_id", pick(("youtube", "deepgram", "upload", ""), F.col("doc_id") % 4).alias("source"), pick(("critical", "poor", "good", ""), F.expr("doc_id div 4 % 4")).alias("subtitle_quality_band"), F.when(F.col("lang") == "de", "chinese").otherwise("").alias("mode"), F.array().cast("array<string>").alias("subtitle_quality_reasons"))
    return planning.route(t).select("doc_id", F.col("source_route_reason").alias("reason"), F.col("reroute_recommended").alias("again"))


@query("SELECT event_id, json_valid(props) AS valid, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.get_json_object("props", "$.k").alias("k"))


@query("SELECT page_id, ['running', 'success', 'limit'][page_id % 3 + 1] AS x, CASE WHEN page_id % 4 IN (0, 1) THEN 'rate_limited' WHEN page_id % 4 = 2 THEN 'bot_verification' ELSE 'download_failed' END AS kind FROM pages")
def download_failures(spark, d):
    p = table(spark, d, "pages")
    log = F.element_at(F.array(*map(F.lit, ("HTTP Error 429", "Too Many Requests", "confirm you're not a bot", "no route"))), (F.col("page_id") % 4 + 1).cast("int"))
    x = F.element_at(F.array(*map(F.lit, ("running", "success", "limit"))), (F.col("page_id") % 3 + 1).cast("int"))
    return p.select("page_id", x.alias("x"), subtitles.classify_download_failure(log).alias("kind"))


@query()
def manifest_entries(spark, d):
    chunks = chunking.chunk_text(table(spark, d, "documents").select("doc_id", "text"))
    return chunking.manifest(chunks, "plan-1").select("doc_id", "id", "raw_path", "char_count", "estimated_input_tokens", F.length("tail_context_text").alias("tail_chars"))


@query()
def output_health(spark, d):
    c = turns(spark, d).withColumn("result", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.expr("left(text, 10)")).otherwise(F.col("text")))
    return quality.output_health(c, "cleanup_zh").select("doc_id", "id", F.round("ratio", 3).alias("ratio"), F.array_join("retry_reasons", ",").alias("reasons"))
