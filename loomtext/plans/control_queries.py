"""Queries on the control of runs. Their inputs are dealt from ids so that every branch is met; the SQL states the rules anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import artifacts, merge, planning, runtime
from ..operators import telemetry as E
from ..sources import records
from .tables import TURNS, table, turns

Q: dict = {}


def query(sql: str | None = None):
    return lambda f: Q.setdefault(f.__name__, (f, sql)) and f


def pick(names, k: str):
    """The k-th of names, k an SQL expression."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.expr(f"cast(({k}) % {len(names)} + 1 as int)"))


def picked(names, k: str) -> str:
    """The same in DuckDB."""
    literal = ["NULL" if n is None else f"'{n}'" if isinstance(n, str) else str(n) for n in names]
    return f"[{', '.join(literal)}][({k}) % {len(names)} + 1]"


_CODES = (400, 401, 408, 409, 413, 422, 425, 429, 500, 504, None, None)
_MESSAGES = ("", "maximum CONTEXT length", "the prompt", "request timed out", "Connection reset by peer", "no such host")
_CAUSES = ("", "malformed", "timeout", "unreachable")


@query(f"""WITH e AS (SELECT event_id, {picked(_CODES, "event_id")} AS s, lower({picked(_MESSAGES, "event_id // 12")}) AS m, {picked(_CAUSES, "event_id // 72")} AS c FROM events),
k AS (SELECT *, CASE WHEN c = 'malformed' THEN 'bad_response' WHEN c = 'timeout' OR m LIKE '%timed out%' THEN 'timeout' WHEN m LIKE '%connection reset%' THEN 'remote_disconnect' WHEN c = 'unreachable' THEN 'network' ELSE 'unknown' END AS silent FROM e)
SELECT event_id, CASE WHEN s IS NULL THEN silent ELSE 'http_' || s END AS kind,
  CASE WHEN s IS NULL THEN silent IN ('timeout', 'remote_disconnect') ELSE s IN (408, 409, 425, 429) OR s >= 500 END AS again,
  CASE WHEN s IS NULL THEN silent IN ('timeout', 'bad_response') ELSE s IN (408, 504, 413, 422) OR (s = 400 AND (m LIKE '%context%' OR m LIKE '%prompt%')) END AS replan FROM k""")
def error_classes(spark, d):
    e = table(spark, d, "events").select("event_id", runtime.classify_error(pick(_CODES, "event_id"), pick(_MESSAGES, "event_id div 12"), pick(_CAUSES, "event_id div 72")).alias("e"))
    return e.select("event_id", F.col("e.error_type").alias("kind"), F.col("e.retryable").alias("again"), "e.replan")


_CHUNK = ("pending", "running", "done", "interrupted", "failed", "superseded", None)


@query(f"""WITH {TURNS}, c AS (SELECT doc_id, id, coalesce({picked(_CHUNK, "id + doc_id")}, 'pending') AS s, id % 3 AS kind FROM turns)
SELECT doc_id, CAST(id AS BIGINT) AS id, s AS previous_status,
  CASE WHEN s IN ('running', 'interrupted') AND kind = 1 THEN 'promoted' WHEN s = 'running' THEN 'interrupted' WHEN s = 'done' AND kind = 0 THEN 'missing_output' ELSE '' END AS repair,
  CASE WHEN s IN ('running', 'interrupted') AND kind = 1 THEN 'done' WHEN s = 'running' OR (s = 'done' AND kind = 0) THEN 'interrupted' ELSE s END AS status FROM c""")
def resume_repair(spark, d):
    """A third of the chunks has no result, a third one of this operation, a third one of another."""
    t = turns(spark, d)
    outputs = t.where("id % 3 > 0").select("doc_id", "id", F.when(F.col("id") % 3 == 1, "cleanup_zh").otherwise("translate_only").alias("prompt_name"), F.lit("raw_path").alias("input_key"), F.lit(10).alias("size"))
    chunks = t.select("doc_id", "id", pick(_CHUNK, "id + doc_id").alias("status"))
    return runtime.repair_for_resume(chunks, outputs, "cleanup_zh").select("doc_id", F.col("id").cast("long").alias("id"), "previous_status", "repair", "status")


_MANY = ("done", "done", "failed", "pending", "superseded", "interrupted")
_RUN = ("pending", "running", "paused", "resumable", "aborted", "completed", "completed_with_errors", "")


@query(f"""WITH c AS (SELECT conv_id AS doc_id, {picked(_MANY, "turn % (conv_id % 6 + 1)")} AS s FROM conversations),
a AS (SELECT doc_id, bool_or(s = 'done') AS done, bool_or(s = 'failed') AS failed, bool_or(s = 'pending') AS pending, bool_or(s = 'interrupted') AS broken, bool_or(s <> 'superseded') AS any_active FROM c GROUP BY 1),
r AS (SELECT *, CASE WHEN {picked(_RUN, "doc_id // 6")} = '' THEN 'pending' ELSE {picked(_RUN, "doc_id // 6")} END AS was FROM a)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'aborted' WHEN done AND NOT failed AND NOT pending AND NOT broken THEN 'completed' WHEN broken THEN 'resumable' WHEN failed AND NOT pending THEN 'completed_with_errors'
  WHEN was IN ('running', 'paused') THEN 'resumable' WHEN pending THEN CASE WHEN was = 'pending' THEN 'pending' ELSE 'resumable' END ELSE was END AS runtime_status FROM r""")
def runtime_status(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), pick(_MANY, "turn % (conv_id % 6 + 1)").alias("status"))
    runs = c.select("doc_id").distinct().select("doc_id", pick(_RUN, "doc_id div 6").alias("status"), (F.col("doc_id") % 11 == 0).alias("replan_required"))
    return runtime.runtime_status(c, runs)


@query(f"""SELECT event_id, CASE WHEN s = 'running' AND event_id // 8 % 2 = 1 THEN 'pause_requested' WHEN s = 'running' AND event_id // 16 % 2 = 1 THEN 'cancellation_requested' ELSE s END AS status
FROM (SELECT event_id, CASE WHEN {picked(_RUN, "event_id")} = '' THEN 'pending' ELSE {picked(_RUN, "event_id")} END AS s FROM events)""")
def effective_statuses(spark, d):
    asked = lambda k: F.expr(f"event_id div {k} % 2 = 1")
    return table(spark, d, "events").select("event_id", runtime.effective_status(pick(_RUN, "event_id"), asked(8), asked(16)).alias("status"))


_EFFECTIVE = ("running", "paused", "pause_requested", "completed")


@query(f"""SELECT event_id, n > 0 OR o = 'stale' OR s IN ('paused', 'pause_requested') OR why <> '' AS resumable,
  CASE WHEN n > 0 OR o = 'stale' THEN 'prepare_resume' WHEN s IN ('paused', 'pause_requested') THEN 'resume_run' WHEN event_id // 64 % 2 = 1 THEN 'replan_remaining' ELSE 'continue_stage' END AS action
FROM (SELECT event_id, {picked(_EFFECTIVE, "event_id")} AS s, CASE WHEN event_id // 4 % 4 = 0 THEN 2 ELSE 0 END AS n, {picked(("active", "stale", "none"), "event_id // 16")} AS o, {picked(("", "limit"), "event_id // 32")} AS why FROM events)""")
def recovery_actions(spark, d):
    r = table(spark, d, "events").select("event_id", pick(_EFFECTIVE, "event_id").alias("effective_status"), F.expr("if(event_id div 4 % 4 = 0, 2, 0)").alias("interrupted_chunks"), pick(("active", "stale", "none"), "event_id div 16").alias("ownership_status"), pick(("", "limit"), "event_id div 32").alias("aborted_reason"), F.expr("event_id div 64 % 2 = 1").alias("replan_required"))
    return runtime.recovery(r).select("event_id", "resumable", F.col("recovery_action").alias("action"))


_FLAGS = "b(event_id, replan, paused, failed, warned, processed, ok, waiting, finished) AS (SELECT event_id, " + ", ".join(f"event_id // {1 << k} % 2 = 1" for k in range(8)) + " FROM events)"


@query(f"""WITH {_FLAGS} SELECT event_id, CASE WHEN replan THEN 'replan_pending' WHEN paused OR failed OR warned THEN 'chunk_warning' WHEN processed AND ok THEN 'processing_done' WHEN processed THEN 'chunk_running'
  WHEN waiting THEN 'chunk_queue_ready' WHEN finished THEN 'processing_done' ELSE 'chunk_queue_ready' END AS substate FROM b""")
def processing_substates(spark, d):
    bit = lambda k: F.expr(f"event_id div {1 << k} % 2")
    names = ("replan_required", "paused", "failed_count", "warning_count", "processed_count", "success", "pending_chunks", "completed_chunks")
    r = table(spark, d, "events").select("event_id", *[(bit(k) == 1 if n in ("replan_required", "paused", "success") else bit(k)).alias(n) for k, n in enumerate(names)])
    return runtime.processing_substate(r).select("event_id", "substate")


_REPORTS = f"""v AS (SELECT doc_id, quality = 1 AS passed, {picked(("", "repair_chunk", "fallback_to_deepgram", None), "doc_id")} AS asked, doc_id % 4 < 3 AS reported,
  {picked(("", "replan_pending"), "doc_id // 4")} AS substate, toxic AS warned, CASE doc_id // 8 % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ok FROM labels)"""


@query(f"""WITH {_REPORTS} SELECT doc_id, CASE WHEN NOT reported AND (substate = 'replan_pending' OR warned = 1) THEN 'processing' ELSE 'run' END AS scope,
  CASE WHEN reported THEN CASE WHEN asked = 'fallback_to_deepgram' THEN 'warn' WHEN passed THEN 'pass' ELSE 'fail' END WHEN substate = 'replan_pending' OR warned = 1 OR NOT coalesce(ok, true) THEN 'warn' ELSE 'pass' END AS gate,
  CASE WHEN reported THEN CASE WHEN asked = 'fallback_to_deepgram' THEN asked WHEN passed THEN 'accept_output' ELSE 'repair_chunk' END WHEN substate = 'replan_pending' THEN 'replan_remaining' WHEN warned = 1 THEN 'retry_action'
    WHEN coalesce(ok, true) THEN 'continue_stage' ELSE 'request_human_escalation' END AS action FROM v""")
def evaluator_reports(spark, d):
    report = F.struct((F.col("quality") == 1).alias("passed"), pick(("", "repair_chunk", "fallback_to_deepgram", None), "doc_id").alias("recommended_action"))
    r = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 4 < 3, report).alias("quality"), pick(("", "replan_pending"), "doc_id div 4").alias("substate"), F.col("toxic").alias("warning_count"), pick((True, False, None), "doc_id div 8").alias("success"))
    return runtime.evaluator_report(r).select("doc_id", "scope", F.col("quality_gate_state").alias("gate"), F.col("evaluator_action").alias("action"))


_COMMANDS = (
    "pause-run", "cancel-run", "resume-run", "runtime-status", "prepare-resume", "replan-remaining", "process-chunks", "advance-run", "inspect-run", "apply-control", "create-run", "validate-state", "plan-optimization", "chunk-text",
    "chunk-segments", "chunk-document", "get-chapters", "build-chapter-plan", "normalize-document", "sync-state", "verify-quality", "assemble-final", "merge-content", "finalize-run", "load-config", "preflight", "download-subtitles",
    "download-audio", "download-metadata", "parse-vtt", "build-glossary", " summarize-telemetry ", "",
)
_STAGE = """CASE WHEN c IN ('create-run', 'validate-state', 'plan-optimization', 'get-chapters', 'build-chapter-plan') OR starts_with(c, 'chunk-') THEN 'planning' WHEN c IN ('normalize-document', 'sync-state') THEN 'normalize'
  WHEN c = 'verify-quality' THEN 'verify' WHEN c IN ('assemble-final', 'merge-content', 'finalize-run') THEN 'assemble' WHEN c IN ('load-config', 'preflight') THEN 'preflight' WHEN starts_with(c, 'download-') THEN 'source'
  WHEN ends_with(c, '-run') OR c IN ('runtime-status', 'prepare-resume', 'replan-remaining', 'process-chunks', 'apply-control') THEN 'processing' ELSE replace(c, '-', '_') END"""


@query(f"""WITH e AS (SELECT event_id, trim({picked(_COMMANDS, "event_id")}) AS c, {picked(("", "", "", " verify "), "event_id // 33")} AS given FROM events)
SELECT event_id, CASE WHEN trim(given) <> '' THEN trim(given) ELSE {_STAGE} END AS stage FROM e""")
def command_stages(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", runtime.stage_of(pick(_COMMANDS, "event_id"), pick(("", "", "", " verify "), "event_id div 33")).alias("stage"))


_LIFE = ("verify-quality", "assemble-final", "merge-content", "finalize-run", "chunk-text", "process-chunks")


@query(f"""WITH e AS (SELECT event_id, {picked(_LIFE, "event_id")} AS c, {picked(("", "", "given"), "event_id // 6")} AS own, {picked(("", "paused", "pause_requested", "cancellation_requested"), "event_id // 18")} AS eff, {picked(("", "", "resumable", "resume_pending", "running", "pending", "done"), "event_id // 72")} AS rt,
  event_id // 7 % 5 = 0 AS paused, event_id // 11 % 5 = 0 AS aborted, event_id // 13 % 5 = 0 AS dry, event_id // 17 % 5 < 4 AS ok FROM events), s AS (SELECT *, {_STAGE} AS stage FROM e)
SELECT event_id, CASE WHEN own <> '' THEN own WHEN eff IN ('paused', 'pause_requested') THEN 'paused' WHEN eff = 'cancellation_requested' THEN 'failed_terminal' WHEN rt IN ('resumable', 'resume_pending', 'running', 'pending') THEN 'processing'
  WHEN paused THEN 'paused' WHEN aborted THEN 'failed_terminal' WHEN dry THEN 'planned' WHEN ok AND c = 'verify-quality' THEN 'verifying' WHEN ok AND stage = 'assemble' THEN 'completed' ELSE stage END AS state FROM s""")
def lifecycle_states(spark, d):
    c, every = pick(_LIFE, "event_id"), lambda k: F.expr(f"event_id div {k} % 5 = 0")
    r = F.struct(c.alias("command"), pick(("", "", "given"), "event_id div 6").alias("lifecycle_state"), pick(("", "paused", "pause_requested", "cancellation_requested"), "event_id div 18").alias("effective_status"),
                 pick(("", "", "resumable", "resume_pending", "running", "pending", "done"), "event_id div 72").alias("runtime_status"), every(7).alias("paused"), every(11).alias("aborted"), every(13).alias("dry_run"), F.expr("event_id div 17 % 5 < 4").alias("success"))
    return table(spark, d, "events").select("event_id", runtime.lifecycle_state(r, runtime.stage_of(c)).alias("state"))


def _signals(spark, d):
    bit = lambda k: F.expr(f"event_id div {k} % 2 = 1")
    return table(spark, d, "events").select("event_id", pick(("processing", "verify", "assemble", "planning"), "event_id").alias("active_stage"), F.lit("running").alias("effective_status"), bit(4).alias("success"), bit(8).alias("passed"), bit(16).alias("paused"), bit(32).alias("aborted"), bit(64).alias("replan_required"), bit(128).alias("timeout"), bit(256).alias("reroute"), F.expr("event_id div 512 % 2").alias("failed_count"), F.expr("event_id div 1024 % 2").alias("warning_count"), pick(("", "abort_run", "pause_run", "repair_chunk"), "event_id div 3").alias("evaluator_action"))


_BITS = "s(event_id, stage, success, passed, paused, aborted, replan, timeout, reroute, failed, warned, asked) AS (SELECT event_id, ['processing', 'verify', 'assemble', 'planning'][event_id % 4 + 1], " + ", ".join(f"event_id // {k} % 2 = 1" for k in (4, 8, 16, 32, 64, 128, 256)) + f", event_id // 512 % 2, event_id // 1024 % 2, {picked(('', 'abort_run', 'pause_run', 'repair_chunk'), 'event_id // 3')} FROM events)"
_ACTS = """a AS (SELECT *, CASE stage WHEN 'processing' THEN ['continue_stage', 'pause_run', 'abort_run'] || CASE WHEN replan THEN ['replan_remaining', 'request_human_escalation'] ELSE [] END
  || CASE WHEN paused THEN ['resume_run'] ELSE [] END || CASE WHEN aborted AND NOT replan THEN ['request_human_escalation'] ELSE [] END || CASE WHEN failed + warned > 0 THEN ['retry_action', 'repair_chunk'] ELSE [] END
  || CASE WHEN timeout THEN ['shrink_chunk_size', 'switch_model_profile'] ELSE [] END
  WHEN 'verify' THEN CASE WHEN passed THEN ['accept_output'] ELSE ['repair_chunk', 'replan_remaining', 'degrade_output_mode', 'request_human_escalation', 'abort_run'] END
  WHEN 'planning' THEN CASE WHEN reroute THEN ['fallback_to_deepgram', 'request_human_escalation', 'abort_run'] ELSE ['continue_stage', 'request_human_escalation', 'abort_run'] END ELSE ['continue_stage', 'abort_run'] END AS acts,
  CASE WHEN timeout THEN 'high' WHEN warned > 0 THEN 'medium' ELSE 'normal' END AS pressure FROM s)"""


@query(f"WITH {_BITS}, {_ACTS} SELECT event_id, array_to_string(list_sort(acts), ',') AS acts, pressure, aborted AND NOT success AS escalate FROM a")
def policy_actions(spark, d):
    p = runtime.policy(_signals(spark, d))
    return p.select("event_id", F.array_join(F.sort_array("allowed_actions"), ",").alias("acts"), F.col("budget_pressure_level").alias("pressure"), F.col("escalation_required").alias("escalate"))


@query(f"""WITH {_BITS}, {_ACTS} SELECT event_id, CASE WHEN reroute AND list_contains(acts, 'fallback_to_deepgram') THEN 'fallback_to_deepgram' WHEN passed AND list_contains(acts, 'accept_output') THEN 'accept_output'
  WHEN replan AND list_contains(acts, 'replan_remaining') THEN 'replan_remaining' WHEN paused AND list_contains(acts, 'resume_run') THEN 'resume_run' WHEN aborted AND list_contains(acts, 'request_human_escalation') THEN 'request_human_escalation'
  WHEN pressure = 'high' AND list_contains(acts, 'shrink_chunk_size') THEN 'shrink_chunk_size' WHEN stage = 'verify' AND NOT passed AND list_contains(acts, 'repair_chunk') THEN 'repair_chunk'
  WHEN stage = 'processing' AND warned > 0 AND list_contains(acts, 'retry_action') THEN 'retry_action' WHEN list_contains(acts, asked) THEN asked WHEN list_contains(acts, 'continue_stage') THEN 'continue_stage' ELSE acts[1] END AS action FROM a""")
def decisions(spark, d):
    return runtime.decide(runtime.policy(_signals(spark, d))).select("event_id", "action")


@query("""WITH RECURSIVE e(f, t) AS (SELECT 'region' || r_regionkey, 'nation' || n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'nation' || n_nationkey, 'supplier' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey),
w(f, t, h) AS (SELECT f, t, 1 FROM e UNION ALL SELECT w.f, e.t, h + 1 FROM w JOIN e ON e.f = w.t) SELECT f AS from_id, t AS to_id, CAST(min(h) AS BIGINT) AS hops FROM w GROUP BY 1, 2""")
def artifact_reach(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    up = n.select(F.concat(F.lit("region"), "n_regionkey").alias("from_id"), F.concat(F.lit("nation"), "n_nationkey").alias("to_id"))
    down = s.select(F.concat(F.lit("nation"), "s_nationkey").alias("from_id"), F.concat(F.lit("supplier"), "s_suppkey").alias("to_id"))
    return runtime.reachable(up.unionByName(down)).select("from_id", "to_id", F.col("hops").cast("long").alias("hops"))


def _derived(spark, d):
    """Each order as an action of its customer's run: an artifact that follows from the order before, and the customer's folder."""
    key = F.col("o_orderkey").cast("string")
    result = F.concat(F.lit('{"artifacts": [{"artifact_id": "o'), key, F.lit('", "artifact_type": "order", "path": "/o/'), key, F.lit('", "parent_artifacts": ["o'), (F.col("o_orderkey") - 1).cast("string"), F.lit('"]}, {"path": "/o/'), key, F.lit('"}]}'))
    context = F.concat(F.lit('{"work_dir": "/c/'), F.col("o_custkey"), F.lit('"}'))
    return artifacts.derive(table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("action_id"), result.alias("result"), context.alias("context")))


@query("""SELECT o_custkey AS run_id, 'o' || o_orderkey AS artifact_id, 'order' AS artifact_type, '/o/' || o_orderkey AS path FROM orders
UNION ALL SELECT DISTINCT o_custkey, 'artifact_' || left(sha1('artifact:work_dir:/c/' || o_custkey || ':1'), 12), 'work_dir', '/c/' || o_custkey FROM orders""")
def artifact_nodes(spark, d):
    return artifacts.graph(_derived(spark, d))[0]


@query("SELECT o_custkey AS run_id, 'o' || (o_orderkey - 1) AS from_id, 'o' || o_orderkey AS to_id FROM orders")
def artifact_edges(spark, d):
    return artifacts.graph(_derived(spark, d))[1]


@query("""WITH RECURSIVE u AS (SELECT DISTINCT user_id AS v FROM events), e AS (SELECT v AS f, (v * 3 + 1) % 100 AS t FROM u UNION SELECT v, v + 1 FROM u WHERE v % 10 = 5),
r AS (SELECT f, t FROM e UNION SELECT r.f, e.t FROM r JOIN e ON e.f = r.t)
SELECT a.f AS node, max(a.t) AS cycle FROM r a JOIN r b ON b.f = a.t AND b.t = a.f GROUP BY 1""")
def artifact_cycles(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("from_id")).distinct()
    far = u.select("from_id", ((F.col("from_id") * 3 + 1) % 100).alias("to_id"))
    return artifacts.cycles(far.unionByName(u.where("from_id % 10 = 5").select("from_id", (F.col("from_id") + 1).alias("to_id"))))


_FIELDS = ("vid", "url", "title", "channel", "upload_date", "duration", "output_dir", "mode", "src", "source_language", "subtitle_source", "output_file")
_FILES = ("", "talk 2024-01-15.md", "talk 20240115.md", "x20240115.md", "UNKNOWN", "99999999 20231301.md")


@query(f"""WITH p AS (SELECT page_id AS doc_id, {{{", ".join(f"'{f}': " + (picked(_FILES, "page_id") if f == "output_file" else f"CASE WHEN page_id % {k + 3} = 0 THEN '' WHEN page_id % {k + 4} = 1 THEN 'Unknown' ELSE 'v' END") for k, f in enumerate(_FIELDS))}}} AS f FROM pages),
x AS (SELECT doc_id, [{", ".join(f"{{'k': '{f}', 'v': f.{f}}}" for f in _FIELDS)}] AS l, f.output_file = 'talk 20240115.md' AS dated FROM p)
SELECT doc_id, array_to_string([e.k FOR e IN l IF e.v = ''], ',') AS missing, array_to_string([e.k FOR e IN l IF lower(e.v) = 'unknown'], ',') AS unknown, array_to_string([e.k FOR e IN l IF e.v <> '' AND lower(e.v) <> 'unknown'], ',') AS present, CASE WHEN dated THEN '20240115' ELSE '' END AS file_dates,
  len([1 FOR e IN l IF e.v = '' OR lower(e.v) = 'unknown']) = 0 AND NOT dated AS passed FROM x""")
def validate_state(spark, d):
    """All fields of the final stage, from a state file with a comment, a bullet and a field that is written twice."""
    value = lambda k: F.expr(f"case when page_id % {k + 3} = 0 then '' when page_id % {k + 4} = 1 then 'Unknown' else 'v' end")
    lines = [F.concat(F.lit(f"{f}:  "), pick(_FILES, "page_id") if f == "output_file" else value(k)) for k, f in enumerate(_FIELDS)]
    content = F.concat_ws("\n", F.lit("# state: of a run"), F.lit("title: an earlier one"), F.lit("- url: not this"), *lines)
    v = planning.validate(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), records.state_map(content).alias("fields")), "final")
    return v.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("missing", "unknown", "present", "file_dates")], "passed")


@query("""WITH p AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'chinese' WHEN lang = 'fr' THEN 'bilingual' ELSE 'mono' END AS mode, CASE WHEN doc_id % 2 = 0 THEN 'deepgram' ELSE 'youtube' END AS src, n_chars // 10 AS seconds, n_chars AS tokens FROM documents),
l AS (SELECT *, CAST(CASE WHEN mode = 'bilingual' THEN 4100 WHEN src = 'deepgram' THEN 4500 ELSE 4800 END AS BIGINT) AS token_limit FROM p),
r AS (SELECT *, CASE WHEN seconds >= 1800 THEN 'duration_threshold' WHEN tokens > token_limit THEN 'oversized_short_input' ELSE 'duration_short_single_pass' END AS reason FROM l)
SELECT doc_id, reason, token_limit, reason <> 'duration_short_single_pass' AS preflight,
  CASE WHEN reason <> 'duration_short_single_pass' THEN CASE mode WHEN 'chinese' THEN 'chunk cleanup_zh >  raw_path auto_replan_remaining' || CASE WHEN src = 'deepgram' THEN ' hint' ELSE '' END ELSE 'chunk structure_only >  raw_path auto_replan_remaining' END
      || CASE WHEN mode = 'bilingual' THEN '; chunk translate_only >  processed_path stop_and_review' ELSE '' END
    WHEN mode = 'bilingual' THEN 'prompt structure_only raw_text > structured_text not_applicable; prompt translate_only structured_text > optimized_text not_applicable'
    ELSE 'prompt cleanup_zh raw_text > optimized_text not_applicable' || CASE WHEN src = 'deepgram' THEN ' hint' ELSE '' END END AS operations FROM r""")
def route_plan(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "deepgram").otherwise("youtube").alias("source"), F.when(F.col("lang") == "de", "chinese").when(F.col("lang") == "fr", "bilingual").otherwise("mono").alias("mode"), F.expr("n_chars div 10").alias("duration"), F.col("n_chars").alias("tokens"))
    said = lambda o: F.concat_ws(" ", o["kind"], o["prompt"], F.nullif(o["input"], F.lit("")), F.lit(">"), F.when(o["kind"] == "chunk", F.concat(o["output"], F.lit(""))).otherwise(o["output"]), F.nullif(o["input_key"], F.lit("")), o["execution"]["on_replan_required"], F.when(o["extra_instruction"] != "", "hint"))
    p = planning.plan(t)
    return p.select("doc_id", F.col("routing_reason").alias("reason"), F.col("token_limit").cast("long").alias("token_limit"), F.col("requires_llm_preflight").alias("preflight"), F.array_join(F.transform("operations", said), "; ").alias("operations"))


@query(r"""WITH p AS (SELECT page_id AS doc_id, 'A "t" #' || page_id || ' <b>' AS title, 'Ch_' || page_id % 7 AS channel, page_id * 37 AS seconds, url, page_id % 2 = 0 AS two, CASE WHEN page_id % 3 = 0 THEN '' ELSE '20240115' END AS day FROM pages)
SELECT doc_id, '---' || chr(10) || 'title: "A \"t\" #' || doc_id || ' <b>"' || chr(10) || 'source: "' || url || '"' || chr(10) || 'url: "' || url || '"' || chr(10) || 'channel: "' || channel || '"' || chr(10) || 'author: "' || channel || '"' || chr(10)
  || CASE WHEN day = '' THEN '' ELSE 'date: "2024-01-15"' || chr(10) END || 'created: "2024-02-30x"' || chr(10) || 'type: video-transcript' || chr(10) || 'bilingual: ' || CASE WHEN two THEN 'true' ELSE 'false' END || chr(10) || 'duration: "' || seconds // 60 || 'm"' || chr(10)
  || 'transcript_source: "youtube"' || chr(10) || 'tags: [youtube, video-transcript]' || chr(10) || 'via: "youtube"' || chr(10) || '---' || chr(10) || chr(10) || '# A "t" \#' || doc_id || ' \<b\>' || chr(10) || chr(10)
  || '> Video source: [YouTube - ' || replace(channel, '_', '\_') || '](' || url || ')' || chr(10) || '> Language mode: ' || CASE WHEN two THEN 'Bilingual' ELSE 'Chinese' END || chr(10) || '> Duration: ' || seconds // 60 || ' minutes' || chr(10) || chr(10) || '---' || chr(10)
  || 'Body of ' || doc_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*This article was generated by AI voice transcription (youtube), for reference only.*' || chr(10) AS content FROM p""")
def assembled(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit('A "t" #'), "page_id", F.lit(" <b>")).alias("title"), F.concat(F.lit("Ch_"), F.col("page_id") % 7).alias("channel"), F.when(F.col("page_id") % 3 == 0, "").otherwise("20240115").alias("upload_date"), F.lit("2024-02-30x").alias("created"), "url", (F.col("page_id") * 37).alias("duration"), F.lit("youtube").alias("transcript_source"), (F.col("page_id") % 2 == 0).alias("bilingual"), F.concat(F.lit("\n Body of "), "page_id", F.lit("\n\n")).alias("text"))
    return merge.assemble(p).select("doc_id", "content")


@query("SELECT user_id, CASE WHEN count(DISTINCT nullif(trim(event_type), '')) > 1 THEN 'mixed' ELSE coalesce(min(nullif(trim(event_type), '')), '') END AS source, count(*) AS n FROM events GROUP BY 1")
def token_sources(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("token_source"))
    counts = e.groupBy(F.col("doc_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    return E.token_source(e).join(counts, F.col("doc_id").eqNullSafe(F.col("user_id"))).select("user_id", F.col("token_source").alias("source"), "n")


@query("""SELECT page_id, '"' || replace(replace(url, '\\', '\\\\'), '"', '\\"') || '"' AS yaml, regexp_replace(url, '([\\\\`*_{}\\[\\]()#+!<>|])', '\\\\\\1', 'g') AS markdown FROM pages""")
def escapes(spark, d):
    return table(spark, d, "pages").select("page_id", T.yaml_scalar("url").alias("yaml"), T.escape_markdown("url").alias("markdown"))
