"""Control of runs: reuse, resume, policy, decisions, reports and artifacts, as tables and CASE expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import lineage

_EMPTY = "array<string>"


def output_matches(chunk: Column, task: str, input_key: str) -> Column:
    """Whether a stored result is of this operation; one without a stamp is, if its input was the raw text."""
    stamp = F.btrim(F.coalesce(chunk["prompt_name"], F.lit("")))
    key = F.btrim(F.coalesce(chunk["input_key"], F.lit("")))
    return F.when((stamp == "") & (key == ""), F.lit(input_key == "raw_path")).otherwise((stamp == task) & (key == input_key))


# What the status codes and messages of a model's service mean.
TIMEOUTS = (408, 504)
RETRYABLE = (408, 409, 425, 429)
TOO_LARGE = (413, 422)
TOO_LONG = ("context", "prompt", "max token", "too long", "token limit")
LOST = (
    "remote end closed connection without response", "remote disconnected", "connection reset", "connection aborted", "broken pipe",
    "incomplete read", "bad status line", "connection closed", "connection lost",
)


def _any_in(message: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda x: F.contains(message, x))


def classify_error(status: Column, message: Column, cause: Column | None = None) -> Column:
    """struct(error_type, retryable, replan): what a failed request means for a chunk.

    status: the HTTP status, null if there was no answer. cause, where there was none or it couldn't be read: ``malformed`` (an
    answer without the fields expected), ``timeout``, ``unreachable``; anything else is an error of an unknown kind.
    """
    m, why = F.lower(T.text_of(message)), F.coalesce(cause, F.lit("")) if cause is not None else F.lit("")
    silent = F.when(why == "malformed", "bad_response").when((why == "timeout") | m.contains("timed out"), "timeout").when(_any_in(m, LOST), "remote_disconnect").when(why == "unreachable", "network").otherwise("unknown")
    of_status = F.struct(F.concat(F.lit("http_"), status.cast("string")).alias("error_type"), (status.isin(*RETRYABLE) | (status >= 500)).alias("retryable"), (status.isin(*TIMEOUTS, *TOO_LARGE) | ((status == 400) & _any_in(m, TOO_LONG))).alias("replan"))
    of_kind = T.let(silent, lambda k: F.struct(k.alias("error_type"), k.isin("timeout", "remote_disconnect").alias("retryable"), k.isin("timeout", "bad_response").alias("replan")))
    return F.when(status.isNotNull(), of_status).otherwise(of_kind)


def pending(chunks: DataFrame) -> DataFrame:
    return chunks.where(~F.col("status").isin("done", "superseded"))


def repair_for_resume(chunks: DataFrame, outputs: DataFrame, task: str, input_key: str = "raw_path") -> DataFrame:
    """chunks with the status to resume from, the previous_status and the repair made (promoted, interrupted, missing_output or empty).

    outputs (doc_id, id, prompt_name, input_key, size) are the stored results. A running or interrupted chunk with a result of
    this operation is done; a running one without is interrupted, and so is a done one whose result is missing. A done
    chunk with the result of another operation stays as it is.
    """
    o = outputs.select("doc_id", "id", F.struct("prompt_name", "input_key").alias("_o"), F.col("size").alias("_n"))
    both = chunks.join(o, ["doc_id", "id"], "left")
    stored = F.col("_o").isNotNull()
    good = F.coalesce((F.col("_n") > 0) & output_matches(F.col("_o"), task, input_key), F.lit(False))
    s = F.coalesce(F.nullif(F.btrim(F.col("status")), F.lit("")), F.lit("pending"))
    repair = F.when(s.isin("running", "interrupted") & good, "promoted").when(s == "running", "interrupted").when((s == "done") & ~stored, "missing_output").otherwise("")
    status = F.when(F.col("repair") == "promoted", "done").when(F.col("repair") != "", "interrupted").otherwise(F.col("previous_status"))
    return both.withColumn("previous_status", s).withColumn("repair", repair).withColumn("status", status).drop("_o", "_n")


def runtime_status(chunks: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(doc_id, runtime_status): what a run is found to be in, by the statuses of its active chunks and the status it had.

    runs (doc_id, status, replan_required), if given, has a row for each run, also for those without chunks.
    """
    blank = lambda c: F.coalesce(F.nullif(F.btrim(c), F.lit("")), F.lit("pending"))
    chunk = blank(F.col("status"))
    s = chunks.groupBy("doc_id").agg(F.collect_set(F.when(chunk != "superseded", chunk)).alias("s"))
    if runs is None:
        s = s.withColumn("was", F.lit("pending")).withColumn("again", F.lit(False))
    else:
        had = runs.select("doc_id", blank(F.col("status")).alias("was"), F.coalesce("replan_required", F.lit(False)).alias("again"))
        s = had.join(s, "doc_id", "left").withColumn("s", F.coalesce("s", F.array().cast(_EMPTY)))
    has = lambda x: F.array_contains("s", x)
    only = lambda *x: (F.size("s") > 0) & (F.size(F.array_except("s", F.array(*map(F.lit, x)))) == 0)
    was, unfinished = F.col("was"), ("resumable", "paused", "aborted")
    status = (
        F.when(F.col("again"), "aborted")
        .when(only("done"), "completed")
        .when(has("interrupted"), "resumable")
        .when(only("done", "failed") & has("failed"), "completed_with_errors")
        .when(was.isin("running", "paused"), "resumable")
        .when(has("pending"), F.when(was.isin(*unfinished, "completed", "completed_with_errors"), "resumable").otherwise("pending"))
        .when(has("failed"), F.when(was.isin(*unfinished), "resumable").otherwise("completed_with_errors"))
        .otherwise(was)
    )
    return s.select("doc_id", status.alias("runtime_status"))


def effective_status(status: Column, pause_requested: Column, cancel_requested: Column) -> Column:
    """A run's status together with requests to pause or cancel it, which count while it runs."""
    s = F.coalesce(F.nullif(F.btrim(status), F.lit("")), F.lit("pending"))
    asked = lambda c: F.coalesce(c, F.lit(False)) & (s == "running")
    return F.when(asked(pause_requested), "pause_requested").when(asked(cancel_requested), "cancellation_requested").otherwise(s)


def recovery(runs: DataFrame) -> DataFrame:
    """runs (effective_status, interrupted_chunks, ownership_status, aborted_reason, replan_required) with resumable and recovery_action."""
    broken = (F.coalesce("interrupted_chunks", F.lit(0)) > 0) | F.coalesce(F.col("ownership_status") == "stale", F.lit(False))
    paused = F.coalesce(F.col("effective_status").isin("paused", "pause_requested"), F.lit(False))
    gave_up = F.btrim(F.coalesce("aborted_reason", F.lit(""))) != ""
    action = F.when(broken, "prepare_resume").when(paused, "resume_run").when(F.coalesce("replan_required", F.lit(False)), "replan_remaining").otherwise("continue_stage")
    return runs.withColumn("resumable", broken | paused | gave_up).withColumn("recovery_action", action)


def processing_substate(runs: DataFrame) -> DataFrame:
    """runs (replan_required, paused, failed_count, warning_count, processed_count, success, pending_chunks, completed_chunks) with substate."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    substate = (
        F.when(on("replan_required"), "replan_pending")
        .when(on("paused") | some("failed_count") | some("warning_count"), "chunk_warning")
        .when(some("processed_count"), F.when(on("success"), "processing_done").otherwise("chunk_running"))
        .when(~some("pending_chunks") & some("completed_chunks"), "processing_done")
        .otherwise("chunk_queue_ready")
    )
    return runs.withColumn("substate", substate)


def policy(runs: DataFrame, allow_degrade: bool = True) -> DataFrame:
    """runs with allowed_actions, degrade_allowed, escalation_required and budget_pressure_level.

    Columns: active_stage, effective_status, and of the result success, passed, paused, aborted, replan_required,
    failed_count, warning_count, timeout, reroute.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    many = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    acts = lambda when, *names: F.when(when, F.array(*map(F.lit, names))).otherwise(F.array().cast(_EMPTY))
    stage, status = F.col("active_stage"), F.col("effective_status")
    processing, verifying, early = stage == "processing", stage == "verify", stage.isin("planning", "normalize", "preflight", "source")
    listed = F.flatten(
        F.array(
            acts(processing, "continue_stage", "pause_run", "abort_run"),
            acts(processing & on("replan_required"), "replan_remaining", "request_human_escalation"),
            acts(processing & (on("paused") | status.isin("paused", "pause_requested")), "resume_run", "abort_run"),
            acts(processing & on("aborted"), "request_human_escalation", "abort_run"),
            acts(processing & (many("failed_count") | many("warning_count")), "retry_action", "repair_chunk"),
            acts(processing & on("timeout"), "shrink_chunk_size", "switch_model_profile"),
            acts(verifying & on("passed"), "accept_output"),
            acts(verifying & ~on("passed"), "repair_chunk", "replan_remaining", "degrade_output_mode", "request_human_escalation", "abort_run"),
            acts(early & on("reroute"), "fallback_to_deepgram", "request_human_escalation", "abort_run"),
            acts(early & ~on("reroute"), "continue_stage", "request_human_escalation", "abort_run"),
            acts(~F.coalesce(processing | verifying | early, F.lit(False)), "continue_stage", "abort_run"),
        )
    )
    listed = listed if allow_degrade else F.array_remove(listed, "degrade_output_mode")
    listed = F.when(status == "cancellation_requested", F.filter(listed, lambda a: a.isin("abort_run", "request_human_escalation"))).otherwise(listed)
    pressure = F.when(on("timeout"), "high").when(many("warning_count"), "medium").otherwise("normal")
    return runs.withColumn("allowed_actions", F.array_distinct(listed)).withColumn("degrade_allowed", F.array_contains("allowed_actions", "degrade_output_mode")).withColumn("escalation_required", on("aborted") & ~on("success")).withColumn("budget_pressure_level", pressure)


def decide(runs: DataFrame, ranker: Callable[[Column], Column] | None = None) -> DataFrame:
    """runs of policy() with action, confidence and decided_by.

    The rules come first, then the action that an evaluator prefers (evaluator_action, if runs has it), then the one that ranker
    names among several; either counts only if it is allowed.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    can = lambda a: F.array_contains("allowed_actions", a)
    failed_gate = (F.col("active_stage") == "verify") & ~on("passed")
    rules = [
        (on("reroute"), "fallback_to_deepgram", 0.95),
        (on("passed"), "accept_output", 0.95),
        (on("replan_required"), "replan_remaining", 0.95),
        (on("paused"), "resume_run", 0.9),
        (on("aborted"), "request_human_escalation", 0.85),
        (F.col("budget_pressure_level") == "high", "shrink_chunk_size", 0.8),
        (failed_gate, "repair_chunk", 0.8),
        (failed_gate, "replan_remaining", 0.75),
        ((F.col("active_stage") == "processing") & (F.coalesce("warning_count", F.lit(0)) > 0), "retry_action", 0.7),
    ]
    preferred = F.btrim(F.col("evaluator_action")) if "evaluator_action" in runs.columns else F.lit("")
    pick = lambda a, c, by="rule": F.struct(F.lit(a).alias("action") if isinstance(a, str) else a.alias("action"), F.lit(c).alias("confidence"), F.lit(by).alias("decided_by"))
    tries = [F.when(when & can(a), pick(a, c)) for when, a, c in rules]
    tries.append(F.when((preferred != "") & F.array_contains(F.col("allowed_actions"), preferred), pick(preferred, 0.78)))
    if ranker is not None:
        choice = ranker(F.col("allowed_actions"))
        tries.append(F.when((F.size("allowed_actions") > 1) & F.array_contains(F.col("allowed_actions"), choice), pick(choice, 0.7, "ranker")))
    tries += [F.when(can("continue_stage"), pick("continue_stage", 0.65)), F.when(F.size("allowed_actions") > 0, pick(F.get("allowed_actions", F.lit(0)), 0.5)), pick("", 0.0)]
    return runs.withColumn("_d", F.coalesce(*tries)).select(*runs.columns, "_d.action", "_d.confidence", "_d.decided_by")


def evaluator_report(runs: DataFrame) -> DataFrame:
    """runs with scope, quality_gate_state and evaluator_action.

    Columns: quality, a struct(passed, recommended_action) that is null without a quality report; substate; warning_count;
    success, true if null. A report counts before what the run says of itself.
    """
    q = F.col("quality")
    verdict = lambda scope, state, action: F.struct(F.lit(scope).alias("scope"), F.lit(state).alias("quality_gate_state"), F.lit(action).alias("evaluator_action"))
    reported = F.when(F.btrim(q["recommended_action"]) == "fallback_to_deepgram", verdict("run", "warn", "fallback_to_deepgram")).when(q["passed"], verdict("run", "pass", "accept_output")).otherwise(verdict("run", "fail", "repair_chunk"))
    own = (
        F.when(F.col("substate") == "replan_pending", verdict("processing", "warn", "replan_remaining"))
        .when(F.col("warning_count") != 0, verdict("processing", "warn", "retry_action"))
        .when(F.coalesce("success", F.lit(True)), verdict("run", "pass", "continue_stage"))
        .otherwise(verdict("run", "warn", "request_human_escalation"))
    )
    return runs.withColumn("_v", F.when(q.isNotNull(), reported).otherwise(own)).select(*runs.columns, "_v.*")


# The stages of commands; another command is its own stage, with underscores.
STAGES = {
    "processing": ("pause-run", "cancel-run", "resume-run", "runtime-status", "prepare-resume", "replan-remaining", "process-chunks", "advance-run", "inspect-run", "apply-control"),
    "planning": ("create-run", "validate-state", "plan-optimization", "chunk-text", "chunk-segments", "chunk-document", "get-chapters", "build-chapter-plan"),
    "normalize": ("normalize-document", "sync-state"),
    "verify": ("verify-quality",),
    "assemble": ("assemble-final", "merge-content", "finalize-run"),
    "preflight": ("load-config", "preflight"),
    "source": ("download-subtitles", "download-audio", "download-metadata"),
}


def stage_of(command: Column, active_stage: Column | None = None) -> Column:
    """The stage of a command; an active_stage that is given wins."""
    c = F.btrim(T.text_of(command))
    stage = F.replace(c, F.lit("-"), F.lit("_"))
    for name, commands in STAGES.items():
        stage = F.when(c.isin(*commands), name).otherwise(stage)
    return stage if active_stage is None else F.coalesce(F.nullif(F.btrim(active_stage), F.lit("")), stage)


def lifecycle_state(result: Column, stage: Column) -> Column:
    """The state of a run after a command.

    result: struct(command, lifecycle_state, effective_status, runtime_status, paused, aborted, dry_run, success); stage: that of stage_of.
    """
    r, on = result, lambda k: F.coalesce(result[k], F.lit(False))
    command = F.btrim(T.text_of(r["command"]))
    done = F.when(command == "verify-quality", "verifying").when(command.isin(*STAGES["assemble"]), "completed").otherwise(stage)
    return (
        F.when(F.btrim(r["lifecycle_state"]) != "", F.btrim(r["lifecycle_state"]))
        .when(r["effective_status"].isin("paused", "pause_requested"), "paused")
        .when(r["effective_status"] == "cancellation_requested", "failed_terminal")
        .when(r["runtime_status"].isin("resumable", "resume_pending", "running", "pending"), "processing")
        .when(on("paused"), "paused")
        .when(on("aborted"), "failed_terminal")
        .when(on("dry_run"), "planned")
        .when(on("success"), done)
        .otherwise(stage)
    )


def artifacts(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of commands (run_id, artifacts: array of struct(artifact_id, type, path, parents)): each path once, an edge for each parent."""
    a = commands.select("run_id", F.posexplode("artifacts").alias("k", "a")).where(F.btrim(F.coalesce("a.path", F.lit(""))) != "")
    nodes = a.groupBy("run_id", F.col("a.path").alias("path")).agg(F.min_by("a.artifact_id", "k").alias("artifact_id"), F.min_by("a.type", "k").alias("type"))
    edges = a.select("run_id", F.explode("a.parents").alias("from_id"), F.col("a.artifact_id").alias("to_id")).distinct()
    return nodes, edges


def reachable(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, hops): every artifact that follows from another, by the shortest way; edges (from_id, to_id) may have cycles.

    Ways are joined end to end until none is new or shorter, so that a way of n edges takes log2(n) steps; each is
    checkpointed.
    """
    now = lineage.cut(edges.select("from_id", "to_id", F.lit(1).alias("hops")).distinct())
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum("hops")).first())
    was = None
    while (is_now := state(now)) != was:
        on = now.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("_t"), F.col("hops").alias("_h"))
        further = now.join(on, "to_id").select("from_id", F.col("_t").alias("to_id"), (F.col("hops") + F.col("_h")).alias("hops"))
        now, was = lineage.cut(now.unionByName(further).groupBy("from_id", "to_id").agg(F.min("hops").alias("hops"))), is_now
    return now
