"""The loop that sends chunks to a model: resume, context, retries, repair, a breaker for timeouts, and the call for a new plan."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.controller import Rules, Run
from ..functions.terms import Automaton
from . import anchors as A
from . import glossary as G
from . import lineage, runtime
from . import segments as S
from .quality import faults


class RequestError(Exception):
    """A failed request: the HTTP status, if there was an answer, and else its cause (see runtime.classify_error)."""

    def __init__(self, message: str = "", status: int | None = None, cause: str = ""):
        super().__init__(message)
        self.status, self.cause = status, cause


@dataclass(frozen=True)
class Limits:
    """Retries of a request that may pass, doubling the wait; repairs of a result that has faults; failures in a row, of those that don't ask for
    a new plan, that stop a run (0: none); sentences of the chunk before that go along; most terms and anchors of a prompt; the controller's rules."""

    retries: int = 3
    backoff_sec: float = 1.5
    repairs: int = 1
    repair_backoff_sec: float = 0.0
    stop_after_failures: int = 0
    tail_sentences: int = 1
    terms: int = 8
    anchors: int = 8
    rules: Rules = Rules()


def kind_of(error: RequestError) -> tuple[str, bool, bool]:
    """(error_type, retryable, replan) by the rules of runtime.classify_error, for one error in a worker."""
    message, status = str(error).lower(), error.status
    if status is not None:
        long = status == 400 and any(x in message for x in runtime.TOO_LONG)
        return f"http_{status}", status in runtime.RETRYABLE or status >= 500, long or status in (*runtime.TIMEOUTS, *runtime.TOO_LARGE)
    if error.cause == "malformed":
        return "bad_response", False, True
    if error.cause == "timeout" or "timed out" in message:
        return "timeout", True, True
    if any(x in message for x in runtime.LOST):
        return "remote_disconnect", True, False
    return ("network" if error.cause == "unreachable" else "unknown"), False, False


#: Where a template takes the text, and before which heading context goes.
PLACES, INPUT = ("{RAW_TEXT}", "{STRUCTURED_TEXT}"), "\n## Input Text\n"


def build_prompt(template: str, text: str, *contexts: str) -> str:
    """A template with contexts, the first nearest to the text, and the text: in its place, or behind all else."""
    for context in reversed([c for c in contexts if c]):
        if INPUT in template:
            template = template.replace(INPUT, f"\n{context}\n{INPUT}", 1)
        else:
            template = f"{template.rstrip()}\n\n{context}\n"
    for place in PLACES:
        if place in template:
            return template.replace(place, text)
    return f"{template.rstrip()}\n\n{text}"


SCHEMA = "id int, status string, result string, attempts int, repairs int, error_type string, warnings array<string>, event string, target int, autotune string"

_TITLE = re.compile(r"(?m)^##\s+(.+?)\s*$")


def _prepared(chunks: DataFrame, task: str, limits: Limits, glossary: DataFrame | None, input_key: str) -> DataFrame:
    """chunks with what their prompts need: contexts of terms and anchors, the terms and anchors to look for, the tail before, and whether a result is of this operation."""
    names = ["doc_id", "id", "status", "text", "result", "prompt_name", "input_key"]
    stored = [c for c in ("processed_input_tail_context_text", "processed_tail_context_text", "tail_context_text", "processed_input_section_title", "last_section_title") if c in chunks.columns]
    rows = chunks.select(*names, *stored)
    if "tail_context_text" not in stored:
        rows = rows.withColumn("tail_context_text", T.tail_sentences("text", limits.tail_sentences))
    # results of this run give the section titles that follow; those stored are of runs before
    before = S.continuity(rows.withColumn("status", F.coalesce("status", F.lit("pending"))), input_key, limits.tail_sentences).select("doc_id", "id", F.col("context_tail").alias("tail"), F.col("context_section").alias("section"))
    rows = rows.select(*names).join(before, ["doc_id", "id"], "left").withColumn("_a", A.extract("text", limits.anchors))
    rows = rows.withColumn("anchors", F.col("_a.ordered")).withColumn("numbers", F.col("_a.numbers")).withColumn("anchor_context", A.prompt_context(F.col("_a"))).drop("_a")
    rows = rows.withColumn("matches", runtime.output_matches(F.struct("prompt_name", "input_key"), task, input_key))
    if glossary is None:
        return rows.withColumn("terms", F.array().cast("array<string>")).withColumn("term_context", F.lit(""))
    chosen = G.select_terms(rows.select("doc_id", F.struct("doc_id", "id").alias("key"), "text"), glossary, limits.terms)
    expected = F.coalesce(F.nullif(F.col("preferred_output"), F.lit("")), F.col("term"))
    terms = chosen.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", expected.alias("e")))), lambda s: s["e"]).alias("terms"))
    both = terms.join(G.prompt_context(chosen).withColumnRenamed("context", "term_context"), "key").select("key.doc_id", "key.id", "terms", "term_context")
    return rows.join(both, ["doc_id", "id"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).withColumn("term_context", F.coalesce("term_context", F.lit("")))


def process_chunks(
    chunks: DataFrame, request: Callable[[str], str], task: str, template: str = "", limits: Limits = Limits(), glossary: DataFrame | None = None, input_key: str = "raw_path", force: bool = False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic
) -> DataFrame:
    """(doc_id, id, status, result, attempts, repairs, error_type, warnings, event, target, autotune) of chunks (doc_id, id, status, text, result, prompt_name, input_key).

    A document's chunks go to request one after another; documents run in parallel. Superseded chunks stay, and so do done ones with a
    result of this operation, unless force. A prompt is build_prompt() of the template, the continuity with the chunk before (segments.continuity:
    stored tails, if chunks has them, else the last sentences of its text; the last heading of its result), the glossary's terms and the anchors of the text, and the text.
    A result with faults (quality.faults; a term with a preferred output must be there in that form) is asked for again as often as repairs allows, then taken
    with warnings. Each outcome steps the controller; target and autotune are what it then says. A document's run ends with
    the event ``replan`` by an error that asks for a new plan, a timeout before an answer, or a target that shrinks within the canary, and with
    ``stopped`` by as many other failures in a row as allowed; the chunks behind stay pending.
    A document with its results is one group of a task, which is the unit of the engine.
    """
    kind = chunks.schema["doc_id"].dataType.simpleString()
    rules = limits.rules

    def ask(prompt: str) -> tuple[str | None, int, str, bool, bool, int]:
        """(result, attempts, error type, whether an attempt timed out, whether a new plan is needed, milliseconds of the last attempt)."""
        late = False
        for attempt in range(1, limits.retries + 2):
            began = clock()
            try:
                result = request(prompt)
                return result, attempt, "", late, late, int((clock() - began) * 1000)
            except RequestError as error:
                what, again, replan = kind_of(error)
                late = late or what in ("timeout", *(f"http_{s}" for s in runtime.TIMEOUTS))
                if not again or attempt > limits.retries:
                    return None, attempt, what, late, replan, 0
                sleep(limits.backoff_sec * 2 ** (attempt - 1))
        raise AssertionError("unreachable")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, section, failures, ended, control = [], None, 0, "", Run(rules.start)
        for r in group.sort_values("id").itertuples():
            status, had = r.status or "pending", r.result if isinstance(r.result, str) else None
            row = [r.doc_id, r.id, status, had, 0, 0, "", [], "", control.target, ""]
            out.append(row)
            if status == "superseded":
                continue
            if status == "done" and r.matches and had and not force:
                row[8], section = "skipped", (_TITLE.findall(had) or [""])[-1]
                continue
            if ended:
                row[2] = "pending"
                continue
            text, terms, marks, numbers = r.text or "", list(r.terms), list(r.anchors), list(r.numbers)
            expected = Automaton(terms, False)
            prompt = build_prompt(template, text, S.continuity_block(r.tail or "", section or r.section or ""), r.term_context, r.anchor_context)
            while True:
                result, attempts, what, late, replan, took = ask(prompt)
                row[4] += attempts
                if result is None:
                    row[2], row[6], row[8] = "failed", what, "failed"
                    row[10] = control.step(rules, False, late, None)
                    failures += 1
                    ended = "replan" if replan or control.ended == "replan" else "stopped" if 0 < limits.stop_after_failures <= failures else ""
                    row[8] = ended or "failed"
                    break
                failures, lacks = 0, len(expected.used(result)) < len(terms)
                found = faults(task, text, result, lacks, bool(A.lost(marks, numbers, result)))
                if found and row[5] < limits.repairs:
                    row[5] += 1
                    sleep(limits.repair_backoff_sec)
                    continue
                row[2], row[3], row[7], row[8] = "done", result, found, "accepted_with_warnings" if found else "done"
                row[10] = control.step(rules, not late, late, took)
                section = (_TITLE.findall(result) or [""])[-1]
                if replan or control.ended == "replan":
                    ended = row[8] = "replan"
                break
            row[9] = control.target
        return pd.DataFrame(out, columns=["doc_id", "id", "status", "result", "attempts", "repairs", "error_type", "warnings", "event", "target", "autotune"])

    ready = _prepared(chunks, task, limits, glossary, input_key)
    return ready.drop("prompt_name", "input_key").groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, {SCHEMA}")


def run_result(processed: DataFrame) -> DataFrame:
    """(doc_id, processed_count, failed_count, skipped_count, warning_count, replan_required, aborted, success): a run's result from process_chunks."""
    n = lambda c: F.count_if(c)
    event = F.col("event")
    out = processed.groupBy("doc_id").agg(
        n((F.col("status") == "done") & (event != "skipped")).alias("processed_count"),
        n(F.col("error_type") != "").alias("failed_count"),
        n(event == "skipped").alias("skipped_count"),
        n(F.size("warnings") > 0).alias("warning_count"),
        F.bool_or(event == "replan").alias("replan_required"),
        F.bool_or(event.isin("replan", "stopped")).alias("aborted"),
    )
    return out.withColumn("success", (F.col("failed_count") == 0) & ~F.col("aborted"))


def retry_until_planned(chunks: DataFrame, request: Callable[[str], str], task: str, replan: Callable[[DataFrame], DataFrame], most: int = 1, **options) -> DataFrame:
    """process_chunks() over plans: chunks of documents that ask for a new plan go through replan (as chunking.replan gives it) and on, at most so often."""
    done = process_chunks(chunks, request, task, **options)
    texts = chunks.select("doc_id", "id", "text")
    for _ in range(most):
        done = lineage.cut(done)
        due = done.where("event = 'replan'").select("doc_id").distinct()
        if not due.take(1):
            break
        own = done.join(due, "doc_id").join(texts, ["doc_id", "id"])
        kept = own.select("doc_id", "id", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")).alias("status"), "text")
        planned = replan(kept).join(own.select("doc_id", "id", "result"), ["doc_id", "id"], "left")
        again = planned.withColumn("prompt_name", F.lit(task)).withColumn("input_key", F.lit(options.get("input_key", "raw_path")))
        again = lineage.cut(again)
        texts = texts.unionByName(again.select("doc_id", "id", "text").join(texts.select("doc_id", "id"), ["doc_id", "id"], "left_anti"))
        done = done.join(due, "doc_id", "left_anti").unionByName(process_chunks(again, request, task, **options))
    return done


def envelope(results: DataFrame, command: str, tool: str = "loomtext", version: int = 1) -> DataFrame:
    """(schema_version, tool, command, trace_id, success, stage, lifecycle_state, result): a command's results under one contract, the result as JSON.

    results: (trace_id, success, ...); the fields beside these are the result.
    """
    rest = [c for c in results.columns if c not in ("trace_id", "success")]
    stage = runtime.stage_of(F.lit(command), F.col("active_stage") if "active_stage" in rest else None)
    had = lambda c, kind: F.col(c).cast(kind) if c in results.columns else F.lit(None).cast(kind)
    state = F.struct(F.lit(command).alias("command"), had("lifecycle_state", "string").alias("lifecycle_state"), had("effective_status", "string").alias("effective_status"), had("runtime_status", "string").alias("runtime_status"), *[had(c, "boolean").alias(c) for c in ("paused", "aborted", "dry_run", "success")])
    return results.select(F.lit(version).alias("schema_version"), F.lit(tool).alias("tool"), F.lit(command.strip()).alias("command"), T.text_of("trace_id").alias("trace_id"), F.coalesce("success", F.lit(False)).alias("success"), stage.alias("stage"), runtime.lifecycle_state(state, stage).alias("lifecycle_state"), F.to_json(F.struct(*rest)).alias("result"))
