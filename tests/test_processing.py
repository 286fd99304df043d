"""The processing loop against requests that answer, fail and time out as told."""

import pytest
from loomtext.functions.controller import Rules
from loomtext.operators import chunking, processing
from loomtext.operators.processing import Limits, RequestError
from pyspark.sql import functions as F

SCHEMA = "doc_id string, id int, status string, text string, result string, prompt_name string, input_key string"
QUICK = Limits(retries=2, backoff_sec=0.0, repairs=1, stop_after_failures=2)


def chunk(doc, k, text, status="pending", result=None, task=None):
    return (doc, k, status, text, result, task, "raw_path" if task else None)


def run(spark, rows, request, limits=QUICK, **options):
    got = processing.process_chunks(spark.createDataFrame(rows, SCHEMA), request, "quick_cleanup", limits=limits, sleep=lambda s: None, **options)
    return {(r["doc_id"], r["id"]): r for r in got.collect()}


#: A lambda, so that it travels to the workers by value.
upper = lambda prompt: prompt.split("\n\n")[-1].upper()


def test_chunks_go_in_order_with_the_end_of_the_one_before(spark):
    rows = [chunk("a", 1, "second text"), chunk("a", 0, "first text"), chunk("b", 0, "other")]
    got = run(spark, rows, lambda p: f"[{p.count('Previous chunk tail')}]" + p)
    assert [got[k]["status"] for k in (("a", 0), ("a", 1), ("b", 0))] == ["done"] * 3
    assert got["a", 0]["result"].startswith("[0]") and got["a", 1]["result"].startswith("[1]") and got["b", 0]["result"].startswith("[0]")
    assert "first text" in got["a", 1]["result"]


def test_resume_skips_what_is_done_by_this_operation(spark):
    rows = [chunk("a", 0, "one", "done", "ONE", "quick_cleanup"), chunk("a", 1, "two", "done", "zwei", "translate_only"), chunk("a", 2, "old", "superseded"), chunk("a", 3, "three", "interrupted")]
    got = run(spark, rows, upper)
    assert [(got["a", k]["event"], got["a", k]["result"]) for k in range(4)] == [("skipped", "ONE"), ("done", "TWO"), ("", None), ("done", "THREE")]
    assert run(spark, rows, upper, force=True)["a", 0]["event"] == "done"


def failing(times, error):
    """A request that fails so often for each prompt, in whatever process it is."""
    seen = {}

    def request(prompt):
        seen[prompt] = seen.get(prompt, 0) + 1
        if seen[prompt] <= times:
            raise error
        return upper(prompt)

    return request


@pytest.mark.parametrize(
    "times,error,want",
    [
        (2, RequestError("busy", 429), ("done", 3, "", "done")),
        (9, RequestError("busy", 429), ("failed", 3, "http_429", "failed")),
        (1, RequestError("no key", 401), ("failed", 1, "http_401", "failed")),
        (1, RequestError("prompt is too long", 400), ("failed", 1, "http_400", "replan")),
        (1, RequestError("half an answer", None, "malformed"), ("failed", 1, "bad_response", "replan")),
        (1, RequestError("Connection reset"), ("done", 2, "", "done")),
        (9, RequestError("no route", None, "unreachable"), ("failed", 1, "network", "failed")),
        (9, RequestError("the read timed out"), ("failed", 3, "timeout", "replan")),
    ],
)
def test_errors(spark, times, error, want):
    got = run(spark, [chunk("a", 0, "some text"), chunk("a", 1, "more text")], failing(times, error))
    assert tuple(got["a", 0][c] for c in ("status", "attempts", "error_type", "event")) == want
    if want[3] == "replan":
        assert got["a", 1]["status"] == "pending" and got["a", 1]["attempts"] == 0


def test_repairs_and_warnings(spark):
    def lazy(prompt):
        return "x"

    got = run(spark, [chunk("a", 0, "a text of some length with 2024-05-06 in it")], lazy)["a", 0]
    assert (got["status"], got["event"], got["attempts"], got["repairs"]) == ("done", "accepted_with_warnings", 2, 1)
    assert set(got["warnings"]) == {"short_output", "missing_semantic_anchors"}


def test_glossary_terms_guard_the_result(spark):
    g = spark.createDataFrame([("a", "Loomery", 2, 1), ("a", "absent", 1, 1)], "doc_id string, term string, score int, count int")
    rows = [chunk("a", 0, "The Loomery opens."), chunk("a", 1, "Nothing.")]
    got = run(spark, rows, lambda p: p.split("\n\n")[-1].replace("Loomery", "weaver"), glossary=g)
    assert got["a", 0]["warnings"] == ["missing_glossary_terms"] and got["a", 1]["warnings"] == []


def test_preferred_outputs_are_what_counts(spark):
    """A result with the preferred output is right, one with the term itself isn't."""
    g = spark.createDataFrame([("a", "Loomery", "Weberei", 2, 1)], "doc_id string, term string, preferred_output string, score int, count int")
    rows = [chunk("a", 0, "The loomery opens."), chunk("a", 1, "A Loomery closes.")]
    got = run(spark, rows, lambda p: p.split("\n\n")[-1].replace("loomery", "Weberei"), glossary=g)
    assert [(got["a", k]["warnings"], got["a", k]["repairs"]) for k in (0, 1)] == [([], 0), (["missing_glossary_terms"], 1)]
    said = run(spark, rows, lambda p: p + " Weberei", glossary=g)
    assert "- Loomery => Weberei" in said["a", 0]["result"]


def test_sections_and_tails_go_along(spark):
    rows = [chunk("a", 0, "First one. Last one."), chunk("a", 1, "old", "superseded"), chunk("a", 2, "Second. 12,345 of it.")]
    got = run(spark, rows, lambda p: "## A title\n\n" + p)
    said = got["a", 2]["result"]
    assert "Previous section title:\nA title" in said and "Previous chunk tail:\nLast one." in said and "- 12,345" in said and "First one" not in said


def test_the_controller_ends_a_run(spark):
    """A slow answer within the canary, and a timeout before an answer, ask for a new plan; what they answered is kept."""
    ticks = lambda step: (lambda t: lambda: t.append(1) or len(t) * step)([])
    rows = [chunk("a", k, f"text {k}") for k in range(3)]
    slow = run(spark, rows, upper, Limits(rules=Rules(canary=2, threshold_ms=500)), clock=ticks(1.0))
    assert [(slow["a", k]["event"], slow["a", k]["status"]) for k in range(3)] == [("replan", "done"), ("", "pending"), ("", "pending")]
    assert slow["a", 0]["target"] == 750 and slow["a", 0]["autotune"] == "shrink" and slow["a", 0]["result"] == "TEXT 0"
    late = run(spark, rows, failing(1, RequestError("", None, "timeout")))
    assert [(late["a", k]["event"], late["a", k]["attempts"]) for k in range(3)] == [("replan", 2), ("", 0), ("", 0)]
    quick = run(spark, rows, upper, Limits(rules=Rules(window=2)), clock=ticks(0.001))
    assert [(quick["a", k]["autotune"], quick["a", k]["target"]) for k in range(3)] == [("", 1000), ("increase", 1100), ("", 1100)]
    down = run(spark, [chunk("a", k, f"text {k}") for k in range(5)], failing(99, RequestError("no", 401)), QUICK)
    assert [down["a", k]["event"] for k in range(5)] == ["failed", "stopped", "", "", ""]


def test_rules_of_a_worker_are_those_of_tables(spark):
    """Faults, lost anchors and the continuity block, one by one and as columns."""
    import itertools

    from loomtext.operators import anchors, quality, segments

    texts = ["", "short", "On 2024-01-02 at 10:30 we paid 12,500 to https://a.b/c,d v2.1 for 45%", "x" * 2500]
    results = ["", "s", "On 2024-01-02 at 10:30 we paid 12500 to https://a.b/c,d v2.1 for 45%", "We paid 12,500 to https://a.b/cd", "## T\n" + "x" * 2400, "译文 of it", "y" * 1300]
    rows = [(f"{a}-{b}", 0, t, r) for (a, t), (b, r) in itertools.product(enumerate(texts), enumerate(results))]
    df = spark.createDataFrame(rows, "doc_id string, id int, text string, result string")
    for task in ("quick_cleanup", "translate_only", "summarize"):
        table = {r["doc_id"]: r for r in quality.output_health(df, task).withColumn("a", anchors.extract("text", 8)).withColumn("gone", anchors.missing(F.col("a"), "result")).collect()}
        for d, _, t, r in rows:
            lost = anchors.lost(table[d]["a"]["ordered"], table[d]["a"]["numbers"], r)
            assert lost == table[d]["gone"]
            assert quality.faults(task, t, r, False, bool(lost)) == table[d]["retry_reasons"], (task, t, r)
    c = spark.createDataFrame([("a", 0, "done", "tail one", "Title"), ("a", 1, "done", " ", ""), ("a", 2, "done", "only tail", ""), ("a", 3, "done", "", "")], "doc_id string, id int, status string, tail_context_text string, last_section_title string")
    for r in segments.continuity(c).collect():
        assert r["context_text"] == segments.continuity_block(r["context_tail"], r["context_section"])


def test_run_results(spark):
    rows = [chunk("a", 0, "x y", "done", "X Y", "quick_cleanup"), chunk("a", 1, "good text"), chunk("b", 0, "long"), chunk("b", 1, "later")]

    def request(prompt):
        if "long" in prompt:
            raise RequestError("too large", 413)
        return upper(prompt)

    df = processing.process_chunks(spark.createDataFrame(rows, SCHEMA), request, "quick_cleanup", limits=QUICK, sleep=lambda s: None)
    got = {r["doc_id"]: r for r in processing.run_result(df).collect()}
    assert (got["a"]["processed_count"], got["a"]["skipped_count"], got["a"]["success"]) == (1, 1, True)
    assert (got["b"]["failed_count"], got["b"]["replan_required"], got["b"]["aborted"], got["b"]["success"]) == (1, True, True, False)
    e = processing.envelope(processing.run_result(df).withColumn("trace_id", F.lit("t")), "process-chunks").collect()
    assert {r["lifecycle_state"] for r in e} == {"processing", "failed_terminal"} and all(r["stage"] == "processing" and '"doc_id"' in r["result"] for r in e)


def test_a_new_plan_is_processed(spark):
    """A chunk that is too long is cut by a new plan, whose chunks are processed; other documents keep their results."""
    rows = [chunk("a", 0, "Short one."), chunk("a", 1, "First long. Second long. Third long."), chunk("b", 0, "Fine.")]

    def request(prompt):
        if len(prompt.split("\n\n")[-1]) > 20:
            raise RequestError("token limit", 400)
        return upper(prompt)

    df = spark.createDataFrame(rows, SCHEMA)
    got = processing.retry_until_planned(df, request, "quick_cleanup", lambda c: chunking.replan(c, None, 4, 10)[0], limits=QUICK, sleep=lambda s: None)
    out = {(r["doc_id"], r["id"]): (r["status"], r["result"]) for r in got.collect()}
    assert out["a", 0] == ("done", "SHORT ONE.") and out["a", 1][0] == "superseded" and out["b", 0] == ("done", "FINE.")
    assert [out["a", k] for k in sorted(k for d, k in out if d == "a" and k > 1)] == [("done", f"{n} LONG.") for n in ("FIRST", "SECOND", "THIRD")]


def test_prompts():
    build = processing.build_prompt
    assert build("Do it.\n## Input Text\n{RAW_TEXT}", "T", "before") == "Do it.\nbefore\n\n## Input Text\nT"
    assert build("Do it.\n## Input Text\n{RAW_TEXT}", "T", "before", "", "terms") == "Do it.\nterms\n\nbefore\n\n## Input Text\nT"
    assert build("Do it.", "T", "before") == "Do it.\n\nbefore\n\nT" and build("", "T") == "\n\nT" and build("See {STRUCTURED_TEXT}!", "T") == "See T!"
