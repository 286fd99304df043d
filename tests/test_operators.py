"""Sources and operators on small inputs with known results."""

import json

import pytest
from loomtext.operators import chunking, merge, planning, quality, runtime, telemetry
from loomtext.operators import segments as S
from loomtext.sources import records, settings, speech, subtitles
from loomtext.streaming import telemetry as stream
from pyspark.sql import functions as F

SEGMENTS = "doc_id string, id int, text string, start_time double, end_time double"


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


rows_of = rows


def test_vtt(spark):
    text = "WEBVTT\n\n00:00.000 --> 00:01.500\n我们下午去公园\n\n00:01.500 --> 00:03.000\n下午去公园看花吧\n\nbad --> line\nx\n\n00:03.000 --> 00:04.000\n<b></b>\n"
    docs = spark.createDataFrame([("a", text)], "doc_id string, text string")
    folded = subtitles.fold_cues(subtitles.cues(docs)).collect()[0]
    assert [s["text"] for s in folded["segments"]] == ["我们下午去公园", "看花吧"]
    d = folded["diagnostics"].asDict()
    assert (d["cue_count"], d["empty_cue_count"], d["overlap_trim_count"], d["overlap_trimmed_chars"], d["markup_tag_count"]) == (3, 1, 1, 5, 2)
    assert rows(subtitles.vtt_text(subtitles.vtt_segments(docs)), "text") == [("我们下午去公园看花吧",)]


def test_vtt_of_nothing(spark):
    docs = spark.createDataFrame([("a", None), ("b", "WEBVTT\n")], "doc_id string, text string")
    assert subtitles.vtt_segments(docs).collect() == []


def test_timestamps(spark):
    df = spark.createDataFrame([("01:02:03.5",), ("02:03,250",), ("x",), ("1:2:3:4",)], "x string")
    assert [r[0] for r in df.select(subtitles.timestamp_seconds(F.col("x"))).collect()] == [3723.5, 123.25, None, None]


def test_candidates(spark):
    df = spark.sql("SELECT 'a' AS doc_id, map('en', array(1), 'zh-Hans', array(1), 'fr', array(1)) AS subtitles, map('en-US', array(1), 'en', array(1)) AS automatic_captions")
    got = rows(subtitles.subtitle_candidates(df).orderBy("rank"), "language", "mode")
    assert got == [("zh-Hans", "manual"), ("en", "manual"), ("en-US", "auto")]


def test_speech_falls_back(spark):
    flat = {"results": {"channels": [{"alternatives": [{"transcript": "你 好 。"}]}]}}
    said = {"payload": {"results": {"utterances": [{"transcript": "hi", "start": 1.0, "end": 2.0, "speaker": 3}], "channels": [{"alternatives": [{"transcript": "flat"}]}]}}}
    df = spark.createDataFrame([("f", json.dumps(flat)), ("u", json.dumps(said)), ("x", "{}"), ("n", None)], "doc_id string, json string")
    p = speech.parse(df)
    got = {r["doc_id"]: (r["transcript"], r["source"]) for r in speech.transcripts(p).collect()}
    assert got == {"f": ("你好。", "transcript"), "u": ("hi", "utterances"), "x": ("", "none"), "n": ("", "none")}
    assert {r["doc_id"] for r in p.where("error IS NOT NULL").collect()} == {"x", "n"}


def test_records(spark):
    df = spark.createDataFrame([("a", '{"segments":[{"text":"x","start_time":"1.5"},{"id":7,"text":" "},{"id":"9","text":"y"}]}'), ("b", '[{"text":"z"}]'), ("c", "junk")], "doc_id string, json string")
    assert sorted(rows(records.load_segments(df), "doc_id", "id", "text", "start_time")) == [("a", 0, "x", 1.5), ("a", 9, "y", None), ("b", 0, "z", None)]
    events, faults = records.parse_events(spark.createDataFrame([(1, '{"command":"c","duration_ms":"12.5","success":"yes"}'), (2, "{bad"), (3, "[1]"), (4, " ")], "seq long, value string"))
    assert rows(events, "seq", "command", "duration_ms", "success") == [(1, "c", 0, True)]
    assert rows(faults, "malformed", "non_object") == [(1, 1)]


def test_settings():
    got, warnings = settings.load('# of a run\nllm_max_retries: 7 # more\nllm_timeout_sec: 0\nautotune_reduce_percent: 0.95\nllm_backoff_sec: soon\nenable_chunk_autotune: Yes\nllm_api_key: "a # b"\nchunk_mode: CHARS\nllm_stream: maybe\nchunk_tokens_quick_cleanup: 700\nother: 1\nno colon')
    assert (got["llm_max_retries"], got["llm_timeout_sec"], got["autotune_reduce_percent"], got["llm_backoff_sec"]) == (7, 120, 0.25, 1.5)
    assert (got["enable_chunk_autotune"], got["llm_api_key"], got["chunk_mode"], got["llm_stream"]) == (True, "a # b", "chars", "auto")
    assert (got["chunk_tokens_cleanup_zh"], got["chunk_tokens_structure_only"], got["output_ratio_cleanup_zh"]) == (700, 1200, 1.05)
    assert sorted(w.split("=")[0] for w in warnings) == ["autotune_reduce_percent", "llm_backoff_sec", "llm_timeout_sec"]
    assert settings.load("")[1] == [] and "other" not in got


def test_metadata_and_listed_chapters(spark):
    rows = [("a", '{"id":" v1 ","title":"T","duration":"61.9","channel":null}'), ("b", '{"title":"no id"}'), ("c", '{"id":"v3","duration":"NA"}'), ("d", "junk"), ("e", None)]
    df = spark.createDataFrame(rows, "doc_id string, json string")
    assert rows_of(records.video_metadata(df).orderBy("doc_id"), "video_id", "title", "duration", "channel") == [("v1", "T", 61, ""), ("v3", "", 0, "")]
    said = spark.createDataFrame([("a", "NA"), ("b", "null"), ("c", " "), ("d", None), ("e", "[]"), ("f", '[{"title":"x","start_time":1}]'), ("g", "ERROR: no"), ("h", '{"title":"x"}')], "doc_id string, output string")
    assert {r["doc_id"] for r in records.listed_chapters(said).where("has_chapters").collect()} == {"f"}


def test_chunk_documents_by_preferred_source(spark):
    seg = [(k, f"part {k}", k * 10.0, k * 10.0 + 9) for k in range(4)]
    df = spark.createDataFrame([("s", "", seg, "segments"), ("t", "One. Two.", seg, "text"), ("n", "Three.", None, "segments"), ("x", None, None, "text")], "doc_id string, text string, segments array<struct<id:int,text:string,start_time:double,end_time:double>>, preferred_chunk_source string")
    chapters = spark.createDataFrame([("s", 0, 0.0), ("s", 1, 20.0)], "doc_id string, chapter int, start_time double")
    got = chunking.chunk_documents(df, 100, 100, "chars", chapters).orderBy("doc_id", "chunk_id")
    assert rows_of(got, "doc_id", "source_kind", "content", "start_time") == [("n", "text", "Three.", None), ("s", "segments", "part 0\n\npart 1", 0.0), ("s", "segments", "part 2\n\npart 3", 20.0), ("t", "text", "One.\n\nTwo.", None)]


def test_report_with_glossary(spark):
    df = spark.createDataFrame([("a", "Say Alpha and beta.", "Alpha, Beta-2 and gamma."), ("b", "Nothing here.", "Nothing at all.")], "doc_id string, text string, raw string")
    g = spark.createDataFrame([("a", "Alpha", 3, 1), ("a", "Beta-2", 2, 1), ("b", "Alpha", 1, 1)], "doc_id string, term string, score int, count int")
    got = {r["doc_id"]: r for r in quality.verify_with_glossary(df, g).collect()}
    assert (got["a"]["glossary_selected_term_count"], got["a"]["glossary_drift_count"], got["a"]["glossary_preservation_ratio"]) == (2, 1, 0.5)
    assert "glossary_drift" in got["a"]["warnings"] and "glossary_drift" not in got["b"]["warnings"] and not got["b"]["glossary_drift_applicable"]


def test_subtitles_with_their_quality(spark):
    text = "WEBVTT\n\n" + "".join(f"00:{k:02d}.000 --> 00:{k + 1:02d}.000\n{'同一句话' if k < 20 else f'第{k}句话说完了。'}\n\n" for k in range(40))
    r = planning.normalize_subtitles(spark.createDataFrame([("a", text), ("b", None)], "doc_id string, text string")).collect()
    got = {x["doc_id"]: x for x in r}
    assert got["a"]["diagnostics"]["cue_count"] == 40 and len(got["a"]["segments"]) == 21 and got["a"]["subtitle_quality_score"] < 0.92
    assert "duplicate_cue_density_high" in got["a"]["subtitle_quality_reasons"] and got["a"]["text"].startswith("同一句话")


def test_repeats(spark):
    df = spark.createDataFrame([("a", 0, "x", 0.0, 1.0), ("a", 1, "x", 1.0, 3.0), ("a", 2, "y", 3.0, 4.0), ("a", 3, "x", 4.0, 5.0)], SEGMENTS)
    assert rows(S.merge_repeats(df).orderBy("id"), "id", "end_time", "merged") == [(0, 3.0, 2), (2, 4.0, 1), (3, 5.0, 1)]


def test_locate(spark):
    items = spark.createDataFrame([("a", 0, "", 0.0, 10.0), ("a", 1, "", 10.0, 20.0), ("a", 2, "", 25.0, 30.0)], SEGMENTS)
    points = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 9.9), ("a", 2, 22.0), ("a", 3, 30.1), ("a", 4, 99.0), ("a", 5, None), ("b", 6, 1.0)], "doc_id string, key int, t double")
    got = rows(S.locate(points, items).orderBy("key"), "matched_id", "strategy")
    assert got == [(0, "time_contains"), (1, "near_next_start"), (2, "next_segment"), (2, "near_last_end"), (2, "after_last_segment"), (0, "missing_time"), (None, "after_last_segment")]


def test_chunks_of_segments(spark):
    df = spark.createDataFrame([("a", 0, "A" * 30, 0.0, 10.0), ("a", 1, "B" * 30, 10.0, 20.0)], SEGMENTS)
    got = rows(chunking.chunk_segments(df, 35, 35, "chars").orderBy("chunk_id"), "start_time", "end_time", "content")
    assert got == [(0.0, 10.0, "A" * 30), (10.0, 20.0, "B" * 30)]
    df = spark.createDataFrame([("a", k, f"segment {k}", k * 10.0, k * 10.0 + 10) for k in range(3)], SEGMENTS)
    breaks = spark.createDataFrame([("a", 2)], "doc_id string, id int")
    got = rows(chunking.chunk_segments(df, 1000, 1000, "chars", breaks).orderBy("chunk_id"), "start_time", "end_time", "starts_chapter")
    assert got == [(0.0, 20.0, False), (20.0, 30.0, True)]


def test_small_chunks_join(spark):
    """A small chunk joins the one before it; one that begins a chapter only the chunk behind it."""
    sizes = [(0, 310, 3, False), (1, 12, 1, False), (2, 290, 3, False), (3, 7, 1, True), (4, 25, 1, False)]
    df = spark.createDataFrame([("a", *s) for s in sizes], "doc_id string, chunk_id int, size_ long, segments int, fresh boolean")
    got = dict(rows(chunking.coalesce_small(df, 600, 800), "chunk_id", "merged_id"))
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}


@pytest.mark.parametrize("mode,target,cap", [("chars", 60, 80), ("tokens", 15, 20)])
def test_chunks_keep_the_text_and_the_cap(spark, mode, target, cap):
    from loomtext.functions import text as T

    texts = ["One sentence here. Another one follows! A third? " * 4, "甲" * 150, "word " * 70, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    made = chunking.chunk_text(df, target, cap, mode).withColumn("size", T.estimate_tokens("content", mode)).orderBy("doc_id", "chunk_id").collect()
    assert all(r["size"] <= cap for r in made)
    for k, t in enumerate(texts):
        assert "".join("".join(r["content"] for r in made if r["doc_id"] == k).split()) == "".join(t.split())


def test_split_timed_shares_out_time(spark):
    df = spark.createDataFrame([("a", 0, "x" * 25, 0.0, 10.0), ("a", 1, "y", None, None)], SEGMENTS)
    got = rows(S.split_timed(df, 10).orderBy("id", "part_index"), "part_index", "start_time", "end_time")
    assert got == [(0, 0.0, 4.0), (1, 4.0, 8.0), (2, 8.0, 10.0), (None, None, None)]


def test_budget_fits():
    for task in (*chunking.TARGET, "another"):
        for prompt in (0, 500, 3000):
            b = chunking.solve_budget(task, prompt)
            assert 1 <= b.target <= b.hard_cap <= max(b.target, b.available) and b.output <= b.planned_output


def test_budgets_of_tasks():
    """Worked out by hand: a task with room, one that the prompt squeezes, one of no known name."""
    b = chunking.solve_budget("cleanup_zh", 500, reserve=60)
    assert (b.target, b.hard_cap, b.available, b.output, b.planned_output, b.effective) == (1000, 1330, 3840 - 560 - 1050 - 400, 1050, 1880, 3840)
    b = chunking.solve_budget("structure_only", 500)
    assert (b.target, b.hard_cap, b.available, b.output, b.planned_output, b.effective) == (720, 958, 1272, 828, 1380, 3000)
    b = chunking.solve_budget("another", 100, window=4096)
    assert (b.target, b.available, b.effective) == (1, 1, 491)


def test_sizes_of_plans():
    assert chunking.plan_sizes(size=500) == {"mode": "chars", "recommended": 8000, "target": 500, "cap": 500}
    assert chunking.plan_sizes("translate_only", mode="chars") == {"mode": "chars", "recommended": 3000, "target": 3000, "cap": 3000}
    assert chunking.plan_sizes("cleanup_zh", prompt_tokens=500, reserve=60) == {"mode": "tokens", "recommended": 1000, "target": 1000, "cap": 1330}
    assert chunking.plan_sizes("structure_only", 5000, prompt_tokens=500) == {"mode": "tokens", "recommended": 1200, "target": 1272, "cap": 1272}


def test_hashes_and_urls(spark, tmp_path):
    import hashlib

    from loomtext.functions import text as T

    df = spark.createDataFrame([({"b": "2", "a": "1", "c": None},)], "m map<string,string>")
    assert df.select(planning.state_hash(F.col("m"))).first()[0] == hashlib.sha256(b"a: 1\nb: 2\nc: ").hexdigest()
    (tmp_path / "f.txt").write_bytes(b"some bytes")
    r = records.file_hashes(spark, str(tmp_path)).first()
    assert (r["length"], r["sha256"]) == (10, hashlib.sha256(b"some bytes").hexdigest())
    urls = ["https://a.b/c d?x=1&y=é#z", "a;b(c)[d]~e%20", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(T.encode_url("u").alias("e")).collect()
    assert [r["e"] for r in got] == ["https://a.b/c%20d?x=1&y=%C3%A9#z", "a%3Bb%28c%29%5Bd%5D~e%20", ""]


def test_merge(spark):
    chunks = [("a", 0, "done", "## Start\n\n早上下了一场雨。\n\n街上没有人。"), ("a", 1, "done", "街上没有人。\n\n中午天晴了。"), ("a", 2, "superseded", "old"), ("a", 3, "failed", None)]
    df = spark.createDataFrame(chunks, "doc_id string, id int, status string, result string")
    r = merge.merge_chunks(df).collect()[0]
    assert r["text"].count("街上没有人。") == 1 and r["missing"] == [] and r["success"] and "old" not in r["text"]
    lost = merge.merge_chunks(df.withColumn("result", F.when(F.col("id") != 1, F.col("result")))).collect()[0]
    assert lost["missing"] == [1] and not lost["success"]
    heads = spark.createDataFrame([("a", 0, "Start", 0)], "doc_id string, chapter int, title string, start_chunk int")
    r = merge.merge_chunks(df, heads).collect()[0]
    assert r["text"].count("## Start") == 1 and r["diagnostics"]["heading_line_dedup_count"] >= 1


def test_merge_of_fragments(spark):
    df = spark.createDataFrame([("a", "这是一个没有结束的片段，\n\n接着说完。")], "doc_id string, text string")
    r = df.select(merge.clean_body("text").alias("c")).collect()[0]["c"]
    assert r["short_paragraph_merge_count"] == 1 and r["text"] == "这是一个没有结束的片段，\n接着说完。"


def test_replan(spark):
    df = spark.createDataFrame([("a", 0, "done", "A."), ("a", 1, "failed", "B b. C c."), ("a", 2, "pending", "D d.")], "doc_id string, id int, status string, text string")
    every, moved = chunking.replan(df, None, 3, 10)
    got = {(r["id"], r["status"]) for r in every.collect()}
    assert {(0, "done"), (1, "superseded"), (2, "superseded")} < got and min(i for i, s in got if s == "pending") == 3
    assert {r["old_id"] for r in moved.collect()} == {1, 2}


def test_subtitle_quality_is_critical(spark):
    counters = {"cue_count": 40, "empty_cue_count": 9, "exact_duplicate_cue_count": 8, "overlap_trim_count": 11, "overlap_collapsed_cue_count": 5, "markup_tag_count": 13, "nbsp_entity_count": 7, "collapsed_cjk_spacing_count": 15, "tightened_punctuation_spacing_count": 9, "tightened_bracket_spacing_count": 3}
    df = spark.createDataFrame([("a", "\n".join(["短句子啊"] * 12))], "doc_id string, text string").select("*", *[F.lit(v).alias(k) for k, v in counters.items()])
    r = quality.subtitle_quality(df).select("*", F.lit("youtube").alias("source"), F.lit("chinese").alias("mode"))
    r = planning.route(r).collect()[0]
    assert r["subtitle_quality_band"] == "critical" and r["subtitle_quality_score"] < 0.35 and r["reroute_target"] == "deepgram"


def test_telemetry(spark):
    df = spark.createDataFrame([(1, "a", "t", "d", "2024-01-01T00:00:00", 10, True, 0), (2, " ", "t", "", "2024-01-01T00:00:01", -5, False, 2), (3, "a", "u", None, "2024-01-01T00:00:02", 25, None, 0)], "seq long, command string, trace_id string, document_id string, timestamp string, duration_ms long, success boolean, warning_count int")
    s = telemetry.summary(df).collect()[0]
    assert (s["event_count"], s["success_count"], s["failure_count"], s["duration_ms_total"], s["duration_ms_avg"], s["duration_ms_max"]) == (3, 1, 2, 35, 11, 25)
    assert telemetry.count_map(df, "command", "unknown").collect()[0][0] == {"a": 2, "unknown": 1}
    assert [r["seq"] for r in telemetry.last_events(df, 2).collect()] == [2, 3]
    assert [r["seq"] for r in telemetry.matching(df, success=False).collect()] == [2, 3]
    assert telemetry.summary(df.limit(0)).collect()[0]["event_count"] == 0


def test_quirk_last_zero_events_is_all(spark):
    df = spark.range(3).withColumnRenamed("id", "seq")
    assert telemetry.last_events(df, 0).count() == 3


def test_autotune(spark):
    events = [("d", k, True, False, 10) for k in range(5)] + [("d", 5, False, True, None), ("d", 6, True, False, 999_999), ("d", 7, False, False, None)]
    df = spark.createDataFrame(events, "doc_id string, seq long, success boolean, timeout boolean, latency_ms long")
    got = rows(telemetry.autotune(df, "doc_id", "seq", start=1000, window=5).orderBy("seq"), "target", "event")
    assert got == [(1000, "")] * 4 + [(1100, "increase"), (825, "shrink"), (618, "shrink"), (618, "observe")]


def test_p95_is_nearest_rank(spark):
    df = spark.createDataFrame([(1, v) for v in range(1, 21)] + [(2, 0)], "g int, v int")
    assert dict(rows(telemetry.p95(df, "v", "g"), "g", "p95")) == {1: 19, 2: None}


def test_state_and_validation(spark):
    text = "# s\nurl: http://x: y\n- no: 1\ntitle: A\ntitle: B\n"
    df = spark.createDataFrame([("a", text), ("b", None)], "doc_id string, text string").select("doc_id", records.state_map("text").alias("fields"))
    got = {r["doc_id"]: r["fields"] for r in df.collect()}
    assert got == {"a": {"url": "http://x: y", "title": "B"}, "b": {}}
    got = {r["doc_id"]: r for r in planning.validate(df, "metadata", require=("mode", "url")).collect()}
    assert got["a"]["present"] == ["url", "title"] and got["a"]["missing"] == ["vid", "channel", "upload_date", "duration", "output_dir", "mode"]
    assert len(got["b"]["missing"]) == 8 and not got["b"]["passed"]
    full = dict.fromkeys(planning.REQUIRED["final"], "v")
    states = spark.createDataFrame([("ok", full), ("day", full | {"output_file": "t 20240115.md"}), ("vague", full | {"src": "UNKNOWN"})], "doc_id string, fields map<string,string>")
    assert {r["doc_id"]: (r["passed"], r["file_dates"], r["unknown"]) for r in planning.validate(states, "final").collect()} == {"ok": (True, [], []), "day": (False, ["20240115"], []), "vague": (False, [], ["src"])}
    assert planning.validate(df, require=("title",)).where("passed").count() == 1


def test_reach_of_long_chains_and_cycles(spark):
    edges = [(f"n{k}", f"n{k + 1}") for k in range(75)] + [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")]
    got = {(r["from_id"], r["to_id"]): r["hops"] for r in runtime.reachable(spark.createDataFrame(edges, "from_id string, to_id string")).collect()}
    want = {(f"n{a}", f"n{z}"): z - a for a in range(76) for z in range(a + 1, 76)}
    want |= {("a", "b"): 1, ("a", "c"): 1, ("a", "a"): 2, ("b", "c"): 1, ("b", "a"): 2, ("b", "b"): 3, ("c", "a"): 1, ("c", "b"): 2, ("c", "c"): 2}
    assert got == want


def test_decisions_and_artifacts(spark):
    names = "active_stage string, effective_status string, success boolean, passed boolean, paused boolean, aborted boolean, replan_required boolean, timeout boolean, reroute boolean, failed_count int, warning_count int"
    df = spark.createDataFrame([("verify", "", True, True, False, False, False, False, False, 0, 0), ("processing", "cancellation_requested", False, False, False, True, True, True, False, 1, 1), ("planning", None, None, None, None, None, None, None, True, None, None)], names)
    got = [(r["action"], r["confidence"]) for r in runtime.decide(runtime.policy(df)).collect()]
    assert got == [("accept_output", 0.95), ("request_human_escalation", 0.85), ("fallback_to_deepgram", 0.95)]
    asked = runtime.decide(runtime.policy(df.where("active_stage = 'planning'").withColumn("reroute", F.lit(False)).withColumn("evaluator_action", F.lit("request_human_escalation")))).collect()[0]
    assert (asked["action"], asked["confidence"], asked["decided_by"]) == ("request_human_escalation", 0.78, "rule")
    ranked = runtime.decide(runtime.policy(df.where("active_stage = 'planning'").withColumn("reroute", F.lit(False))), lambda a: F.lit("abort_run")).collect()[0]
    assert (ranked["action"], ranked["decided_by"]) == ("abort_run", "ranker")
    commands = spark.createDataFrame([("r", [("a", "t", "p", []), ("b", "t", "q", ["a"]), ("c", "t", "", ["b"])])], "run_id string, artifacts array<struct<artifact_id:string,type:string,path:string,parents:array<string>>>")
    nodes, edges = runtime.artifacts(commands)
    assert sorted(rows(nodes, "artifact_id")) == [("a",), ("b",)] and rows(edges, "from_id", "to_id") == [("a", "b")]


def test_stream(spark, tmp_path):
    lines = [{"command": "c", "timestamp": f"2024-01-01T{h:02d}:15:00", "duration_ms": 5, "success": True, "document_id": "d"} for h in (0, 0, 1, 5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\n{bad\n")
    q = stream.write(stream.windows(stream.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r["event_count"], r["duration_ms_total"]) for r in got][:2] == [(2, 10), (1, 5)]
