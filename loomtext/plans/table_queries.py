"""Queries on readers and normalisers whose inputs are made from whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import text as T
from ..operators import chunking, glossary, merge, packing, processing, quality, runtime
from ..operators import plans as plan_versions
from ..operators import segments as S
from ..sources import records, speech, subtitles
from .tables import KNOWN, TURNS, table, turns

Q: dict = {}
CJK = r"\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"


def query(sql: str | None = None):
    return lambda f: Q.setdefault(f.__name__, (f, sql)) and f


#: Some letters of a text as CJK characters, marks and brackets, so that all rules of spacing meet.
_LETTERS, _MARKS = "eaioust", "你好，（한）か"


def _all(expression: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        expression = f"regexp_replace({expression}, '{pattern}', '{to}', 'g')"
    return expression


_PAIR = (rf"([{CJK}])\s+([{CJK}])", r"\1\2")
_TIGHT = _all(
    f"translate(text, '{_LETTERS}', '{_MARKS}')",
    _PAIR,
    _PAIR,
    (rf"([{CJK}])\s+([{C.TIGHT_PUNCTUATION}])", r"\1\2"),
    (rf"([{C.OPENING}])\s+([{CJK}])", r"\1\2"),
    (rf"\s+([{C.TIGHT_PUNCTUATION}])", r"\1"),
    (rf"([{C.OPENING}])\s+", r"\1"),
    (rf"\s+([{C.CLOSING}])", r"\1"),
)


@query(f"SELECT conv_id, turn, {_TIGHT} AS out FROM conversations")
def cjk_spacing(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.tighten_spacing(F.translate("text", _LETTERS, _MARKS)).alias("out"))


@query()
def asr_normalise(spark, d):
    """Letters as ideographs and as the digits they are mistaken for; tests/test_tables.py has the rules in plain Python."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalize_speech(F.translate("text", "eaolsn", "你好015！")).alias("out"))


@query(r"""SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, 'Turn ' || turn || ' by ' || role || CASE WHEN turn % 3 < 2 THEN ' has ' || length(text) || ' characters' ELSE '' END AS text,
  CAST(turn * 4 AS DOUBLE) AS start_time, CAST(turn * 4 + 2 AS DOUBLE) AS end_time, sum(CASE WHEN turn % 3 < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS spaces FROM conversations""")
def vtt_notes(spark, d):
    """Cues of two lines; in each third a note with its blank line stands between them, in another the second line is missing."""
    at = lambda s: F.format_string("%02d:%02d:%02d.000", (s / 3600).cast("int"), (s / 60 % 60).cast("int"), (s % 60).cast("int"))
    more = F.concat(F.when(F.col("turn") % 3 == 1, "NOTE on it\nin lines\n\n").otherwise(""), F.lit("has "), F.length("text"), F.lit(" characters\n"))
    cue = F.concat(at(F.col("turn") * 4), F.lit(" --> "), at(F.col("turn") * 4 + 2), F.lit("\nTurn "), "turn", F.lit(" by "), "role", F.lit("\n"), F.when(F.col("turn") % 3 < 2, more).otherwise(""), F.lit("\n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"])
    docs = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(listed, "")).alias("text"))
    folded = subtitles.fold_cues(subtitles.cues(docs)).select("doc_id", F.col("diagnostics.inserted_ascii_space_count").cast("long").alias("spaces"), F.inline("segments"))
    return folded.select("doc_id", F.col("id").cast("long").alias("id"), "text", "start_time", "end_time", "spaces")


_SAID = r"'#' || turn || ' ' || trim(regexp_replace(regexp_replace(translate(text, '<>&', ''), '\s+', ' ', 'g'), ' +([,.!?;:])', '\1', 'g'))"


@query(f"""SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, {_SAID} AS text, CAST(turn * 4 AS DOUBLE) AS start_time, CAST(turn * 4 + CASE WHEN turn % 2 = 0 THEN 4 ELSE 2 END AS DOUBLE) AS end_time FROM conversations""")
def vtt_segments(spark, d):
    """Each conversation as a subtitle file, every second cue said twice."""
    at = lambda s: F.format_string("%02d:%02d:%02d.000", (s / 3600).cast("int"), (s / 60 % 60).cast("int"), (s % 60).cast("int"))
    said = F.concat(F.lit("#"), "turn", F.lit(" <i>"), F.btrim(F.regexp_replace(F.translate("text", "<>&", ""), r"\s+", " ")), F.lit("</i>"))
    cue = lambda a, z: F.concat(at(F.col("turn") * 4 + a), F.lit(" --> "), at(F.col("turn") * 4 + z), F.lit("\n"), said, F.lit("\n\n"))
    cues = F.concat(cue(0, 2), F.when(F.col("turn") % 2 == 0, cue(2, 4)).otherwise(""))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", cues.alias("c")))), lambda x: x["c"])
    files = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("WEBVTT\nKind: captions\n\nNOTE made by hand\n\n"), F.array_join(listed, "")).alias("text"))
    return subtitles.vtt_segments(files).select("doc_id", F.col("id").cast("long").alias("id"), "text", "start_time", "end_time")


def _recordings(spark, d):
    """Each conversation as the JSON of a recogniser: a paragraph and a word for each turn."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.btrim(F.regexp_replace("text", r"\s+", " ")).alias("text"), (F.col("role") == "user").cast("int").alias("speaker"))
    start = F.col("turn") * 5.0
    word = F.struct(F.concat(F.lit("w"), "turn").alias("word"), start.alias("start"), (start + 0.5).alias("end"), "speaker")
    part = F.struct("speaker", F.array(F.struct("text", start.alias("start"), (start + 4.5).alias("end")), F.struct(F.lit(" ").alias("text"), (start + 4.5).alias("start"), (start + 4.6).alias("end"))).alias("sentences"))
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("turn", x.alias("x")))), lambda s: s["x"])
    best = F.struct(F.lit("").alias("transcript"), listed(word).alias("words"), F.struct(listed(part).alias("paragraphs")).alias("paragraphs"))
    both = c.groupBy(F.col("conv_id").alias("doc_id")).agg(best.alias("best"))
    return both.select("doc_id", F.to_json(F.struct(F.struct(F.array(F.struct(F.array("best").alias("alternatives"))).alias("channels")).alias("results"))).alias("json"))


_WORDS = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""SELECT conv_id AS doc_id, count(*) AS paragraph_count, 2 * count(*) AS sentence_count, count(*) FILTER ({_WORDS} <> '') AS sentence_with_text_count, count(*) AS word_count, count(DISTINCT role = 'user') AS speaker_count,
  coalesce(string_agg({_WORDS}, chr(10) ORDER BY turn) FILTER ({_WORDS} <> ''), '') AS transcript, 'sentences' AS source FROM conversations GROUP BY 1""")
def speech_transcript(spark, d):
    p = speech.parse(_recordings(spark, d))
    counts = speech.inspect(p).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("paragraph_count", "sentence_count", "sentence_with_text_count", "word_count", "speaker_count")])
    return counts.join(speech.transcripts(p), "doc_id")


@query(f"""SELECT conv_id AS doc_id, 4 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, {_WORDS} AS text, turn * 5.0::DOUBLE + 10 AS start_time, turn * 5.0::DOUBLE + 14.5 AS end_time FROM conversations WHERE {_WORDS} <> ''""")
def speech_segments(spark, d):
    return speech.segments(speech.parse(_recordings(spark, d)), 10.0, 5).select("doc_id", F.col("id").cast("long").alias("id"), "text", "start_time", "end_time")


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS id, CASE turn % 5 WHEN 4 THEN 'superseded' WHEN 3 THEN 'done' WHEN 2 THEN 'pending' ELSE 'done' END AS status,
  CASE WHEN turn % 5 IN (0, 1, 4) THEN 'Turn ' || turn || ' by ' || role || ' has ' || length(text) || ' characters!' END AS result FROM conversations),
h AS (SELECT *, CASE WHEN id % 3 = 0 THEN chr(10) || chr(10) || '## Part ' || id || CASE id % 2 WHEN 0 THEN chr(10) || '## 第' || id || '章' ELSE '' END WHEN id % 3 = 1 THEN chr(10) || chr(10) || '## Only ' || id ELSE '' END AS head FROM c WHERE status <> 'superseded')
SELECT doc_id, 'Notes' || chr(10) || chr(10) || '---' || rtrim(string_agg(head || CASE WHEN result IS NOT NULL THEN chr(10) || chr(10) || result ELSE '' END, '' ORDER BY id)) AS text,
  CAST(count(*) FILTER (id % 3 < 2) AS BIGINT) AS chapters_inserted, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (status = 'done' AND result IS NULL), '') AS missing, count(*) FILTER (status = 'done' AND result IS NULL) = 0 AS success
FROM h GROUP BY doc_id""")
def merge_chapters(spark, d):
    """Headings in two languages, one for chunks without result too; of these only done ones are missing."""
    turn = F.col("turn")
    status = F.element_at(F.array(*map(F.lit, ("done", "done", "pending", "done", "superseded"))), (turn % 5 + 1).cast("int"))
    said = F.concat(F.lit("Turn "), "turn", F.lit(" by "), "role", F.lit(" has "), F.length("text"), F.lit(" characters!"))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), turn.cast("int").alias("id"), status.alias("status"), F.when((turn % 5).isin(0, 1, 4), said).alias("result"))
    part = F.concat(F.lit("Part "), "id")
    heads = c.where("id % 3 < 2").select("doc_id", F.col("id").alias("chapter"), F.when(F.col("id") % 3 == 0, "unused").otherwise(F.concat(F.lit(" Only "), "id")).alias("title"), F.when(F.col("id") % 3 == 0, part).alias("title_en"), F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, F.concat(F.lit("第"), "id", F.lit("章"))).otherwise(part)).alias("title_zh"), F.col("id").alias("start_chunk"))
    out = merge.merge_chunks(c, heads, header=" Notes  ")
    return out.select("doc_id", "text", "chapters_inserted", F.array_join(F.transform("missing", lambda i: i.cast("string")), ",").alias("missing"), "success")


@query("""SELECT conv_id AS doc_id, string_agg('Turn ' || turn || ' by ' || role || ' has ' || length(text) || ' characters!', chr(10) || chr(10) ORDER BY turn) FILTER (turn % 4 <> 3) AS text FROM conversations GROUP BY 1""")
def merge_concat(spark, d):
    """Chunks without faults are put together as they are; every fourth is superseded."""
    said = F.concat(F.lit("Turn "), "turn", F.lit(" by "), "role", F.lit(" has "), F.length("text"), F.lit(" characters!"))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("id"), F.when(F.col("turn") % 4 == 3, "superseded").otherwise("done").alias("status"), said.alias("result"))
    return merge.merge_chunks(c).select("doc_id", "text")


@query(rf"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_transform(t, lambda x: lower(x)), ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[{CJK}]') AS t FROM documents)""")
def quality_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.quality_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"))


@query(r"""WITH p AS (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS k FROM documents), q AS (SELECT doc_id, k, regexp_replace(substr(text, CAST(k * 500 + 1 AS BIGINT), 500), '^\s+|\s+$', '', 'g') AS s FROM p)
SELECT doc_id, count(*) AS pieces, md5(string_agg(s, chr(1) ORDER BY k)) AS content FROM q WHERE s <> '' GROUP BY doc_id""")
def hard_split(spark, d):
    p = table(spark, d, "documents").select("doc_id", T.hard_split("text", 500).alias("p")).where("size(p) > 0")
    return p.select("doc_id", F.size("p").cast("long").alias("pieces"), F.md5(F.array_join("p", "\x01").cast("binary")).alias("content"))


@query("""WITH units AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS u FROM documents
), folded AS (
  SELECT doc_id, list_reduce(list_transform(u, lambda s: {'o': CAST([] AS VARCHAR[]), 'c': s}),
    lambda a, x: CASE WHEN length(a.c) + length(x.c) + 2 > 2000 THEN {'o': list_append(a.o, a.c), 'c': x.c} ELSE {'o': a.o, 'c': a.c || chr(10) || chr(10) || x.c} END) AS f FROM units WHERE len(u) > 0
), chunks AS (SELECT doc_id, list_append(f.o, f.c) AS s FROM folded)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_id, CAST(length(s[i]) AS BIGINT) AS chars, md5(s[i]) AS content FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM chunks)""")
def pack_lines(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.btrim(s)), lambda s: s != "")
    packed = table(spark, d, "documents").select("doc_id", chunking.pack(lines, 2000, 2000, "chars", tokens=False).alias("c"))
    return T.exploded(packed, "c", "chunk_id", "p").select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("p.chars").cast("long").alias("chars"), F.md5(F.col("p.content").cast("binary")).alias("content"))


@query("""WITH RECURSIVE lines AS (SELECT source, doc_id, unnest(u) AS s, unnest(range(len(u))) AS k FROM (
  SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS u FROM documents)),
units AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, k) - 1 AS pos, length(s) + 2 AS w FROM lines),
sums AS (SELECT source, pos, sum(w) OVER (PARTITION BY source ORDER BY pos) AS reach, w FROM units),
after AS (SELECT a.source, a.pos, min(b.pos) AS next FROM sums a LEFT JOIN sums b ON b.source = a.source AND b.pos > a.pos AND b.reach > a.reach - a.w + 2002 GROUP BY 1, 2),
c AS (SELECT source, pos, next, 0 AS chunk FROM after WHERE pos = 0 UNION ALL SELECT a.source, a.pos, a.next, c.chunk + 1 FROM c JOIN after a ON a.source = c.source AND a.pos = c.next)
SELECT c.source, CAST(chunk AS BIGINT) AS chunk, c.pos AS first, coalesce(next, n) - c.pos AS units FROM c JOIN (SELECT source, count(*) AS n FROM units GROUP BY 1) z ON z.source = c.source""")
def pack_rows(spark, d):
    """All lines of a source as one document, whose units are rows."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.btrim(s)), lambda s: s != "")
    t = table(spark, d, "documents").select("source", "doc_id", lines.alias("u"))
    before = F.sum(F.size("u")).over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    units = t.withColumn("base", F.coalesce(before, F.lit(0))).select(F.col("source").alias("doc_id"), "base", F.posexplode("u").alias("k", "s"))
    return packing.pack_rows(units.select("doc_id", (F.col("base") + F.col("k")).alias("pos"), F.length("s").alias("size")), 2000, 2).withColumnRenamed("doc_id", "source").withColumn("chunk", F.col("chunk").cast("long"))


def _answer(prompt: str) -> str:
    """Stands for a model: the text in upper case; some texts are too long for it, and some answers lose most of the text."""
    text = prompt.split("\n\n")[-1]
    if "of length 7" in text:
        raise processing.RequestError("too large", 413)
    return text.upper() if "of length 5" not in text else text[:9].upper()


@query("""WITH t AS (SELECT conv_id AS doc_id, turn AS id, 'Turn ' || turn || ' by ' || role || ' of length ' || length(text) AS text FROM conversations),
e AS (SELECT *, min(id) FILTER (contains(text, 'of length 7')) OVER (PARTITION BY doc_id) AS last FROM t), d AS (SELECT *, id % 4 = 1 AS had, contains(text, 'of length 5') AS half FROM e)
SELECT doc_id, CAST(id AS BIGINT) AS id, CASE WHEN had THEN 'done' WHEN id > last THEN 'pending' WHEN id = last THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN had THEN 'kept' WHEN id >= last THEN NULL WHEN half THEN upper(left(text, 9)) ELSE upper(text) END AS result,
  CASE WHEN had THEN 'skipped' WHEN id > last THEN '' WHEN id = last THEN 'replan' WHEN half THEN 'accepted_with_warnings' ELSE 'done' END AS event,
  CAST(CASE WHEN had OR id > last THEN 0 WHEN id = last THEN 1 WHEN half THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM (SELECT doc_id, id, text, half, had, min(CASE WHEN NOT had THEN CASE WHEN contains(text, 'of length 7') THEN id END END) OVER (PARTITION BY doc_id) AS last FROM d)""")
def processed_chunks(spark, d):
    """Turns sent to a function in place of a model; every fourth is done already."""
    had = F.col("turn") % 4 == 1
    said = F.concat(F.lit("Turn "), "turn", F.lit(" by "), "role", F.lit(" of length "), F.length("text"))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("id"), F.when(had, "done").otherwise("pending").alias("status"), said.alias("text"), F.when(had, "kept").alias("result"), F.lit("quick_cleanup").alias("prompt_name"), F.lit("raw_path").alias("input_key"))
    out = processing.process_chunks(c, _answer, "quick_cleanup", limits=processing.Limits(repair_backoff_sec=0.0))
    return out.select("doc_id", F.col("id").cast("long").alias("id"), "status", "result", "event", F.col("attempts").cast("long").alias("attempts"))


#: Three plans: the first moves every second chunk by 100, each later one every second of those it finds.
_MOVES = " UNION ALL ".join(f"SELECT conv_id AS doc_id, turn + {100 * v} AS old_id, turn + {100 * v + 100} AS new_id FROM conversations WHERE turn % {2 ** (v + 1)} = 0" for v in range(3))


@query(f"""WITH RECURSIVE m AS ({_MOVES}), way AS (SELECT conv_id AS doc_id, turn AS chapter, turn AS place FROM conversations UNION ALL SELECT w.doc_id, w.chapter, m.new_id FROM way w JOIN m ON m.doc_id = w.doc_id AND m.old_id = w.place)
SELECT doc_id, chapter, max(place) AS start_chunk, CASE WHEN max(place) > chapter THEN chapter END AS original_start_chunk FROM way GROUP BY 1, 2""")
def remap_over_versions(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chapter"), F.col("turn").alias("start_chunk"))
    moves = [c.where(F.col("chapter") % 2 ** (v + 1) == 0).select("doc_id", (F.col("chapter") + 100 * v).alias("old_id"), (F.col("chapter") + 100 * v + 100).alias("new_id")) for v in range(3)]
    return plan_versions.remap_over_versions(c, moves[0].unionByName(moves[1]).unionByName(moves[2])).select("doc_id", "chapter", "start_chunk", "original_start_chunk")


@query("""SELECT conv_id AS doc_id, 'p' || turn AS plan_id, CASE WHEN turn > 0 THEN 'p' || (turn - 1) END AS prior_plan_id, turn AS version, 'p0' AS first_plan_id, 'p' || max(turn) OVER (PARTITION BY conv_id) AS current_plan_id,
  CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN 'p' || (turn + 1) END AS superseded_by FROM conversations""")
def plan_chain(spark, d):
    """Each turn of a conversation as a plan that supersedes that of the turn before."""
    plan = lambda n: F.concat(F.lit("p"), n.cast("string"))
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), plan(F.col("turn")).alias("plan_id"), F.when(F.col("turn") > 0, plan(F.col("turn") - 1)).alias("prior_plan_id"))
    return plan_versions.chain(p)


@query(rf"""WITH {TURNS}, p AS (SELECT *, CASE WHEN length(text) > 100 THEN list_filter(list_transform(range(0, (length(text) + 99) // 100), lambda k: regexp_replace(substr(text, k * 100 + 1, 100), '^\s+|\s+$', '', 'g')), lambda s: s <> '') ELSE [text] END AS parts FROM turns),
q AS (SELECT *, unnest(range(1, len(parts) + 1)) AS k, list_sum(list_transform(parts, lambda s: length(s))) AS total FROM p),
b AS (SELECT *, CAST(coalesce(list_sum(list_transform(parts[1 : k - 1], lambda s: length(s))), 0) AS DOUBLE) AS before, length(parts[k]) AS n FROM q)
SELECT doc_id, CAST(id AS BIGINT) AS id, CASE WHEN len(parts) > 1 THEN CAST(k - 1 AS BIGINT) END AS part_index, CAST(n AS BIGINT) AS chars,
  CASE WHEN length(text) > 100 THEN round(start_time + before / total * (end_time - start_time), 3) ELSE start_time END AS start_time, CASE WHEN length(text) > 100 THEN round(start_time + (before + n) / total * (end_time - start_time), 3) ELSE end_time END AS end_time FROM b""")
def prorate_times(spark, d):
    s = S.split_timed(turns(spark, d), 100, "chars")
    return s.select("doc_id", F.col("id").cast("long").alias("id"), F.col("part_index").cast("long").alias("part_index"), F.length("text").cast("long").alias("chars"), "start_time", "end_time")


def _segments_json(spark, d):
    """Each conversation as segment JSON: odd ones as a bare array, every fifth entry without an id, empty texts as they come."""
    c = table(spark, d, "conversations").withColumn("text", F.btrim(F.regexp_replace("text", r"\s+", " ")))
    entry = F.struct(F.when(F.col("turn") % 5 != 4, F.col("turn") + 100).alias("id"), F.when(F.col("turn") % 7 == 6, " ").otherwise(F.col("text")).alias("text"), (F.col("turn") * 2.5).cast("string").alias("start_time"), (F.col("turn") * 2.5 + 2).alias("end_time"), F.col("role").alias("speaker"))
    listed = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"]).alias("segments"))
    return listed.select(F.col("conv_id").alias("doc_id"), F.when(F.col("conv_id") % 2 == 1, F.to_json("segments")).otherwise(F.to_json(F.struct("segments"))).alias("json"))


@query(f"""SELECT conv_id AS doc_id, CASE WHEN turn % 5 <> 4 THEN turn + 100 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 END AS id, {_WORDS} AS text, turn * 2.5::DOUBLE AS start_time, turn * 2.5::DOUBLE + 2 AS end_time, role AS speaker
FROM conversations QUALIFY turn % 7 <> 6 AND {_WORDS} <> ''""")
def segment_json(spark, d):
    s = records.load_segments(_segments_json(spark, d))
    return s.select("doc_id", F.col("id").cast("long").alias("id"), "text", "start_time", "end_time", "speaker")


@query("""SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chapter, role || ' ' || turn AS title, CASE WHEN turn % 2 = 0 THEN '第' || turn || '章' END AS title_zh, turn * 60.0::DOUBLE AS start_time, CASE WHEN turn % 3 <> 0 THEN turn * 60.0::DOUBLE + 59.5 END AS end_time FROM conversations""")
def chapter_json(spark, d):
    c = table(spark, d, "conversations")
    entry = F.struct(F.concat_ws(" ", "role", "turn").alias("title"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("第"), "turn", F.lit("章"))).alias("title_zh"), (F.col("turn") * 60).alias("start_time"), F.when(F.col("turn") % 3 == 0, "soon").otherwise((F.col("turn") * 60 + 59.5).cast("string")).alias("end_time"))
    listed = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"]).alias("chapters"))
    got = records.load_chapters(listed.select("doc_id", F.to_json(F.struct("chapters")).alias("json")))
    return got.select("doc_id", F.col("chapter").cast("long").alias("chapter"), "title", "title_zh", "start_time", "end_time")


@query("""SELECT event_id AS seq, event_type AS command, CAST(user_id AS VARCHAR) AS document_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS duration_ms, event_id % 3 <> 0 AS success, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id % 6 END AS warning_count
FROM events WHERE event_id % 10 NOT IN (7, 8, 9)""")
def event_log(spark, d):
    """A log of JSON lines with broken ones, ones that are no objects, blank ones, and numbers and truths of several spellings."""
    e = table(spark, d, "events")
    spelled = F.when(F.col("event_id") % 3 == 0, F.element_at(F.array(*map(F.lit, ("no", "0", "False"))), (F.expr("event_id div 3 % 3") + 1).cast("int"))).otherwise("Yes")
    line = F.to_json(F.struct(F.col("event_type").alias("command"), F.col("user_id").cast("string").alias("document_id"), F.when(F.col("event_id") % 4 == 0, "-5").otherwise(F.floor("value").cast("string")).alias("duration_ms"), spelled.alias("success"), (F.col("event_id") % 6).alias("warning_count")))
    value = F.when(F.col("event_id") % 10 == 7, "{broken").when(F.col("event_id") % 10 == 8, "[1, 2]").when(F.col("event_id") % 10 == 9, "  ").otherwise(line)
    events, _ = records.parse_events(e.select(F.col("event_id").alias("seq"), value.alias("value")))
    return events.select("seq", "command", "document_id", "duration_ms", "success", "warning_count")


@query("SELECT count(*) FILTER (event_id % 10 = 7) AS malformed, count(*) FILTER (event_id % 10 = 8) AS non_object FROM events")
def event_log_faults(spark, d):
    value = F.when(F.col("event_id") % 10 == 7, "{broken").when(F.col("event_id") % 10 == 8, "[1, 2]").when(F.col("event_id") % 10 == 9, "  ").otherwise("{}")
    return records.parse_events(table(spark, d, "events").select(F.col("event_id").alias("seq"), value.alias("value")))[1]


@query("""SELECT page_id AS doc_id, 'v' || page_id AS video_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS title, CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN length(html) WHEN 2 THEN 0 ELSE length(html) // 2 END AS duration, '' AS channel FROM pages WHERE page_id % 5 <> 0""")
def video_metadata(spark, d):
    kind = F.col("page_id") % 4
    seconds = F.when(kind == 0, "NA").when(kind == 1, F.length("html").cast("string")).when(kind == 3, (F.length("html") / 2).cast("string"))
    j = F.to_json(F.struct(F.when(F.col("page_id") % 5 == 0, " ").otherwise(F.concat(F.lit(" v"), "page_id")).alias("id"), F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("title"), seconds.alias("duration")))
    return records.video_metadata(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), j.alias("json"))).select("doc_id", "video_id", "title", "duration", "channel")


@query("SELECT page_id AS doc_id, page_id % 6 = 5 AS has_chapters, CASE WHEN page_id % 6 = 5 THEN url END AS first FROM pages")
def listed_chapters(spark, d):
    some = F.to_json(F.array(F.struct(F.col("url").alias("title"), F.lit(0).alias("start_time"))))
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.coalesce(F.get(F.array(*map(F.lit, ("NA", "null", " None ", "[]", "ERROR: gone"))), (F.col("page_id") % 6).cast("int")), some).alias("output"))
    return records.listed_chapters(p).select("doc_id", "has_chapters", F.get("chapters", F.lit(0))["title"].alias("first"))


@query(rf"""SELECT doc_id, 'upload' AS source_type, regexp_replace(text, '[ \t\r\f\v]+(\n|$)', '\1', 'g') AS text FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS text FROM documents)""")
def normalized_json(spark, d):
    """Documents as stored JSON, read again and normalised as what isn't subtitles."""
    j = F.to_json(F.struct(F.struct(F.lit("upload").alias("type")).alias("source"), F.struct(F.lit("mono").alias("mode")).alias("workflow"), F.struct("text").alias("content")))
    return records.load_documents(table(spark, d, "documents").select("doc_id", j.alias("json"))).select("doc_id", "source_type", "text")


@query("SELECT conv_id AS doc_id, turn AS id FROM conversations WHERE turn % 5 NOT IN (1, 3)")
def pending_chunks(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("pending", "done", "interrupted", "superseded", "failed"))), (F.col("turn") % 5 + 1).cast("int"))
    return runtime.pending(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), status.alias("status"))).select("doc_id", "id")


_TERMS = ("the", "and", "no such term")


@query(r"""WITH d AS (SELECT doc_id, lower(text) AS t, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS r FROM documents), k AS (SELECT doc_id, unnest(['the', 'and', 'no such term']) AS term, t, r FROM d),
c AS (SELECT doc_id, regexp_matches(t, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') AS chosen, regexp_matches(r, '(^|[^A-Za-z0-9])' || term || '($|[^A-Za-z0-9])') AS kept FROM k)
SELECT doc_id, count(*) FILTER (chosen) AS selected, count(*) FILTER (chosen AND NOT kept) AS lost, count(*) FILTER (chosen AND NOT kept) = 0 AS ok FROM c GROUP BY 1""")
def glossary_report(spark, d):
    """The report on documents a third of which have lost all their text."""
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"), F.col("text").alias("raw"))
    g = glossary.listed(spark, [(x, 3 - k, 1) for k, x in enumerate(_TERMS)], KNOWN)
    r = quality.verify_with_glossary(t, g, by=None)
    return r.select("doc_id", F.col("glossary_selected_term_count").cast("long").alias("selected"), F.col("glossary_drift_count").cast("long").alias("lost"), F.col("glossary_drift_ok").alias("ok"))
