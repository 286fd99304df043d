"""Merging chunk results into documents, and assembling the finished text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_COUNTERS = ("duplicate_body_blocks_removed", "seam_overlap_trim_count", "seam_overlap_trimmed_chars", "short_paragraph_merge_count", "duplicate_heading_block_count", "heading_line_dedup_count")


def _without_headings(previous: Column, block: Column) -> Column:
    """struct(text, removed): block without the leading heading lines that previous has too, and blank ones between."""
    known = F.transform(F.split(previous, "\n"), T.strip)
    lines = F.split(block, "\n")
    kept = F.transform(lines, lambda s: ~((T.strip(s) == "") | (T.strip(s).startswith("#") & F.array_contains(known, T.strip(s)))))
    first = F.array_position(kept, F.lit(True)).cast("int")
    n = F.when(first > 0, first - 1).otherwise(F.size(lines))
    return F.struct(T.strip(F.array_join(F.slice(lines, n + 1, F.size(lines)), "\n")).alias("text"), n.alias("removed"))


def _step(a: Column, raw: Column) -> Column:
    last = F.coalesce(F.try_element_at(a["out"], F.lit(-1)), F.lit(""))
    some = F.size(a["out"]) > 0
    after_heading = some & (T.block_type(last) == "heading")
    start = F.when(after_heading, _without_headings(last, raw)).otherwise(F.struct(raw.alias("text"), F.lit(0).alias("removed")))

    def typed(h: Column) -> Column:
        return F.struct(h["text"].alias("text"), h["removed"].alias("removed"), T.block_type(h["text"]).alias("kind"), T.block_type(last).alias("before"), (T.collapse(h["text"]) == T.collapse(last)).alias("same"))

    def judged(b: Column) -> Column:
        bodies = some & (b["kind"] == "body") & (b["before"] == "body")
        overlap = F.when(bodies & ~b["same"], T.leading_overlap_in_fold(last, b["text"])).otherwise("")

        def cut(o: Column) -> Column:
            n = F.when(T.is_strong_seam(o), F.length(o)).otherwise(0)
            rest = F.when(n > 0, T.lstrip(F.substr(b["text"], n + 1))).otherwise(b["text"])
            return F.struct(n.alias("n"), rest.alias("rest"))

        def made(c: Column) -> Column:
            gone_heading = b["text"] == ""
            twin_heading = some & (b["kind"] == "heading") & (b["before"] == "heading") & b["same"]
            twin_body = bodies & b["same"]
            emptied = bodies & ~b["same"] & (c["rest"] == "")
            joins = bodies & ~b["same"] & ~emptied & (F.length(last) + F.length(c["rest"]) <= 280) & T.is_incomplete(last)
            out = (
                F.when(gone_heading | twin_heading | twin_body | emptied, a["out"])
                .when(joins, F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.concat(T.rstrip(last), F.lit("\n"), T.lstrip(c["rest"])))))
                .otherwise(F.concat(a["out"], F.array(c["rest"])))
            )
            flag = lambda x: x.cast("int")
            more = (flag(twin_body | emptied), flag(c["n"] > 0), c["n"], flag(joins), flag(twin_heading), b["removed"])
            return F.struct(out.alias("out"), *[(a[k] + m).alias(k) for k, m in zip(_COUNTERS, more, strict=True)])

        return T.let(overlap, lambda o: T.let(cut(o), made))

    folded = T.let(start, lambda h: T.let(typed(h), judged))
    return F.when(T.block_type(raw) == "seam", a).otherwise(folded)


def clean_body(x: Column | str) -> Column:
    """struct(text, counters): a merged body with its seams cleaned.

    Blocks are folded in order: seam marks go, headings and bodies that repeat the one before go, strong overlaps
    with the block before are cut, and a short block that doesn't end a sentence takes the next one in.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), *[F.lit(0).alias(k) for k in _COUNTERS])
    done = F.aggregate(T.blocks(x), start, _step)

    def joined(d: Column) -> Column:
        text = F.array_join(F.transform(d["out"], T.strip), "\n\n")
        return F.struct(T.strip(T.sub(text, r"\n{3,}", "\n\n")).alias("text"), *[d[k].alias(k) for k in _COUNTERS], T.count(text, r"\n{3,}").alias("blank_line_groups_collapsed"))

    return T.let(done, joined)


def header_of(header: str) -> str:
    """A text before a merged body: lines without white space at their ends, and a rule behind, if it has none."""
    text = "\n".join(line.rstrip() for line in header.replace("\r\n", "\n").replace("\r", "\n").split("\n")).strip()
    return text if not text or text.endswith("---") else f"{text}\n\n---"


def headings(chapters: DataFrame) -> DataFrame:
    """(doc_id, id, head, n): the headings of the chapters (doc_id, chapter, title[, title_en, title_zh], start_chunk) that begin in chunk id.

    A chapter's heading is its English title, then its Chinese one if that differs; the title only where both are blank. One
    without any has no heading; n counts those with.
    """
    stripped = lambda c: T.strip(T.text_of(c)) if c in chapters.columns else F.lit("")
    en, zh, title = stripped("title_en"), stripped("title_zh"), stripped("title")
    named = F.filter(F.array_distinct(F.array(en, zh)), lambda t: t != "")
    lines = F.when(F.size(named) > 0, named).when(title != "", F.array(title)).otherwise(F.array().cast("array<string>"))
    head = F.array_join(F.transform(lines, lambda t: F.concat(F.lit("## "), t)), "\n")
    own = chapters.where("start_chunk IS NOT NULL").select("doc_id", F.col("start_chunk").cast("bigint").alias("id"), "chapter", head.alias("h")).where("h <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chapter", "h"))), lambda s: s["h"])
    return own.groupBy("doc_id", "id").agg(F.array_join(ordered, "\n\n").alias("head"), F.count(F.lit(1)).alias("n"))


def merge_chunks(chunks: DataFrame, chapters: DataFrame | None = None, header: str = "") -> DataFrame:
    """(doc_id, text, diagnostics, missing, chapters_inserted, success, total_chars, total_lines) from chunks (doc_id, id, status, result) and chapters (see headings).

    Active chunks in order of id, each behind the headings of the chapters that begin in it, whether it has a result or not, with a seam mark
    behind each result; then the body is cleaned (clean_body), and the header put before it. missing lists the ``done`` chunks without result: others
    may still come, and don't make a run fail. total_lines counts line ends.
    """
    active = chunks.where("status <> 'superseded'").withColumn("_id", F.col("id").cast("bigint"))
    if chapters is not None:
        active = active.join(headings(chapters).withColumnRenamed("id", "_id"), ["doc_id", "_id"], "left")
    else:
        active = active.withColumn("head", F.lit(None).cast("string")).withColumn("n", F.lit(None).cast("long"))
    has = F.col("result").isNotNull()
    piece = F.concat(F.coalesce(F.concat(F.lit("\n\n"), "head", F.lit("\n\n")), F.lit("")), F.when(has, F.concat("result", F.lit(f"\n\n{T.SEAM}\n\n"))).otherwise(""))
    merged = active.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", piece.alias("p")))), lambda s: s["p"]), "").alias("body"),
        F.array_sort(F.collect_list(F.when(~has & (F.lower(F.btrim("status")) == "done"), F.col("id")))).alias("missing"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("chapters_inserted"),
    )
    merged = merged.withColumn("_d", clean_body("body"))
    front = header_of(header)
    text = F.concat_ws("\n\n", F.lit(front or None), F.nullif(F.col("_d.text"), F.lit("")))
    counters = F.struct(*[F.col(f"_d.{k}").alias(k) for k in (*_COUNTERS, "blank_line_groups_collapsed")])
    out = merged.select("doc_id", text.alias("text"), counters.alias("diagnostics"), "missing", "chapters_inserted", (F.size("missing") == 0).alias("success"))
    return out.withColumn("total_chars", F.length("text")).withColumn("total_lines", F.length("text") - F.length(F.translate("text", "\n", "")))


def assemble(docs: DataFrame) -> DataFrame:
    """(doc_id, content, total_chars, total_lines): the final document, front matter, heading, body and foot.

    docs: (doc_id, title, channel, upload_date, created, url, duration in seconds, transcript_source, bilingual, text). An empty
    upload_date has no line.
    """
    one_line = lambda c: T.collapse(T.text_of(c))
    minutes = F.greatest(F.floor(F.coalesce(F.col("duration").try_cast("bigint"), F.lit(0)) / 60), F.lit(0)).cast("string")
    both, source = F.coalesce("bilingual", F.lit(False)), T.text_of("transcript_source")
    line = lambda k, v: F.concat(F.lit(f"{k}: "), T.yaml_scalar(v))
    date = T.frontmatter_date(T.strip(T.text_of("upload_date")))
    front = F.concat_ws(
        "\n",
        F.lit("---"),
        line("title", "title"),
        line("source", "url"),
        line("url", "url"),
        line("channel", "channel"),
        line("author", "channel"),
        F.when(date != "", line("date", date)),
        line("created", T.frontmatter_date(T.strip(T.text_of("created")))),
        F.lit("type: video-transcript"),
        F.concat(F.lit("bilingual: "), both.cast("string")),
        line("duration", F.concat(minutes, F.lit("m"))),
        line("transcript_source", "transcript_source"),
        F.lit("tags: [youtube, video-transcript]"),
        F.lit('via: "youtube"'),
        F.lit("---"),
    )
    head = F.concat_ws(
        "\n",
        F.lit(""),
        F.concat(F.lit("# "), T.escape_markdown(one_line("title"))),
        F.lit(""),
        F.concat(F.lit("> Video source: [YouTube - "), T.escape_markdown(one_line("channel")), F.lit("]("), T.encode_url(one_line("url")), F.lit(")")),
        F.concat(F.lit("> Language mode: "), F.when(both, "Bilingual").otherwise("Chinese")),
        F.concat(F.lit("> Duration: "), minutes, F.lit(" minutes")),
        *map(F.lit, ("", "---", "")),
    )
    foot = F.concat_ws("\n", *map(F.lit, ("", "---", "")), F.concat(F.lit("*This article was generated by AI voice transcription ("), source, F.lit("), for reference only.*")), F.lit(""))
    made = docs.select("doc_id", F.concat_ws("\n", front, F.concat(head, T.strip(T.text_of("text"))), foot).alias("content"))
    return made.select("doc_id", "content", F.length("content").alias("total_chars"), (F.length("content") - F.length(F.translate("content", "\n", "")) + 1).alias("total_lines"))
