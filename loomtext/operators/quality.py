"""Quality of texts: repeated phrases, CJK readability, subtitle quality, and the report on a finished document."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import folds, scan
from ..functions import text as T
from . import anchors as A
from . import glossary as G


def duplicate_ngrams(paragraphs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, windows, duplicates, ratio) from paragraphs (doc_id, text): runs of n tokens that hold two different ones; none reaches over a paragraph's end.

    A document's paragraphs come together in a row, and its runs are numbered and counted there (scan.repeated_runs); no run leaves the row.
    """
    counted = paragraphs.groupBy("doc_id").agg(F.collect_list(T.text_of("text")).alias("t")).select("doc_id", scan.run_counts(F.col("t"), n).alias("c"))
    whole = counted.select("doc_id", F.col("c.runs").cast("long").alias("windows"), F.col("c.repeats").cast("long").alias("duplicates"))
    return whole.withColumn("ratio", F.when(F.col("windows") > 0, F.round(F.col("duplicates") / F.col("windows"), 3)).otherwise(F.lit(0.0)))


def ngram_metrics(paragraphs: Column, n: int = 5) -> Column:
    """struct(runs, repeats) of an array of paragraphs: as duplicate_ngrams."""
    return scan.run_counts(paragraphs, n)


def body_paragraphs(x: Column | str) -> Column:
    """The blocks of a text that are no headings, quotes or rules."""
    return F.filter(T.blocks(x), lambda b: ~b.rlike(r"\A(?:#|>|---)"))


_GAPS = (
    rf"(?U)(?<=[{C.FAMILY}])\s+(?=[{C.FAMILY}])",
    rf"(?U)(?<=[{C.FAMILY}])\s+(?=[{C.TIGHT_PUNCTUATION}])",
    rf"(?U)(?<=[（《「『【(])\s+(?=[{C.FAMILY}])",
    rf"(?U)(?<=[{C.FAMILY}])\s+(?=[）》」』】)])",
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_readability(df: DataFrame, body: str) -> DataFrame:
    """df with ``cjk``: readability signals of the array of paragraphs in body, advisory unless there is enough CJK text."""
    df = df.withColumn("_c", F.filter(F.col(body), lambda b: T.has_family(b, 4)))
    df = df.withColumn("_t", F.array_join("_c", "\n\n"))
    df = df.withColumn("_m", ngram_metrics(F.col("_c")))
    n, m = F.size("_c"), T.family_length("_t")
    gaps = sum((T.count(F.col("_t"), p) for p in _GAPS), F.lit(0))
    short = F.size(F.filter("_c", T.is_fragment))
    df = df.withColumn("_n", F.struct(n.alias("n"), m.alias("chars"), gaps.alias("gaps"), short.alias("short"), T.punctuation_length("_t").alias("marks"), T.meaningful_length(F.col("_t"), C.QUALITY_PUNCTUATION).alias("meant")))
    v = lambda k: F.col(f"_n.{k}")
    applies = (v("chars") >= 24) & (v("n") >= 2)
    gap_ratio, short_ratio, density = _ratio(v("gaps"), v("chars")), _ratio(v("short"), v("n")), _ratio(v("marks"), v("meant"))
    repeats = F.col("_m.repeats")
    repeated = F.when(F.col("_m.runs") > 0, F.round(repeats / F.col("_m.runs"), 3)).otherwise(F.lit(0.0))
    cjk = F.struct(
        applies.alias("cjk_readability_applicable"),
        v("n").alias("cjk_body_paragraph_count"),
        v("chars").alias("cjk_body_char_count"),
        v("gaps").alias("cjk_spacing_anomaly_count"),
        F.round(gap_ratio, 3).alias("cjk_space_ratio"),
        (~(applies & (v("gaps") >= 2) & (gap_ratio > 0.01))).alias("cjk_spacing_ok"),
        repeated.alias("duplicate_ngram_ratio"),
        repeats.alias("duplicate_ngram_count"),
        F.col("_m.runs").alias("duplicate_ngram_windows"),
        (~(applies & (repeats >= 4) & (repeated > 0.06))).alias("duplicate_ngram_ok"),
        v("short").alias("short_paragraph_count"),
        F.round(short_ratio, 3).alias("short_paragraph_ratio"),
        (~(applies & (v("n") >= 4) & (v("short") >= 4) & (short_ratio > 0.45))).alias("short_paragraph_ratio_ok"),
        F.round(density, 3).alias("punctuation_density"),
        (~(applies & (v("chars") >= 120) & (density < 0.01))).alias("punctuation_density_ok"),
    )
    return df.withColumn("cjk", cjk).drop("_c", "_t", "_m", "_n")


def flat_blocks(blocks: Column) -> Column:
    """Blocks as seam_count compares them: white space collapsed, none empty. One block alone has no seam and isn't looked at."""
    none = F.array().cast("array<string>")
    return F.when(F.size(blocks) > 1, F.filter(F.transform(blocks, T.collapse), lambda b: b != "")).when(F.size(blocks) >= 0, none)


def seam_count(blocks: Column) -> Column:
    """Adjacent blocks that are equal, or overlap strongly."""
    return flat_seam_count(flat_blocks(blocks))


def flat_seam_count(flat: Column) -> Column:
    """seam_count of flat_blocks, as a column of its own best: it is used twice. Overlaps are found in one pass; what they mean is tested where there are any."""

    def faulty(f: Column, lengths: Column, i: Column) -> Column:
        b = F.get(f, i + 1)
        longest = F.get(F.filter(lengths, lambda n: T.is_meaningful(F.left(b, n))), F.lit(0))
        return (F.get(f, i) == b) | (longest.isNotNull() & T.is_strong_quality_overlap(F.left(b, longest)))

    both = F.struct(flat.alias("f"), folds.neighbour_lengths(flat).alias("n"))
    return T.let(both, lambda v: F.size(F.filter(F.transform(v["n"], lambda n, i: F.coalesce(faulty(v["f"], n, i), F.lit(False))), lambda x: x)))


def bilingual_count(blocks: Column) -> Column:
    """Adjacent blocks of which one has an ASCII letter and the next an ideograph."""
    return F.size(F.filter(F.transform(blocks, lambda b, i: b.rlike("[A-Za-z]") & F.coalesce(F.get(blocks, i + 1).rlike(f"[{C.BASIC_IDEOGRAPH}]"), F.lit(False))), lambda x: x))


def penalty(density: Column, safe: float, scale: float, most: float) -> Column:
    return F.round(F.least(F.lit(most), F.greatest(F.lit(0.0), F.greatest(density, F.lit(0.0)) - safe) * scale), 4)


def band(score: Column) -> Column:
    return F.when(score >= 0.92, "excellent").when(score >= 0.78, "good").when(score >= 0.58, "fair").when(score >= 0.35, "poor").otherwise("critical")


# What each penalty counts, where it begins, how steep it is, its limit, and its reason.
_PENALTIES = (
    (("exact_duplicate_cue_count",), 0.04, 3.5, 0.35, "duplicate_cue_density_high"),
    (("overlap_trim_count", "overlap_collapsed_cue_count"), 0.06, 3.0, 0.30, "overlap_reduction_density_high"),
    (("collapsed_cjk_spacing_count", "tightened_punctuation_spacing_count", "tightened_bracket_spacing_count"), 0.10, 2.0, 0.20, "spacing_cleanup_density_high"),
    (("markup_tag_count", "nbsp_entity_count"), 0.15, 1.2, 0.08, "markup_cleanup_density_high"),
    (("empty_cue_count",), 0.05, 2.0, 0.10, "empty_cue_density_high"),
)


def subtitle_quality(docs: DataFrame, mode: str = "chinese", text: str = "text") -> DataFrame:
    """docs (doc_id, text, and the counters of subtitle diagnostics as columns) with score, band and reasons.

    Densities are per cue, of at least 20; six limited penalties are taken from 1.
    """
    lines = F.filter(F.transform(F.split(T.text_of(text), "\n"), T.strip), lambda s: s != "")
    d = docs.withColumn("_l", lines)
    cues = F.greatest(F.when(F.coalesce("cue_count", F.lit(0)) > 0, F.col("cue_count")).otherwise(F.size("_l")), F.lit(1))
    base = F.greatest(cues, F.lit(20))
    many = lambda names: sum((F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) for n in names), F.lit(0))
    parts = [(penalty(many(names) / base, *rest), reason) for names, *rest, reason in _PENALTIES]
    fragments = _ratio(F.size(F.filter("_l", T.is_fragment)), F.size("_l"))
    broken = F.when(F.size("_l") >= 10, penalty(fragments, 0.55, 0.6, 0.12)).otherwise(F.lit(0.0)) if mode == "chinese" else F.lit(0.0)
    parts.append((broken, "subtitle_fragmentation_high"))
    for k, (p, _) in enumerate(parts):
        d = d.withColumn(f"_p{k}", p)
    # Penalties have four places; as decimals their sum is exact and so is its rounding.
    taken = sum((F.col(f"_p{k}").cast("decimal(9,4)") for k in range(1, len(parts))), F.col("_p0").cast("decimal(9,4)"))
    score = F.round(F.greatest(F.lit(0).cast("decimal(12,4)"), (1 - taken).cast("decimal(12,4)")), 3).cast("double")
    reasons = F.array_compact(F.array(*[F.when(F.col(f"_p{k}") > 0, r) for k, (_, r) in enumerate(parts)]))
    d = d.withColumn("subtitle_quality_score", score).withColumn("subtitle_quality_band", band(F.col("subtitle_quality_score"))).withColumn("subtitle_quality_reasons", reasons)
    d = d.withColumn("overlap_reduction_count", many(("overlap_trim_count", "overlap_collapsed_cue_count"))).withColumn("fragment_line_ratio", F.round(fragments, 3))
    return d.drop("_l", *[f"_p{k}" for k in range(len(parts))])


def verify(docs: DataFrame, bilingual: bool = False, raw: str | None = None, empty_chunks: str | None = None) -> DataFrame:
    """The report on documents (doc_id, text[, raw text][, number of empty chunks]): checks, warnings, hard_failures, passed.

    One wide projection for each document; no shuffle.
    """
    text = T.text_of("text")
    d = docs.select("doc_id", text.alias("_text"), *([T.text_of(raw).alias("_raw")] if raw else []), *([F.col(empty_chunks).alias("_empty")] if empty_chunks else []))
    headers = T.found(F.col("_text"), r"(?m)^##\s+.+")
    lines = F.filter(F.split(T.strip(F.col("_text")), "\n"), lambda s: T.strip(s) != "")
    d = d.withColumn("_body", body_paragraphs("_text")).withColumn("section_count", F.size(headers)).withColumn("_last", T.strip(F.try_element_at(lines, F.lit(-1))))
    d = with_readability(d, "_body")
    n, s = F.size("_body"), F.col("section_count")
    chars = F.aggregate("_body", F.lit(0), lambda a, b: a + F.length(b))
    d = d.withColumn("total_chars", F.length("_text")).withColumn("total_lines", F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1)
    d = d.withColumn("paragraph_count", n).withColumn("no_truncation", F.coalesce(~T.looks_truncated("_last"), F.lit(False)) & F.col("_last").isNotNull())
    d = d.withColumn("_flat", flat_blocks(F.col("_body"))).withColumn("chunk_seam_warning_count", flat_seam_count(F.col("_flat"))).drop("_flat")
    density, per = F.when(n > 0, s / n).otherwise(s.cast("double")), F.when(s > 0, chars / s).otherwise(chars.cast("double"))
    d = d.withColumn("header_density", F.round(density, 3)).withColumn("avg_chars_per_section", F.round(per, 1))
    d = d.withColumn("header_fragment_balance_ok", ~((s >= 4) & (n >= 4) & (density > 0.6) & (per < 220)))
    total = F.col("total_chars")
    hard = [
        F.when(total == 0, "file_empty"),
        F.when((s == 0) & (total > 1200), "no_section_headers"),
    ]
    warn = [
        F.when((F.col("paragraph_count") < 2) & (total > 400), "few_paragraphs"),
        F.when(~F.col("no_truncation"), "possible_truncation"),
        F.when(F.col("chunk_seam_warning_count") > 0, "chunk_seam_duplication"),
        F.when(~F.col("header_fragment_balance_ok"), "header_density_high"),
        *[F.when(~F.col(f"cjk.{c}"), w) for c, w in (("cjk_spacing_ok", "cjk_spacing"), ("duplicate_ngram_ok", "repeated_phrases"), ("short_paragraph_ratio_ok", "subtitle_fragments"), ("punctuation_density_ok", "punctuation_density_low"))],
    ]
    extra = []
    if bilingual:
        cn = _ratio(F.length(T.sub(F.col("_text"), f"[^{C.BASIC_IDEOGRAPH}]")), total)
        en = _ratio(F.length(T.sub(F.col("_text"), "[^A-Za-z]")), total)
        d = d.withColumn("_cn", cn).withColumn("_en", en).withColumn("bilingual_pairs", bilingual_count(F.col("_body")))
        d = d.withColumn("cn_char_ratio", F.round("_cn", 3)).withColumn("en_char_ratio", F.round("_en", 3)).withColumn("bilingual_balanced", (F.col("_cn") > 0.1) & (F.col("_en") > 0.05))
        warn += [F.when(F.col("_cn") < 0.1, "cn_ratio_low"), F.when(F.col("_en") < 0.05, "en_ratio_low")]
        hard.append(F.when((F.col("paragraph_count") > 0) & (F.col("bilingual_pairs") == 0), "no_bilingual_pairs"))
        extra += ["cn_char_ratio", "en_char_ratio", "bilingual_balanced", "bilingual_pairs"]
    if raw:
        low, high = (1.2, 4.0) if bilingual else (0.7, 2.0)
        ratio = F.when(F.length("_raw") > 0, total / F.length("_raw"))
        d = d.withColumn("size_ratio_vs_raw", F.round(ratio, 2)).withColumn("size_ratio_ok", ratio.between(low, high))
        d = d.withColumn("_a", A.extract("_raw", 12)).withColumn("_miss", A.missing(F.col("_a"), "_text"))
        d = d.withColumn("semantic_anchor_count", F.size("_a.ordered")).withColumn("semantic_missing_count", F.size("_miss"))
        warn += [F.when(~F.col("size_ratio_ok"), "size_ratio"), F.when(F.col("semantic_missing_count") > 0, "missing_anchors")]
        extra += ["size_ratio_vs_raw", "size_ratio_ok", "semantic_anchor_count", "semantic_missing_count"]
    if empty_chunks:
        hard.append(F.when(F.col("_empty") > 0, "empty_processed_chunks"))
    base = ["total_chars", "total_lines", "paragraph_count", "section_count", "no_truncation", "chunk_seam_warning_count", "header_density", "avg_chars_per_section", "header_fragment_balance_ok"]
    out = d.withColumn("warnings", F.array_compact(F.array(*warn))).withColumn("hard_failures", F.array_compact(F.array(*hard)))
    return out.select("doc_id", *base, "cjk", *extra, "warnings", "hard_failures", (F.size("hard_failures") == 0).alias("passed"))


def verify_with_glossary(docs: DataFrame, glossary: DataFrame, bilingual: bool = False, raw: str = "raw", most: int = 12, by: str | None = "doc_id") -> DataFrame:
    """verify() of documents (doc_id, text, raw text) with the glossary's terms that the raw text has and the text lost.

    Adds glossary_drift_applicable, _selected_term_count, _matched_term_count, glossary_drift_count, glossary_preservation_ratio and
    glossary_drift_ok; lost terms warn (``glossary_drift``). A glossary (doc_id, term, ...), or one for all with by None.
    """
    report = verify(docs, bilingual, raw)
    source = docs.select("doc_id", F.struct("doc_id").alias("key"), F.col(raw).alias("text"))
    moved = G.drift(source, docs.select(F.struct("doc_id").alias("key"), F.col("text").alias("result")), glossary, most, by)
    checks = moved.select(
        F.col("key.doc_id").alias("doc_id"),
        (F.size("selected_terms") > 0).alias("glossary_drift_applicable"),
        F.size("selected_terms").alias("glossary_selected_term_count"),
        F.size("preserved_terms").alias("glossary_matched_term_count"),
        "glossary_drift_count",
        F.col("preservation_ratio").alias("glossary_preservation_ratio"),
        (F.col("glossary_drift_count") == 0).alias("glossary_drift_ok"),
    )
    both = report.join(checks, "doc_id")
    return both.withColumn("warnings", F.when(F.col("glossary_drift_ok"), F.col("warnings")).otherwise(F.array_append("warnings", "glossary_drift")))


def faults(task: str, text: str, result: str, missing_terms: bool = False, missing_anchors: bool = False) -> list[str]:
    """The retry_reasons of output_health for one result, as a worker sees it that has just asked for it."""
    out = []
    if task != "summarize":
        out += ["empty_output"] * (not result and bool(text)) + ["short_output"] * ((len(result) / len(text) if text else 0.0) < 0.5)
    if task in ("structure_only", "quick_cleanup", "cleanup_zh") and "##" not in result and len(text) > 2000:
        out.append("missing_headers")
    if task == "translate_only" and (len(re.findall(f"[{C.BASIC_IDEOGRAPH}]", result)) / len(result) if result else 0.0) < 0.1:
        out.append("translation_skipped")
    return out + ["missing_glossary_terms"] * missing_terms + ["missing_semantic_anchors"] * missing_anchors


def output_health(chunks: DataFrame, task: str, terms_missing: str | None = None) -> DataFrame:
    """chunks (doc_id, id, text, result[, array of missing terms]) with ratio and retry_reasons of the results."""
    c = chunks.withColumn("_r", T.text_of("result")).withColumn("_s", T.text_of("text"))
    ratio = _ratio(F.length("_r"), F.length("_s"))
    checks = []
    if task != "summarize":
        checks += [F.when((F.length("_r") == 0) & (F.length("_s") > 0), "empty_output"), F.when(ratio < 0.5, "short_output")]
    if task in ("structure_only", "quick_cleanup", "cleanup_zh"):
        checks.append(F.when(~F.col("_r").contains("##") & (F.length("_s") > 2000), "missing_headers"))
    if task == "translate_only":
        checks.append(F.when(_ratio(F.length(T.sub(F.col("_r"), f"[^{C.BASIC_IDEOGRAPH}]")), F.length("_r")) < 0.1, "translation_skipped"))
    if terms_missing:
        checks.append(F.when(F.size(terms_missing) > 0, "missing_glossary_terms"))
    c = c.withColumn("_a", A.extract("_s", 8))
    checks.append(F.when(F.size(A.missing(F.col("_a"), "_r")) > 0, "missing_semantic_anchors"))
    return c.withColumn("ratio", ratio).withColumn("retry_reasons", F.array_distinct(F.array_compact(F.array(*checks)))).drop("_r", "_s", "_a")
