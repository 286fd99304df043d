"""Queries on texts: name, function, and SQL that gives the same rows (None where SQL can't)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scan
from ..functions import text as T
from ..operators import anchors as A
from ..operators import chunking, glossary, merge, quality
from ..operators import segments as S
from .tables import KNOWN, TURNS, table, turns

Q: dict = {}


def query(sql: str | None = None):
    return lambda f: Q.setdefault(f.__name__, (f, sql)) and f


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


CJK = r"\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
WORD = r"[A-Za-z0-9]+(?:[''\-][A-Za-z0-9]+)*"
SPACE = r"[\s\x0B\x{85}\p{Z}]"
ESTIMATE = rf"""greatest(1, length(regexp_replace(TEXT, '[^{CJK}]', '', 'g'))
  + coalesce(list_sum(list_transform(regexp_extract_all(TEXT, '{WORD}'), lambda w: (length(w) + 3) // 4)), 0)
  + (length(regexp_replace(regexp_replace(TEXT, '{WORD}', '', 'g'), '[\s\x0B\x{{85}}\p{{Z}}{CJK}]', '', 'g')) + 3) // 4)"""


def estimate(expr: str) -> str:
    return f"CAST(CASE WHEN {expr} = '' THEN 0 ELSE {ESTIMATE.replace('TEXT', expr)} END AS BIGINT)"


@query(f"SELECT doc_id, {estimate('text')} AS tokens, length(text) AS chars FROM documents")
def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", scan.text_counts(F.col("text")).alias("c")).select("doc_id", "c.tokens", "c.chars")


@query(rf"""SELECT doc_id, length(regexp_replace(text, '{SPACE}', '', 'g')) AS visible, length(regexp_replace(text, '[^{CJK}]', '', 'g')) AS family,
  length(regexp_replace(text, '[^,.;:!?，。！？、；：()\[\]{{}}"''“”‘’`]', '', 'g')) AS marks FROM documents""")
def char_class_counts(spark, d):
    return docs(spark, d).select("doc_id", scan.text_counts(F.col("text")).alias("c")).select("doc_id", "c.visible", "c.family", "c.marks")


@query("""SELECT page_id, replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' ') AS plain, len(regexp_extract_all(html, '<[^>]+>')) AS tags,
  len(regexp_extract_all(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;')) AS spaces FROM pages""")
def strip_markup(spark, d):
    p = table(spark, d, "pages")
    counts = T.markup_counts("html")
    return p.select("page_id", T.strip_markup("html").alias("plain"), counts["markup_tag_count"].cast("long").alias("tags"), counts["nbsp_entity_count"].cast("long").alias("spaces"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '[ \t\x0B\f]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS body FROM pages""")
def body_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_body("html").alias("body"))


@query()
def sentence_list(spark, d):
    s = T.split_sentences("text")
    return docs(spark, d).select("doc_id", F.posexplode(s).alias("sentence", "content"))


@query()
def pack_chunks(spark, d):
    return chunking.chunk_text(docs(spark, d))


@query()
def split_by_tokens(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.posexplode(T.split_by_tokens("text", 40)).alias("part", "content"))


@query("""WITH l AS (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents), m AS (SELECT doc_id, k, string_split(text, chr(10))[k] AS t FROM l),
n AS (SELECT *, CASE WHEN lag(k) OVER w IS NULL OR lag(t) OVER w <> t THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM n)
SELECT doc_id, CAST(min(k) - 1 AS BIGINT) AS id, CAST(max(k) AS DOUBLE) AS end_time, count(*) AS merged FROM r GROUP BY doc_id, run""")
def line_dedupe(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("id", "text"))
    timed = lines.withColumn("start_time", F.col("id").cast("double")).withColumn("end_time", (F.col("id") + 1).cast("double"))
    return S.merge_repeats(timed).select("doc_id", F.col("id").cast("long").alias("id"), "end_time", "merged")


@query(rf"""WITH {TURNS}, f AS (SELECT doc_id, id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM turns WHERE trim(text) <> ''),
p AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY id) AS b FROM f),
n AS (SELECT *, list_max(list_filter(range(1, least(length(b), length(t)) + 1), lambda n: ends_with(b, left(t, n)) AND regexp_matches(left(t, n), '[\p{{L}}\p{{N}}]')
  AND (len(string_split(trim(left(t, n)), ' ')) >= 2 OR length(trim(left(t, n))) >= 8))) AS n FROM p)
SELECT doc_id, CAST(id AS BIGINT) AS id, CASE WHEN b IS NULL THEN NULL ELSE coalesce(n, 0) END AS overlap_chars,
  coalesce(b = t OR (length(regexp_replace(left(t, n), '[\s,.;:!?，。！？、；：()\[\]{{}}"''“”‘’`]', '', 'g')) >= 12 AND len(regexp_extract_all(left(t, n), '[A-Za-z0-9]+')) >= 3), false) AS seam_fault FROM n""")
def overlap_adjacent(spark, d):
    return S.neighbours_overlap(turns(spark, d)).select("doc_id", F.col("id").cast("long").alias("id"), F.col("overlap_chars").cast("long").alias("overlap_chars"), "seam_fault")


@query(rf"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|[{CJK}]'), lambda x: lower(x)) AS t FROM documents),
g AS (SELECT doc_id, array_to_string(t[i : i + 4], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM t) WHERE len(list_distinct(t[i : i + 4])) > 1),
c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2), a AS (SELECT doc_id, sum(n) AS w, sum(n - 1) AS d FROM c GROUP BY 1)
SELECT doc_id, CAST(coalesce(w, 0) AS BIGINT) AS windows, CAST(coalesce(d, 0) AS BIGINT) AS duplicates, CASE WHEN w > 0 THEN round(d / w, 3) ELSE 0.0 END AS ratio FROM documents LEFT JOIN a USING (doc_id)""")
def ngram_dup(spark, d):
    return quality.duplicate_ngrams(docs(spark, d))


@query()
def glossary_terms(spark, d):
    t = table(spark, d, "documents")
    g = glossary.build(t.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), "text"))
    return g.select(F.col("doc_id").alias("source"), "rank", "term", "count", "score", "priority", F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), ",").alias("chunk_ids"))


#: Terms of the generated prose, for queries that need a given glossary.
TERMS = ("the", "and", "was", "of", "to", "ING", "THE", "EN", "leeux", "ander", "que", "zu", "the of", "x-ray")


def _known(spark):
    return glossary.listed(spark, [(t, len(TERMS) - k, k % 3) for k, t in enumerate(TERMS)], KNOWN)


def _term_sql(text: str, ignore: bool) -> str:
    case = "'(?i)' || " if ignore else ""
    quoted = "replace(term, '-', '[-]')"
    return f"regexp_matches({text}, {case}CASE WHEN regexp_full_match(term, '[A-Za-z0-9_-]+') THEN '(^|[^A-Za-z0-9])' || {quoted} || '([^A-Za-z0-9]|$)' ELSE {quoted} END)"


_KNOWN = "known(term, score, count) AS (VALUES " + ", ".join(f"('{t}', {len(TERMS) - k}, {k % 3})" for k, t in enumerate(TERMS)) + ")"


@query(f"""WITH {_KNOWN}, m AS (SELECT doc_id, term, score, count FROM documents, known WHERE {_term_sql('text', True)}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, count DESC, lower(term), term) AS rank FROM m)
SELECT doc_id AS key, term, rank FROM r WHERE rank <= 8""")
def glossary_select(spark, d):
    texts = docs(spark, d).withColumnRenamed("doc_id", "key")
    return glossary.select_terms(texts, _known(spark), 8, None).select("key", "term", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_KNOWN}, m AS (SELECT doc_id, term, score, count, {_term_sql('left(text, length(text) // 2)', False)} AS kept FROM documents, known WHERE {_term_sql('text', True)}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, count DESC, lower(term), term) AS rank FROM m),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (kept) AS k, string_agg(term, ',' ORDER BY rank) FILTER (NOT kept) AS missing FROM r WHERE rank <= 12 GROUP BY 1)
SELECT doc_id AS key, coalesce(missing, '') AS missing, coalesce(n - k, 0) AS glossary_drift_count, CASE WHEN n > 0 THEN round(k / n, 3) ELSE 1.0 END AS preservation_ratio FROM documents LEFT JOIN a USING (doc_id)""")
def glossary_drift(spark, d):
    texts = docs(spark, d).withColumnRenamed("doc_id", "key")
    halves = texts.select("key", F.expr("left(text, cast(length(text) div 2 as int))").alias("result"))
    out = glossary.drift(texts, halves, _known(spark), 12, None)
    return out.select("key", F.array_join("missing_terms", ",").alias("missing"), F.col("glossary_drift_count").cast("long").alias("glossary_drift_count"), "preservation_ratio")


#: A glossary of thousands of terms, far more than stand in a plan: words of the conversations, scored by their number.
_WORDS = "tokens AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM conversations), known AS (SELECT term, count(*) AS score, 1 AS count FROM tokens WHERE length(term) >= 4 GROUP BY term)"


def _words_known(spark, d):
    t = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return t.where("length(term) >= 4").groupBy("term").agg(F.count(F.lit(1)).alias("score")).withColumn("count", F.lit(1))


@query(f"""WITH {_WORDS}, used AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM used JOIN known USING (term))
SELECT doc_id AS key, term, rank FROM r WHERE rank <= 8""")
def glossary_of_thousands(spark, d):
    texts = docs(spark, d).withColumnRenamed("doc_id", "key")
    return glossary.select_terms(texts, _words_known(spark, d), 8, None).select("key", "term", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_WORDS}, used AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
kept AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(left(text, length(text) // 2), '[A-Za-z0-9]+')) AS term, true AS is_kept FROM documents),
r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM used JOIN known USING (term)),
a AS (SELECT doc_id, string_agg(term, ',' ORDER BY rank) FILTER (is_kept IS NULL) AS missing, count(*) FILTER (is_kept IS NULL) AS lost FROM r LEFT JOIN kept USING (doc_id, term) WHERE rank <= 12 GROUP BY 1)
SELECT doc_id AS key, coalesce(missing, '') AS missing, coalesce(lost, 0) AS lost FROM documents LEFT JOIN a USING (doc_id)""")
def glossary_drift_of_thousands(spark, d):
    texts = docs(spark, d).withColumnRenamed("doc_id", "key")
    halves = texts.select("key", F.expr("left(text, cast(length(text) div 2 as int))").alias("result"))
    out = glossary.drift(texts, halves, _words_known(spark, d), 12, None)
    return out.select("key", F.array_join("missing_terms", ",").alias("missing"), F.col("glossary_drift_count").cast("long").alias("lost"))


_ANCHORED = """concat(url, ' v2.', page_id % 7, ' on 2024-0', page_id % 9 + 1, '-15 at ', page_id % 12 + 10, ':30, ', page_id % 100, '.5% of ', page_id * 1234 + 10, ' in 2024, 12,500 left')"""
_REJOIN = r"'(https?://\S+)\s+([A-Za-z0-9./?=&_%#-]+)', '\1\2', 'g')"
_KINDS_SQL = (r"https?://[^\s)]+", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b", r"(?i)\bv?\d+(?:\.\d+){1,3}\b", r"\d+(?:\.\d+)?%", r"\b\d{2,}(?:,\d{3})*(?:\.\d+)?\b")
_FOUND = ", ".join(f"list_filter(list_transform(regexp_extract_all(s, '{p}'), lambda x: trim(x)), lambda x: x <> '') AS k{i}" for i, p in enumerate(_KINDS_SQL))
_ANCHOR_CTE = f"""s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_ANCHORED}, {_REJOIN}, {_REJOIN}, {_REJOIN} AS s FROM pages),
k AS (SELECT page_id, s, {_FOUND} FROM s),
h AS (SELECT page_id, s, k0 || k1 || k2 || k3 || k4 AS h, list_filter(k5, lambda n: len(list_filter(k0 || k1 || k2 || k3 || k4, lambda x: contains(x, n))) = 0) AS n FROM k),
e AS (SELECT page_id, s, h || n AS a, n FROM h),
d AS (SELECT page_id, s, n, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL)[1 : 8] AS o FROM e)"""


def _anchored(spark, d):
    made = _ANCHORED.replace("page_id % 9 + 1", "(page_id % 9 + 1)").replace("page_id % 12 + 10", "(page_id % 12 + 10)")
    return table(spark, d, "pages").select("page_id", F.expr(made).alias("text"))


@query(f"WITH {_ANCHOR_CTE} SELECT page_id, array_to_string(o, '|') AS ordered FROM d")
def anchors(spark, d):
    return _anchored(spark, d).select("page_id", F.array_join(A.extract("text")["ordered"], "|").alias("ordered"))


@query(f"""WITH {_ANCHOR_CTE}, r AS (SELECT d.*, replace(replace({_ANCHORED}, ',', ''), '-15', '-16') AS r FROM d JOIN pages USING (page_id))
SELECT page_id, array_to_string(list_filter(o, lambda x: NOT CASE WHEN list_contains(n, x) THEN contains(replace(r, ',', ''), replace(x, ',', '')) ELSE contains(r, x) END), '|') AS missing FROM r""")
def anchor_missing(spark, d):
    t = _anchored(spark, d).withColumn("a", A.extract("text")).withColumn("r", F.expr("replace(replace(text, ',', ''), '-15', '-16')"))
    return t.select("page_id", F.array_join(A.missing(F.col("a"), "r"), "|").alias("missing"))


@query(rf"""WITH {TURNS}, b AS (SELECT doc_id, id, CASE WHEN id % 3 = 1 THEN '译文' ELSE text END AS t FROM turns),
n AS (SELECT doc_id, t, lead(t) OVER (PARTITION BY doc_id ORDER BY id) AS f FROM b WHERE trim(t) <> '')
SELECT doc_id, count(*) FILTER (regexp_matches(t, '[A-Za-z]') AND coalesce(regexp_matches(f, '[\x{{4E00}}-\x{{9FFF}}]'), false)) AS pairs FROM n GROUP BY 1""")
def bilingual_pairs(spark, d):
    t = turns(spark, d).withColumn("text", F.when(F.col("id") % 3 == 1, "译文").otherwise(F.col("text")))
    return S.bilingual_pairs(t)


@query()
def quality_report(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", F.expr("left(text, cast(length(text) * 4 div 5 as int))").alias("raw"))
    r = quality.verify(t, raw="raw")
    return r.select("doc_id", "total_chars", "total_lines", "paragraph_count", "section_count", "no_truncation", "chunk_seam_warning_count", "size_ratio_vs_raw", "size_ratio_ok", "semantic_missing_count", F.array_join("warnings", ",").alias("warnings"), F.array_join("hard_failures", ",").alias("hard_failures"), "passed")


@query(r"""SELECT doc_id, length(text) AS total_chars, length(text) - length(replace(text, chr(10), '')) + 1 AS total_lines, len(regexp_extract_all(text, '(?m)^##\s+.+')) AS section_count,
  round(length(text) / CAST(length(left(text, length(text) * 4 // 5)) AS DOUBLE), 2) AS size_ratio_vs_raw, NOT (length(text) = 0 OR (length(text) > 1200 AND len(regexp_extract_all(text, '(?m)^##\s+.+')) = 0)) AS passed FROM documents""")
def quality_gate(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", F.expr("left(text, cast(length(text) * 4 div 5 as int))").alias("raw"))
    r = quality.verify(t, raw="raw")
    return r.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("total_chars", "total_lines", "section_count")], "size_ratio_vs_raw", "passed")


_COUNTS = {"cue_count": "30 + doc_id % 50", "exact_duplicate_cue_count": "doc_id % 7", "overlap_trim_count": "doc_id % 11", "overlap_collapsed_cue_count": "doc_id % 3", "collapsed_cjk_spacing_count": "doc_id % 13", "tightened_punctuation_spacing_count": "doc_id % 5", "tightened_bracket_spacing_count": "doc_id % 2", "markup_tag_count": "doc_id % 17", "nbsp_entity_count": "doc_id % 4", "empty_cue_count": "doc_id % 6"}
_PEN = ", ".join(
    f"round(least({most}::DOUBLE, greatest(0::DOUBLE, ({many}) / CAST(greatest(30 + doc_id % 50, 20) AS DOUBLE) - {safe}::DOUBLE) * {scale}::DOUBLE), 4)::DECIMAL(9, 4) AS p{k}"
    for k, (many, safe, scale, most) in enumerate((("doc_id % 7", 0.04, 3.5, 0.35), ("doc_id % 11 + doc_id % 3", 0.06, 3.0, 0.3), ("doc_id % 13 + doc_id % 5 + doc_id % 2", 0.1, 2.0, 0.2), ("doc_id % 17 + doc_id % 4", 0.15, 1.2, 0.08), ("doc_id % 6", 0.05, 2.0, 0.1)))
)


@query(f"""WITH p AS (SELECT doc_id, {_PEN} FROM documents), s AS (SELECT doc_id, CAST(round(greatest(0::DECIMAL(9, 4), 1 - (p0 + p1 + p2 + p3 + p4)), 3) AS DOUBLE) AS score FROM p)
SELECT doc_id, score, CASE WHEN score >= 0.92 THEN 'excellent' WHEN score >= 0.78 THEN 'good' WHEN score >= 0.58 THEN 'fair' WHEN score >= 0.35 THEN 'poor' ELSE 'critical' END AS band FROM s""")
def subtitle_quality(spark, d):
    t = docs(spark, d).select("doc_id", "text", *[F.expr(e).alias(c) for c, e in _COUNTS.items()])
    return quality.subtitle_quality(t).select("doc_id", F.col("subtitle_quality_score").alias("score"), F.col("subtitle_quality_band").alias("band"))


@query()
def merge_chunks(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("id"), F.when(F.col("turn") % 5 == 4, "superseded").otherwise("done").alias("status"), F.col("text").alias("result"))
    heads = c.where("id % 3 = 0").select("doc_id", F.col("id").alias("chapter"), F.concat(F.lit("Part "), "id").alias("title"), F.col("id").alias("start_chunk"))
    out = merge.merge_chunks(c, heads)
    return out.select("doc_id", "text", "diagnostics.*", F.size("missing").alias("missing"))


@query("""WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), a AS (SELECT doc_id, unnest(w) AS x FROM w)
SELECT doc_id, count(DISTINCT x) AS distinct_words, count(DISTINCT x) FILTER (x NOT IN ('the', 'of', 'and')) AS without_common FROM a GROUP BY 1""")
def ordered_distinct(spark, d):
    words = F.array_distinct(F.split(F.lower("text"), " "))
    common = F.array(*map(F.lit, ("the", "of", "and")))
    return docs(spark, d).select("doc_id", F.size(words).cast("long").alias("distinct_words"), F.size(F.array_except(words, common)).cast("long").alias("without_common"))


@query(r"""SELECT page_id, left(trim(regexp_replace(url, '[/\\:*?"<>|]', '_', 'g'), ' .'), 200) AS name, strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER), '%Y-%m-%d') AS date FROM pages""")
def file_names(spark, d):
    p = table(spark, d, "pages")
    compact = F.date_format(F.expr("date_add(date'2024-01-01', cast(page_id % 300 as int))"), "yyyyMMdd")
    return p.select("page_id", T.sanitize_filename("url").alias("name"), T.frontmatter_date(compact).alias("date"))


@query()
def block_types(spark, d):
    p = table(spark, d, "pages").select("page_id", F.posexplode(T.blocks(T.strip_markup("html"))).alias("block", "content"))
    return p.select("page_id", "block", T.block_type(F.col("content")).alias("type"), T.is_incomplete(F.col("content")).alias("incomplete"), T.is_titleish(F.col("content")).alias("titleish"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents")
def content_hash(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
