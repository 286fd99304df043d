"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, contamination, fingerprints, langid, lines, manifest, neardup, passages, secrets, sharding, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), 24)


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predictions(docs, langid.fit(docs))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.without_repeated_lines(docs).select("doc_id", "lines_removed", "text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_token_files(spark, tokens.write_token_files(table(spark, sf_dir, "documents"), end_id=2))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(table(spark, sf_dir, "documents"), size=2048, end_id=1)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.without_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"), changed=manifest.without_line_ends())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_sharding, op2_neardup, op3_token_counts, op4_language, op5_line_dedup, op6_decontamination, op7_secrets, op8_token_files, op9_packing, op10_fingerprints, op11_passages, op12_alignment, op13_manifest, pipeline)
    return {f.__name__: f for f in own}


#: Links by the definition: an inverted index of whole sets; components by reachability.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), rows AS (SELECT doc_id, unnest(s) AS g FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)
), near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT reach.x, near.y FROM reach JOIN near ON near.x = reach.y)
SELECT s.doc_id, n AS n_shingles, c.y AS component_id, c.y = s.doc_id AS kept
FROM sizes s JOIN (SELECT x, min(y) AS y FROM reach GROUP BY 1) c ON c.x = s.doc_id
"""

OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes)
), hits AS (SELECT doc_id, dwin.n, i, item_id FROM dwin JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: All windows, grouped by their words.
OP11_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN firsts USING (g) WHERE doc_id > f),
lists AS (SELECT doc_id, list(k) AS k FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(k), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN k IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(k, j)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN lists USING (doc_id)
"""

#: Levels are lists of hashes, each made from the one below; crc32 bit by bit over the digits of doc_id (-1 stands for a shift).
OP13_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)] AS head, text,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 2 = 0 AS tampered FROM documents
), hashed AS (
  SELECT doc_id, source,
    sha256(array_to_string(list_transform(list_append(head, text), lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END), '')) AS leaf,
    sha256(array_to_string(list_transform(list_append(head, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END), lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END), '')) AS now
  FROM rows
), leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
level AS (
  SELECT source, 0 AS l, list(leaf ORDER BY i) AS h FROM leaves GROUP BY source
  UNION ALL SELECT source, l + 1, list_transform(range(0, len(h), 3), lambda j: sha256(array_to_string(h[j + 1 : j + 3], ''))) FROM level WHERE len(h) > 1
), subroots AS (SELECT source, h[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM level WHERE len(h) = 1),
top AS (
  SELECT 0 AS l, list(subroot ORDER BY s) AS h FROM subroots
  UNION ALL SELECT l + 1, list_transform(range(0, len(h), 3), lambda j: sha256(array_to_string(h[j + 1 : j + 3], ''))) FROM top WHERE len(h) > 1
), steps AS (
  SELECT source, i, l, h, i // CAST(power(3, l) AS BIGINT) AS k FROM leaves JOIN level USING (source) WHERE len(h) > 1 AND source IS NOT NULL
  UNION ALL SELECT v.source, i, l, h, i // CAST(power(3, l) AS BIGINT) FROM leaves v JOIN level w ON v.source IS NULL AND w.source IS NULL AND len(h) > 1
  UNION ALL SELECT v.source, i, 1000 + l, h, s // CAST(power(3, l) AS BIGINT) FROM leaves v JOIN subroots w ON v.source IS NOT DISTINCT FROM w.source, top WHERE len(h) > 1
), sides AS (
  SELECT source, i, list(array_to_string(list_filter(h[k // 3 * 3 + 1 : k // 3 * 3 + 3], lambda x, n: n - 1 < k % 3), '') || '|' || array_to_string(list_filter(h[k // 3 * 3 + 1 : k // 3 * 3 + 3], lambda x, n: n - 1 > k % 3), '') ORDER BY l) AS path
  FROM steps GROUP BY source, i
), folded AS (
  SELECT doc_id, leaf, subroot, (SELECT h[1] FROM top WHERE len(h) = 1) AS root, sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(now, coalesce(path, [])), lambda a, p: sha256(split_part(p, '|', 1) || a || split_part(p, '|', 2))) AS folded_root
  FROM leaves v JOIN subroots w ON v.source IS NOT DISTINCT FROM w.source LEFT JOIN sides p ON v.source IS NOT DISTINCT FROM p.source AND v.i = p.i
)
SELECT *, folded_root = root AS verified FROM folded
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_neardup": OP2_SQL, "op6_decontamination": OP6_SQL, "op11_passages": OP11_SQL, "op13_manifest": OP13_SQL}
