"""Text functions: golden values, invariants, and independent code in Python."""

import math
import re

import pytest
from loomtext.functions import text as T
from loomtext.operators import anchors, glossary, quality
from pyspark.sql import functions as F


def each(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r["y"] for r in df.select("k", f("x").alias("y")).orderBy("k").collect()]


SENTENCES = [
    ("他说：“你好。”然后走了！真的吗？", ["他说：“你好。”", "然后走了！", "真的吗？"]),
    ("Hello world. It costs 3.14 dollars! Ok?", ["Hello world.", "It costs 3.14 dollars!", "Ok?"]),
    ("Dr. Smith met U.S. officials. They left.", ["Dr. Smith met U.S. officials.", "They left."]),
    ("Wait... what? (Yes.) Fine.", ["Wait..", ".", "what?", "(Yes.)", "Fine."]),
    ("", []),
    (None, []),
    ("   ", []),
    ("no end", ["no end"]),
]


def test_sentences_keep_their_marks(spark):
    got = each(spark, T.split_sentences, [x for x, _ in SENTENCES])
    for k in (0, 1, 2, 4, 5, 6, 7):
        assert got[k] == SENTENCES[k][1]


def test_sentences_lose_nothing(spark):
    texts = ["a.b c. D e! 你好。世界", "x" * 50 + ". y", "e.g. this and i.e. that. End", "1.5 is 3.0/2. OK"]
    for x, s in zip(texts, each(spark, T.split_sentences, texts), strict=True):
        assert re.sub(r"\s", "", "".join(s)) == re.sub(r"\s", "", x)


def estimated(t):
    family = len(re.findall(r"[㐀-鿿぀-ヿ가-힯]", t))
    words = re.findall(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*", t)
    rest = re.sub(r"[\s㐀-鿿぀-ヿ가-힯]", "", re.sub(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*", "", t))
    return max(1, family + sum(math.ceil(len(w) / 4) for w in words) + math.ceil(len(rest) / 4)) if t else 0


TEXTS = ["hello world", "你好世界", "Hello 世界", "", "don't stop-it now!!", "a, b; c… é", "한국어 kana カナ", "x" * 41, " ", "2024-01-02 3.5%"]


def test_token_estimate(spark):
    assert each(spark, T.estimate_tokens, TEXTS) == [estimated(t) for t in TEXTS]
    assert each(spark, lambda x: T.estimate_tokens(x, "chars"), ["abc", None]) == [3, 0]


@pytest.mark.parametrize("size", [1, 3, 7])
def test_split_by_tokens_fits_and_keeps_all(spark, size):
    texts = [t for t in TEXTS if t.strip()] + ["one two three four five six seven eight nine ten 你好世界再见"]
    for t, parts in zip(texts, each(spark, lambda x: T.split_by_tokens(x, size), texts), strict=True):
        assert "".join(re.sub(r"\s", "", p) for p in parts) == re.sub(r"\s", "", t)
        assert all(estimated(p.rstrip("'-") or "x") <= size for p in parts)  # the look ahead counts a hyphen to its word


def test_hard_split_and_tails(spark):
    assert each(spark, lambda x: T.hard_split(x, 10), ["甲" * 25, "", None]) == [["甲" * 10, "甲" * 10, "甲" * 5], [], []]
    assert each(spark, lambda x: T.truncate_tail(x, 10), [""]) == [""]
    assert each(spark, lambda x: T.truncate_tail(x, 0), [" 甲乙 "]) == ["甲乙"]
    assert each(spark, lambda x: T.truncate_tail(x, 2), ["甲乙丙丁"]) == ["丙丁"]
    assert each(spark, lambda x: T.tail_sentences(x, 2), ["A b. C d. E f.", "x"]) == ["C d. E f.", "x"]
    assert each(spark, T.last_section_title, ["## One\ntext\n## Two  \nx", "none"]) == ["Two", ""]


def test_spacing(spark):
    assert each(spark, T.tighten_spacing, ["大家 好 ，今天", "（ 你好 ）", "a . b", None]) == ["大家好，今天", "（你好）", "a. b", ""]
    counts = each(spark, T.tighten_counts, ["大家 好 今 天 ，x"])[0].asDict()
    assert counts == {"collapsed_cjk_spacing_count": 3, "tightened_punctuation_spacing_count": 1, "tightened_bracket_spacing_count": 0}


def test_markup_and_body(spark):
    assert each(spark, T.strip_markup, ["<c>a</c>&nbsp;b", None]) == ["a b", ""]
    assert each(spark, T.normalize_body, ["a  \r\nb\r\n\r\n\r\n\r\nc ", "\n x \n"]) == ["a\nb\n\nc", "x"]
    assert each(spark, T.normalize_cue, ["你好\n世界", "Second\nline", "(\nx\n)"]) == ["你好世界", "Second line", "(x)"]


def test_quirk_line_feed_between_cjk_is_closed(spark):
    assert each(spark, T.normalize_subtitle, ["你好\n世界"]) == ["你好世界"]


def test_speech(spark):
    assert each(spark, T.normalize_speech, ["d0ctor 5ummary", "mp-3x", "早 安 。", "下雨了下雨了下雨了"]) == ["doctor summary", "mp-3x", "早安。", "下雨了"]


def overlap(a, b):
    a, b = a.rstrip(), b.lstrip()
    for n in range(min(len(a), len(b)), 0, -1):
        c = b[:n]
        t = c.strip()
        if not a.endswith(c) or not re.search(r"[^\W_]", t):
            continue
        if re.search(r"[㐀-鿿぀-ヿ가-힯]", t):
            if len(re.sub(r"[\s,.;:!?，。！？、；：()\[\]{}\"'“”‘’]", "", t)) >= 2:
                return c
        elif len(t.split()) >= 2 or len(t) >= 8:
            return c
    return ""


def test_overlap(spark):
    pairs = [("我们下午去", "下午去公园"), ("a long warm day", "warm day at last"), ("abc", "abc"), ("abcdefgh", "abcdefgh"), ("x y", ""), ("a b c", "b c d"), ("", "q"), ("same text", "same text")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = [r["o"] for r in df.select("k", T.leading_overlap("a", "b").alias("o")).orderBy("k").collect()]
    assert got == [overlap(a, b) for a, b in pairs]


def test_names_dates_escapes(spark):
    assert each(spark, T.sanitize_filename, ['a/b:c*?"<>|. ', "x" * 300]) == ["a_b_c______"[:11], "x" * 200]
    assert each(spark, T.compact_dates, ["v 20240115 x20240116 20241399"]) == [["20240115"]]
    assert each(spark, T.frontmatter_date, ["20240115", "20241399", "n/a"]) == ["2024-01-15", "20241399", "n/a"]
    assert each(spark, T.yaml_scalar, ['a "b"']) == ['"a \\"b\\""']


def test_truncation(spark):
    rows = {"": True, "short": False, "It ends well.": False, "this line stops and": True, "an (unclosed bracket here": True, "x" * 121: True, "x" * 100: False, "列表到这里结束的": False, "这是一个没有写完整的句子的": True}
    assert each(spark, T.looks_truncated, list(rows)) == list(rows.values())


def test_blocks(spark):
    rows = {"# A\n## B": "heading", "> q": "quote", "- x": "list", "1. x": "list", "---": "hr", "```\ncode": "code", T.SEAM: "seam", "text": "body", "": "empty"}
    assert each(spark, lambda x: T.block_type(F.col(x)), list(rows)) == list(rows.values())


def test_anchors(spark):
    text = "see https://a.b/c on 2024-01-02 at 10:30, v1.2.3 has 45% of 12,500 and 2024"
    got = each(spark, anchors.extract, [text, "nothing", None])
    assert got[0]["ordered"] == ["https://a.b/con2024-01-02at", "10:30", "v1.2.3", "45%", "12,500"]
    assert got[1]["ordered"] == [] and got[2]["ordered"] == []


def test_quirk_url_takes_the_next_word(spark):
    assert each(spark, lambda x: anchors.extract(x)["urls"], ["http://x.y next one"]) == [["http://x.ynextone"]]


def test_quirk_a_term_of_two_patterns_counts_twice(spark):
    df = spark.createDataFrame([("d", 0, "GPT4 and GPT4"), ("d", 1, "OpenAI")], "doc_id string, chunk_id int, text string")
    got = {r["term"]: r["count"] for r in glossary.build(df).collect()}
    assert got == {"GPT4": 4, "OpenAI": 1}


def test_terms_have_boundaries(spark):
    texts = spark.createDataFrame([("a", "rapid capital"), ("b", "the API works")], "key string, text string")
    known = spark.createDataFrame([("API", 3, 1)], "term string, score int, count int")
    assert [(r["key"], r["term"]) for r in glossary.select_terms(texts, known, 8, None).collect()] == [("b", "API")]
    drift = glossary.drift(texts, spark.createDataFrame([("a", ""), ("b", "the api works")], "key string, result string"), known, 12, None).orderBy("key").collect()
    assert [(r["glossary_drift_count"], r["preservation_ratio"]) for r in drift] == [(0, 1.0), (1, 0.0)]


def test_quality_of_markdown(spark):
    spaced = "## T\n\n" + "\n\n".join(["这 是 一 个 很 奇 怪 的 段 落 需要 检查 的 文本 内容 。"] * 2)
    healthy = "## 标题\n\n这是一个完整的段落，用来说明健康的文本不会触发任何警告。\n\n这里是第二个段落，它同样完整，并且以句号结束。"
    r = {x["doc_id"]: x for x in quality.verify(spark.createDataFrame([("s", spaced), ("h", healthy), ("e", ""), ("n", None)], "doc_id string, text string")).collect()}
    assert not r["s"]["cjk"]["cjk_spacing_ok"] and r["s"]["chunk_seam_warning_count"] == 1
    assert r["h"]["warnings"] == [] and r["h"]["passed"]
    assert not r["e"]["passed"] and not r["n"]["passed"]


def test_bilingual(spark):
    df = spark.createDataFrame([("p", "## A\n\nHello there my friend.\n\n你好我的朋友们。"), ("n", "## A\n\nHello there.\n\nMore English.")], "doc_id string, text string")
    r = {x["doc_id"]: x for x in quality.verify(df, bilingual=True).collect()}
    assert r["p"]["bilingual_pairs"] == 1 and r["p"]["passed"] and not r["n"]["passed"]
