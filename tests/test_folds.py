"""Folds against plain definitions, over whole tables of the smallest scale and over long texts."""

import math
import os
import random
import re
import time

import pytest
from loomtext.functions import folds
from loomtext.functions import text as T
from loomtext.functions.terms import Automaton, folded
from loomtext.operators import chunking, glossary, telemetry
from loomtext.plans import catalogue
from loomtext.plans.tables import events_as_runs
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
FAMILY = "\u3400-\u9FFF\u3040-\u30FF\uAC00-\uD7AF"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def estimate(t):
    """One for a CJK character, a quarter of each word, a quarter of all other marks."""
    if not t:
        return 0
    words = re.findall(r"[A-Za-z0-9]+(?:['\-][A-Za-z0-9]+)*", t)
    rest = re.sub(rf"[\s{FAMILY}]", "", re.sub(r"[A-Za-z0-9]+(?:['\-][A-Za-z0-9]+)*", "", t))
    return max(1, len(re.findall(f"[{FAMILY}]", t)) + sum((len(w) + 3) // 4 for w in words) + (len(rest) + 3) // 4)


def packed(sizes, fresh, limit, gap):
    out = []
    for k, s in enumerate(sizes):
        if out and not fresh[k] and sum(sizes[i] for i in out[-1]) + gap * len(out[-1]) + s <= limit:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def test_cut_by_tokens_measures_each_beginning():
    """A piece ends where one more character would take its estimate, worked out anew, past the size."""
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice("ab9'- .,甲か한\n") for _ in range(rnd.randint(0, 60)))
        size, want, now = rnd.randint(1, 9), [], ""
        for i, c in enumerate(t):
            follows = t[i + 1] if c in "'-" and i + 1 < len(t) and re.match("[A-Za-z0-9]", t[i + 1]) else ""
            # a joint that a letter follows belongs to the word already
            ahead = estimate(now + c + follows) if follows and re.search("[A-Za-z0-9]\\Z", now) else None
            n = estimate(now + c) if ahead is None else joint(now, c)
            if now and n > size:
                want.append(now)
                now = c
            else:
                now += c
        want.append(now)
        assert folds.cut_by_tokens(t, size) == [p.strip() for p in want if p.strip()], (t, size)


def joint(now, c):
    """The estimate with a joint counted as one more letter of the running word."""
    word = re.search(r"[A-Za-z0-9]+(?:['\-][A-Za-z0-9]+)*\Z", now)[0]
    return estimate(now + "x") if word else estimate(now + c)


def test_ranges_and_pieces(spark):
    rnd = random.Random(2)
    rows = [(k, [rnd.randint(1, 30) for _ in range(n)], [rnd.random() < 0.1 for _ in range(n)]) for k, n in enumerate([0, 1, 2, 40, 300])] + [(9, None, None)]
    df = spark.createDataFrame(rows, "k int, sizes array<long>, fresh array<boolean>")
    for limit, gap in ((50, 1), (10, 2), (1000, 0)):
        for r in df.select("k", folds.chunk_ranges(F.col("sizes"), F.col("fresh"), limit, gap).alias("r")).collect():
            _, sizes, fresh = next(x for x in rows if x[0] == r["k"])
            assert r["r"] is None if sizes is None else [list(range(c["first"], c["first"] + c["units"])) for c in r["r"]] == packed(sizes, fresh, limit, gap)


@pytest.mark.parametrize("text,want", [("", []), ("aaaa", [3, 2, 1]), ("abcab", [2]), ("abc", []), ("abacaba", [3, 1])])
def test_borders(text, want):
    assert folds.borders(text) == want


def test_shared_lengths():
    rnd = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rnd.choice(rnd.choice(["ab", "a", "abc 甲"])) for _ in range(rnd.randint(0, 40))) for _ in range(2))
        if rnd.random() < 0.5:
            b = a[rnd.randint(0, len(a)) :] + b
        assert folds.shared(a, b) == [n for n in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:n])]
    assert folds.shared("a" * 3000, "a" * 2000) == list(range(2000, 0, -1))


@here
def test_seams_over_all_documents(spark):
    """Blocks of documents that are equal to, or begin with the end of, the one before."""
    from loomtext.operators import quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.split("text", "\n").alias("b"))
    twice = docs.select("doc_id", F.flatten(F.transform("b", lambda x, i: F.when(i % 3 == 0, F.array(x, x)).when(i % 3 == 1, F.array(x, F.concat(F.substr(x, F.greatest(F.length(x) - 29, F.lit(1)), F.lit(30)), F.lit(" and more")))).otherwise(F.array(x)))).alias("b"))
    got = {r["doc_id"]: (r["n"], r["b"]) for r in twice.select("doc_id", "b", quality.seam_count(F.col("b")).alias("n")).collect()}

    def strong(t):
        t = t.strip()
        n = len(re.sub(r"[\s,.;:!?，。！？、；：()\[\]{}\"'“”‘’`]", "", t))
        return n >= 4 if re.search(f"[{FAMILY}]", t) else n >= 12 and len(re.findall(rf"[A-Za-z0-9]+|[{FAMILY}]", t)) >= 3

    def meant(t):
        t = t.strip()
        return bool(re.search(r"[^\W_]", t)) and (len(t.split()) >= 2 or len(t) >= 8)

    for n, blocks in got.values():
        flat = [x for x in (" ".join(b.split()) for b in blocks) if x]
        want = 0
        for a, b in zip(flat[:-1], flat[1:], strict=True):
            longest = next((b[:k] for k in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:k]) and meant(b[:k])), None)
            want += a == b or (longest is not None and strong(longest))
        assert n == want
    assert sum(n for n, _ in got.values()) > 100


@here
def test_pack_chunks_over_all_documents(spark):
    """Sentences as they come, sizes and chunks by the definition."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    sentences = {r["doc_id"]: r["s"] for r in docs.select("doc_id", T.split_sentences("text").alias("s")).collect()}
    got = {}
    for r in chunking.chunk_text(docs, 300, 400).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r["doc_id"], []).append((r["content"], r["n_sentences"], r["chars"], r["tokens"]))
    for k, units in sentences.items():
        parts = [p for u in units for p in (folds.cut_by_tokens(u, 400) if estimate(u) > 400 else [u])]
        chunks = packed([estimate(p) for p in parts], [False] * len(parts), 300, 1)
        texts = ["\n\n".join(parts[i] for i in c) for c in chunks]
        assert got.get(k, []) == [(t, len(c), len(t), estimate(t)) for t, c in zip(texts, chunks, strict=True)]


@here
def test_autotune_over_all_events(spark):
    """The controller, event by event, for each user."""
    e = events_as_runs(spark, DATA).select("document_id", "seq", "success", (F.col("command") == "error").alias("timeout"), (F.col("duration_ms") * 100).alias("latency_ms"))
    rows = sorted(map(tuple, e.collect()))
    want, state = {}, {}
    for d, seq, ok, late, ms in rows:
        target, good, last = state.get(d, (1000, 0, []))
        word, down, up = "", not ok and late, False
        good = good + 1 if ok else 0
        if ok:
            last = (last + [ms] if ms and ms > 0 else last)[-5:]
            down = bool(last) and sorted(last)[max(1, math.ceil(0.95 * len(last))) - 1] > 80_000
            up = not down and good >= 5
        now = min(target, max(200, math.floor(target * 0.75))) if down else max(target, min(2000, math.ceil(target * 1.1))) if up else target
        word = ("shrink" if down else "increase") if now != target else "steady" if down or up else "" if ok else "observe"
        state[d] = (now, 0 if ok and (down or up) else good, last)
        want[d, seq] = (now, word)
    got = {(r["document_id"], r["seq"]): (r["target"], r["event"]) for r in catalogue.queries()["autotune_trace"](spark, DATA).collect()}
    assert got == want and {w for _, w in want.values()} >= {"shrink", "increase", ""}


@here
def test_split_by_tokens_over_all_turns(spark):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    got = {}
    for r in catalogue.queries()["split_by_tokens"](spark, DATA).orderBy("conv_id", "turn", "part").collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append(r["content"])
    assert got == {k: p for k, t in turns.items() if (p := folds.cut_by_tokens(t or "", 40))}


@here
def test_glossary_over_all_documents(spark):
    """Terms, counts, scores and first chunks by the definition, over every document in chunks of a hundred words."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    chunks = [(d, n, " ".join(w[a : a + 100])) for d, t in docs for w in [(t or "").split()] for n, a in enumerate(range(0, len(w), 100))]
    want = {}
    for d, n, t in chunks:
        for p in glossary.PATTERNS:
            for term in re.findall(p, t):
                if len(term) >= 2 and term not in glossary.STOPWORDS and not term.isdigit():
                    want.setdefault((d, term), []).append(n)
    got = {(r["doc_id"], r["term"]): (r["count"], r["score"], r["chunk_ids"]) for r in glossary.build(spark.createDataFrame(chunks, "doc_id long, chunk_id int, text string"), most=10**9).collect()}
    assert got == {k: (len(v), len(v), sorted(set(v))[:5]) for k, v in want.items()}


def test_glossary_in_blocks_gives_what_one_gives(spark, monkeypatch):
    terms = ["alpha", "Beta-2", "x_y", "日本", "a.b", "_lead", "--", "ALPHA beta", "É", ""]
    texts = [("k1", "the Alpha, beta-2 and x_y z"), ("k2", "日本語 a.b _lead"), ("k3", "alphabet beta-22 ax_y"), ("k4", "-- alpha BETA É"), ("k5", None)]
    g = spark.createDataFrame([(t, "", len(terms) - k, 1) for k, t in enumerate(terms)], "term string, preferred_output string, score int, count int")
    df = spark.createDataFrame(texts, "key string, text string")
    once = sorted(map(tuple, glossary.select_terms(df, g, 8, None).collect()))
    assert len(once) == 10, once
    monkeypatch.setattr(glossary, "BLOCK", 10)
    assert sorted(map(tuple, glossary.select_terms(df, g, 8, None).collect())) == once
    monkeypatch.undo()
    many = g.unionByName(spark.range(600).select(F.concat(F.lit("filler"), "id").alias("term"), F.lit("").alias("preferred_output"), F.lit(0).alias("score"), F.lit(0).alias("count")))
    assert sorted(map(tuple, glossary.select_terms(df, many, 8, None).collect())) == once
    own = df.withColumn("doc_id", F.lit(1))
    assert sorted(map(tuple, glossary.select_terms(own, g.withColumn("doc_id", F.lit(1)), 8).collect())) == once


def test_automaton_by_patterns():
    """Every term against its own pattern, on texts made of pieces of terms, so that suffixes of terms are terms."""
    rnd = random.Random(7)
    pieces = ["a", "b", "ab", "ba", "aba", "a-b", "_", "B", "日", "日本", ".", " ", "İ", "é", "É", "1"]
    terms = list(dict.fromkeys("".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 4))).strip() for _ in range(300)))
    for ignore in (False, True):
        automaton = Automaton(terms, ignore)
        for _ in range(200):
            text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30)))
            low = folded if ignore else str
            want = set()
            for k, t in enumerate(terms):
                quoted = re.escape(low(t))
                pattern = rf"(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])" if re.fullmatch("[A-Za-z0-9_-]+", t) else quoted
                if t and re.search(pattern, low(text)):
                    want.add(k)
            assert automaton.used(text) == want, text


def test_a_glossary_of_very_many_terms_takes_one_pass():
    """Ten thousand terms take no more than a few times as long as ten; no term is found inside another word."""
    text = " ".join(f"w{k * 7919 % 100_003}" for k in range(60_000))
    took = []
    for n in (10, 10_000):
        automaton = Automaton([f"w{k}" for k in range(n)], True)
        began = time.time()
        found = automaton.used(text)
        took.append(time.time() - began)
        assert found == {k for k in range(n)} & {int(w[1:]) for w in text.split()}
    assert took[1] < 20 * took[0] + 1
    assert Automaton(["API"], True).used("rapid capital") == set()


def test_long_texts_take_time_in_proportion(spark):
    """Eight times the text takes nothing like 64 times the time."""
    a = " ".join(f"w{k}" for k in range(40_000))
    began = time.time()
    n = spark.createDataFrame([(a, a[100_000:] + " end")], "a string, b string").select(F.length(T.leading_overlap("a", "b"))).first()[0]
    assert n == len(a[100_000:].lstrip()) and time.time() - began < 20
    units = spark.createDataFrame([([f"Sentence number {k} here." for k in range(30_000)],)], "u array<string>")
    began = time.time()
    got = units.select(F.inline(chunking.pack(F.col("u"), 1200, 1596))).agg(F.sum("units"), F.count("*")).first()
    assert got[0] == 30_000 and got[1] > 100 and time.time() - began < 20


def test_autotune_streams_a_hot_group(spark):
    df = spark.range(30_000).select(F.lit("hot").alias("g"), F.col("id").alias("seq"), (F.col("id") % 50 != 7).alias("success"), (F.col("id") % 50 == 7).alias("timeout"), F.lit(10).alias("latency_ms"))
    got = telemetry.autotune(df, "g", "seq").groupBy("event").count().collect()
    assert sum(r["count"] for r in got) == 30_000
