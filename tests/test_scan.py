"""The scan of character classes against the regular expressions that define them."""

import random

import numpy as np
import pyarrow as pa
from loomtext.functions import folds, scan
from loomtext.functions import text as T
from pyspark.sql import functions as F
from test_folds import estimate

PIECES = ["a", "Z", "9", "'", "-", "a-b", "x'y", " ", "\n", "\t", " ", "　", " ", "\u0085", "你", "か", "한", "〇", "é", "ß", "😀", ",", "。", "“", "`", "\\", "[", "​", "\x1c", "word", "don't"]


def texts(n=400):
    rnd = random.Random(5)
    return ["", "-", "'", "a-", "-a", "a--b", "a'-b", "a-b-c", "😀"] + ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_scan_gives_what_the_patterns_give(spark, monkeypatch):
    monkeypatch.setattr(scan, "SLICE", 100)
    some = texts()
    df = spark.createDataFrame(list(enumerate(some)), "k int, text string")
    one = lambda c: c.cast("long")
    want = df.select("k", T.estimate_tokens("text"), T.estimate_tokens("text", "chars"), one(T.visible_length("text")), one(T.family_length("text")), one(T.punctuation_length("text")))
    got = df.select("k", scan.text_counts(F.col("text")).alias("c")).select("k", "c.*")
    assert got.columns == ["k", "tokens", "chars", "visible", "family", "marks"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    found = scan.scanned(pa.array([None, *some], pa.string()).slice(1))
    ascii_only = [k for k, t in enumerate(some) if "\x1c" not in t]
    assert [found["tokens"][k] for k in ascii_only] == [estimate(some[k]) for k in ascii_only]


def test_units_of_arrays(spark):
    some = texts(60)
    rows = [(0, some), (1, []), (2, None), (3, ["one two", "", "三"])]
    df = spark.createDataFrame(rows, "k int, u array<string>").repartition(1)
    got = {r["k"]: r["m"] for r in df.select("k", scan.unit_counts(F.col("u")).alias("m")).collect()}
    assert got[1] == [] and got[2] is None
    assert [m["chars"] for m in got[0]] == [len(t) for t in some] and [(m["tokens"], m["fixed"], m["rest"]) for m in got[3]] == [(2, 2, 0), (0, 0, 0), (1, 1, 0)]
    measured = df.select("k", "u", scan.unit_counts(F.col("u")).alias("m"))
    ranged = measured.select("k", "u", folds.chunk_ranges(F.col("m")["tokens"], None, 30, 1, F.col("m")).alias("r"))
    for r in ranged.select("k", "r", F.transform("r", lambda c: T.estimate_tokens(F.array_join(F.slice("u", c["first"] + 1, c["units"]), "\n\n"))).alias("tokens")).collect():
        assert (r["r"] is None) == (r["k"] == 2)
        assert [c["tokens"] for c in r["r"] or []] == (r["tokens"] or [])


def test_ranges_by_search():
    rnd = random.Random(9)
    for _ in range(300):
        n, limit, gap = rnd.randint(0, 30), rnd.randint(1, 40), rnd.choice([0, 1, 2])
        size, fresh = [rnd.choice([0, 1, 5, 12, 60]) for _ in range(n)], [rnd.random() < 0.1 for _ in range(n)]
        want, now = [], None
        for k, s in enumerate(size):
            if now is None or fresh[k] or now + s + gap > limit:
                want.append(k)
                now = s
            else:
                now += s + gap
        assert folds.ranges_of(np.array(size, np.int64), np.array(fresh, bool), limit, gap) == want


def test_runs_of_tokens(spark, monkeypatch):
    """Runs within paragraphs, counted over all of a document; runs of one token only don't count; words in any case are one."""
    import re
    from collections import Counter

    monkeypatch.setattr(scan, "SLICE", 300)
    rnd = random.Random(6)
    say = lambda n: "".join(rnd.choice(["a ", "b,", "A-", "你", "好", "é", "x1 ", "\n"]) for _ in range(n))
    rows = [(k, [say(rnd.randint(0, 60)) for _ in range(rnd.randint(0, 5))]) for k in range(60)] + [(60, ["a " * 30]), (61, None), (62, ["", None])]
    df = spark.createDataFrame(rows, "k int, t array<string>").repartition(3)
    for n in (1, 2, 5):
        for r in df.select("k", scan.run_counts(F.col("t"), n).alias("c")).collect():
            found = Counter()
            for t in rows[r["k"]][1] or []:
                w = [x.lower() for x in re.findall(r"[A-Za-z0-9]+|[\u3400-\u9FFF\u3040-\u30FF\uAC00-\uD7AF]", t or "")]
                found.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if len(set(w[i : i + n])) > 1)
            assert (r["c"]["runs"], r["c"]["repeats"]) == (found.total(), found.total() - len(found))
