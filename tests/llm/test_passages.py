"""Removal of repeated passages against brute force over all windows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from loomtext.llm import passages
from loomtext.llm.common import text_slices

SCHEMA = "doc_id long, text string, kept string, o long, x long, _o int, runs int, start string"


def made(window):
    rnd = random.Random(window)
    words = ["".join(rnd.choice("abéA日") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    shared = [say(window + k) for k in (0, 0, 1, 3, 40, 200)]
    texts = [None, "", " \n\t ", "one", " ".join(say(5000)), " ".join(["a"] * (3 * window)), " ".join(["a"] * (4 * window)), "a\x00b c"]
    for _ in range(60):
        t = say(rnd.randint(0, 2 * window))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(shared)
            a = rnd.randint(0, len(p) // 3)
            t += p[a : rnd.randint(max(a, len(p) - 3), len(p))] + say(rnd.randint(0, 9))
        texts.append(rnd.choice([" ", "\n", " \t"]).join(t))
    texts += [texts[20].upper(), texts[20], texts[20]]
    rows = [(None if k % 17 == 16 else k // 2 if k % 11 == 10 else k, t) for k, t in enumerate(texts)]
    return rows + [rows[15], rows[9]]


def brute(rows, window):
    split = [passages.words_of(t or "") for _, t in rows]
    order = lambda i: (i is not None, i or 0)
    first = {}
    for (i, _), w in zip(rows, split, strict=True):
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, order(i)), order(i))
    out = []
    for (i, t), w in zip(rows, split, strict=True):
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < order(i) for j in range(k, k + window)}
        out.append((i, t, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "key_bits", "hot"), [(50, 64, None), (5, 64, 20), (5, 7, None), (1, 64, None)])
def test_passages(spark, monkeypatch, window, key_bits, hot):
    """Also with hot windows, and with hashes so short that most clash: the words decide."""
    if hot:
        monkeypatch.setattr(passages, "HOT", hot)
    rows = made(window)
    df = spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, "s") for i, t in rows], SCHEMA).repartition(3)
    out = passages.without_repeated_passages(df, window=window, key_bits=key_bits)
    assert out.columns == ["doc_id", "text", "o", "x", "_o", "runs", "start", "kept", "n_words", "n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()), key=str)
    assert got == brute(rows, window)


def test_no_passages(spark):
    df = spark.createDataFrame(made(5), "doc_id long, text string")
    assert passages.without_repeated_passages(df.limit(0)).collect() == []
    alone = passages.without_repeated_passages(df.limit(5)).collect()
    assert len(alone) == 5 and all(r["n_removed"] == 0 for r in alone)


@pytest.mark.parametrize("bits", [20, 22])
def test_estimates_are_never_too_low(spark, bits):
    """Whatever two documents share is taken for repeated; of what one has alone a sketch with room lets little through."""
    rnd = random.Random(2)
    texts = [" ".join(str(rnd.randrange(10**6)) for _ in range(400)) for _ in range(40)]
    texts += [t[: len(t) // 2] for t in texts[:5]] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    path = passages.sketch(df, 50, bits)
    known = passages.load_sketch(path, bits)
    assert known.shape == (2, 1 << (bits - 3))
    ((_, data, offsets),) = text_slices(pa.array([t or "" for t in texts]))
    text, _, key, anchor, *_ = passages.windows(data, offsets, 50)
    maybe = passages.maybe_repeated(known, anchor, bits)
    values, n = np.unique(key, return_counts=True)
    again = np.isin(key, values[n > 1])
    assert maybe[again].all() and again.sum() > 1000
    assert maybe[~again].mean() < 0.1


def test_windows_and_anchors():
    rnd = random.Random(1)
    words = [rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(300)]
    ((_, data, offsets),) = text_slices(pa.array([" ".join(words[:120]), "x y", None, "\t".join(words[60:])]))
    for n in (1, 2, 7, 50):
        text, pos, key, anchor, *_ = passages.windows(data, offsets, n)
        split = [words[:120], ["x", "y"], [], words[60:]]
        assert list(zip(text.tolist(), pos.tolist(), strict=True)) == [(t, k) for t, w in enumerate(split) for k in range(len(w) - n + 1)]
        said = [tuple(split[t][p : p + n]) for t, p in zip(text.tolist(), pos.tolist(), strict=True)]
        assert len(set(zip(said, key.tolist(), strict=True))) == len(set(said)) == len(set(key.tolist()))
        assert len(set(zip(said, anchor.tolist(), strict=True))) == len(set(said))
    values = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for n in range(1, 8):
        assert passages.least(values, n).tolist() == [min(values[k : k + n]) for k in range(8 - n)]


def test_sizes_of_the_sketch():
    assert passages.sketch_bits(0) == 20 and passages.sketch_bits(1 << 30) == 27 and passages.sketch_bits(1 << 50) == passages.MOST_BITS


@pytest.mark.parametrize("twice", [False, True])
def test_windows_carry_a_digest_only_where_an_id_comes_twice(spark, twice):
    rows = [(None if k == 16 else k, t) for k, (_, t) in enumerate(made(5))]
    rows += [(3, "other text")] * twice
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digests = {bytes(r["x"]) for r in passages._own(df, passages._named(df, "doc_id", "text"), "text").select("x").collect()}
    assert (digests == {b""}) != twice
    out = passages.without_repeated_passages(df, window=5)
    assert sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()), key=str) == brute(rows, 5)


def test_marks_keep_all_that_were_given_and_few_others(spark):
    own = spark.range(0, 20000, numPartitions=4).selectExpr("id AS o", "unhex(md5(cast(id AS string))) AS x", "cast(id AS string) AS text")
    kept = passages.marked(own, *passages.marks(own.where("o % 10 = 3").select("o", "x")))
    got = {r["o"] for r in kept.collect() if r["text"] == str(r["o"])}
    assert {o for o in range(20000) if o % 10 == 3} <= got
    assert len(got) < 4000
    none = passages.marked(own, *passages.marks(own.where("o < 0").select("o", "x")))
    assert none.count() == 0
