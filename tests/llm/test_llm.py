"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from loomtext.llm import bpe, contamination, fingerprints, langid, lines, neardup, secrets, sharding, tokens
from loomtext.llm.automaton import _Parser, compile_rules, reverse
from loomtext.llm.common import Known, hash_rank, kept_in_worker, nothing_kept, ordered_position, removed, shared_root, written
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, r long, x long, n int, node long, _x long, _gone int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made_texts(seed=5):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéilnorstu") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "One", "two words", "!!! ...", "日本語 テキスト 日本語", "a\tb  c d\r\n", "<|endoftext|> in <|endoftext|>", say(9000)]
    texts += [say(rnd.randint(1, 120)) for _ in range(60)]
    base = say(100).split()
    texts.append(" ".join(base))
    for k in range(40):
        copy = list(base)
        for _ in range(k % 14):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[20]] * 5 + [texts[30].upper()]
    return texts


TEXTS = made_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], ["big", "big", "small", None][k % 4], 1, 2, 3, 4, 5, 6, 7, 8) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- 1 ----------------------------------------------------------------------------------------


def test_shards(spark, docs, none):
    n = 7
    r = sharding.interleave(docs, n).collect()
    assert len(r) == len(TEXTS) and {x["law"] for x in r} == {"rows"} and all(x["grown_shard"] is None for x in r)
    count = Counter(x["shard"] for x in r)
    assert set(count) == set(range(n)) and max(count.values()) - min(count.values()) <= 1
    for s in range(n):
        assert sorted(x["slot"] for x in r if x["shard"] == s) == list(range(count[s]))
    for source, total in Counter(x["stratum"] for x in r).items():
        for s in range(n):
            assert abs(sum(x["stratum"] == source for x in r if x["shard"] == s) - total / n) <= 2
    for x in r:
        b = (TEXTS[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"]) == (len(b) + 8, zlib.crc32(b))
    again = sharding.interleave(docs.repartition(2), n).collect()
    assert {(x["doc_id"], x["shard"], x["slot"]) for x in again} == {(x["doc_id"], x["shard"], x["slot"]) for x in r}
    assert sharding.interleave(none, n).collect() == []


def test_shards_by_the_method(spark, docs):
    """Rank by hash within each source, a place by rank and phase, one order of places, cut into even runs."""
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long")).alias("h")).collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    phase = {r["s"]: (r["p"] % (1 << 20)) / (1 << 20) for r in spark.createDataFrame([(s,) for s in set(source.values())], "s string").select("s", F.xxhash64(F.lit(18), F.coalesce("s", F.lit(""))).alias("p")).collect()}
    place = {}
    for s in set(source.values()):
        own = sorted((k for k in source if source[k] == s), key=lambda k: h[k])
        place |= {k: ((r + phase[s]) / len(own), h[k]) for r, k in enumerate(own)}
    order = sorted(place, key=place.get)
    for n in (1, 7, 24):
        cut = [i * len(order) // n for i in range(n + 1)]
        want = {order[p]: (s, p - cut[s]) for s in range(n) for p in range(cut[s], cut[s + 1])}
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave(docs, n).collect()} == want


def test_repeated_rows_get_slots_of_their_own(spark):
    df = spark.createDataFrame([(1, "a", "s")] * 50, "doc_id long, text string, source string")
    r = sharding.interleave(df, 4).collect()
    assert len({(x["shard"], x["slot"]) for x in r}) == 50


def test_ranks_over_many_buckets(spark):
    n = 20_000
    df = spark.range(n).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.col("id").cast("string"))).withColumn("h", F.xxhash64("id"))
    r = hash_rank(df, "g", "h", ["id"], n, "r").collect()
    hot = sorted((x["h"] % (1 << 64), x["r"]) for x in r if x["g"] == "hot")
    assert [x for _, x in hot] == list(range(len(hot))) and all(x["r"] == 0 for x in r if x["g"] not in (None, "hot"))
    assert sorted(x["r"] for x in r if x["g"] is None) == list(range(sum(x["g"] is None for x in r)))
    p = ordered_position(spark.range(n).withColumn("f", F.col("id") / n), "f", ["id"], n, "p").collect()
    assert all(x["p"] == x["id"] for x in p)


# ---- 2 ----------------------------------------------------------------------------------------


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_components(texts, words, percent=80):
    sets = [shingle_set(t, words) for t in texts]
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return [root(k) for k in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, docs, words):
    want, sizes = brute_components(TEXTS, words)
    got = by_id(neardup.near_duplicates(docs, words))
    assert [got[k]["component_id"] for k in range(len(TEXTS))] == want
    assert [got[k]["n_shingles"] for k in range(len(TEXTS))] == sizes
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())


def test_a_crowded_bucket(spark, monkeypatch):
    """Groups that leaders leave open are compared in blocks, also when a block holds few documents."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 700)
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(70):
        copy = list(base)
        for _ in range(rnd.randint(0, 7)):
            copy[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = brute_components(texts, 2)
    got = by_id(neardup.near_duplicates(df, 2))
    assert [got[k]["component_id"] for k in range(len(texts))] == want


@pytest.mark.parametrize("bits", [0, 1])
def test_equal_hashes_are_compared(spark, docs, monkeypatch, bits):
    """All sets have one hash, or one of a few: documents that share no shingle stay apart, those with one set stay together."""
    own = neardup._set_hashes

    def clash(first, s, more):
        return np.where(own(first, s, more) != 0, 1 + (own(first, s, more) & np.uint64(bits)), 0).astype(np.uint64)

    monkeypatch.setattr(neardup, "_set_hashes", clash)
    want, sizes = brute_components(TEXTS, 2)
    got = by_id(neardup.near_duplicates(docs, 2))
    assert [got[k]["component_id"] for k in range(len(TEXTS))] == want
    assert [got[k]["n_shingles"] for k in range(len(TEXTS))] == sizes


def test_near_duplicates_of_little(spark, none):
    assert neardup.near_duplicates(none, 2).collect() == []
    df = spark.createDataFrame([(3, None), (1, ""), (2, "a b"), (2, "a b"), (9, "A B")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 2).collect()}
    assert got == {(3, 3, True), (1, 1, True), (2, 2, True), (9, 2, False)}
    assert neardup.without_near_duplicates(df, 2).count() == 4
    say = lambda k: " ".join(f"w{(k * 50 + i)}" for i in range(50))
    twice = spark.createDataFrame([(1, say(1)), (1, say(2)), (5, say(1) + " x"), (6, say(2) + " y"), (7, say(3))], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(twice, 2).collect()} == {(1, 1), (5, 1), (6, 1), (7, 7)}


@pytest.mark.parametrize("words", [1, 2, 3, 5, 6])
def test_exact_sets(words):
    """Numbers are equal for equal shingles only, within and across texts."""
    first, s = neardup.exact_sets(pa.array([t or "" for t in TEXTS]), words)
    sets = [shingle_set(t, words) for t in TEXTS]
    assert [len(x) for x in sets] == np.diff(first).tolist()
    own = [set(s[a:z].tolist()) for a, z in zip(first[:-1], first[1:], strict=True)]
    for a in range(len(TEXTS)):
        for b in range(a):
            assert len(own[a] & own[b]) == len(sets[a] & sets[b])


def test_long_words_are_told_apart(spark):
    """Words whose polynomials are alike modulo 2**64, whatever the base, are different words."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    texts = [one, one.translate(str.maketrans("ab", "ba")), one, f"x {one} y z", f"x {one[::-1].translate(str.maketrans('ab', 'ba'))[:-1]}b y z"]
    want, sizes = brute_components(texts, 2)
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2))
    assert [got[k]["component_id"] for k in range(5)] == want and want[1] == 1 and want[2] == 0


@pytest.mark.parametrize("block", [500, 10**6])
def test_an_open_group_with_a_large_core(spark, monkeypatch, block):
    """Copies that the leader links, and others that only reach them through each other."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for k in range(120):
        copy = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 6, 7, 8])):
            copy[rnd.randrange(80)] = f"x{rnd.randrange(60)}"
        texts.append(" ".join(copy))
    want, _ = brute_components(texts, 2)
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2))
    assert len(set(want)) > 3 and [got[k]["component_id"] for k in range(len(texts))] == want


def test_tables_of_an_open_group_are_not_broadcast(spark, monkeypatch):
    """Nothing that grows with the documents, least of all what explode made many rows of, goes through the driver."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    plans = {}

    def seen(df, name, among=None):
        plans[name] = plans.get(name, "") + df._jdf.queryExecution().executedPlan().toString()
        return written(df, name, among)

    monkeypatch.setattr(neardup, "written", seen)
    rnd = random.Random(11)
    texts = [" ".join(f"x{rnd.randrange(60)}" if rnd.random() < k % 9 / 80 else f"w{i}" for i in range(80)) for k in range(60)]
    neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).collect()
    assert {"said", "led", "compared", "edges", "rest", "roots", "leasts"} <= set(plans)
    assert [name for name, plan in plans.items() if "BroadcastExchange" in plan] == []


def test_a_worker_drops_its_tool():
    kept_in_worker("a tool", lambda: [1])
    nothing_kept()
    assert kept_in_worker("a tool", lambda: [2]) == [2]
    nothing_kept()


def test_written_tables_send_few_rows_at_once(spark):
    """Batches that go to Python workers are bounded while a table is written; the session's setting stays, and holds if it is less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"])

    most = lambda: max(r["n"] for r in written(spark.range(0, 9000, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect())
    assert 1000 < most() <= 2500 and spark.conf.get(name) == was
    try:
        spark.conf.set(name, "40")
        assert most() == 40 and spark.conf.get(name) == "40"
    finally:
        spark.conf.set(name, was)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    up = {}

    def root(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(k, k) == root(k) for k in up)


# ---- 3, 8, 9 -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


HARD = ["", " ", "a", "  a  b \n\n c\t", "don't we'll 'tis x's", "a<|endoftext|>b", "日本語 テキスト…", "²½ Ⅷ x²y", " x y\x1cz\x85", "a" * 3000, "!!!! ... $%$", "x\n", "\nx", "é ǅ ʰ ª", "😀 hi", "it's.\nHe'd say", "foo'.\nbar,baz. 'q'", "x y", "​ z"]


def test_tokens_are_the_library_s(library):
    count, encode = bpe.Counter(), bpe.Encoder()
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "foo", "Bar", "'s", "'", "'ll", "1", "23", "!", "...", "é", "…", "日本", " ", "\x85", "\u3000", "\x1c", "²", "<|endoftext|>", "<|end", "\r\n", "_", "-", "x.y", "I'M"]
    texts = HARD + TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert count.count_all(pa.array(texts)).tolist() == [count.count(t) for t in texts] == [len(x) for x in want]
    at = 0
    for flat, ends in encode.encode_all(pa.array(texts), 2):
        for a, z in zip([0, *ends[:-1]], ends, strict=True):
            assert flat[a:z].tolist() == [*want[at], 2], texts[at]
            at += 1
    assert at == len(texts)


def test_pretokens_of_every_character(library):
    """The pattern cuts around each character as the library does."""
    import regex

    cut, pre = regex.compile(bpe.PATTERN).findall, library.pre_tokenizer
    step = 97
    for first in range(0, 0x110000, step * 400):
        chars = [chr(c) for c in range(first, min(0x110000, first + step * 400), step) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}!{c} {c}" for c in chars)
        assert len(cut(text)) == len(pre.pre_tokenize_str(text))


@pytest.mark.parametrize("most", [0, 300, 2000, 1 << 20])
def test_known_is_bounded(most):
    """A store gives what make() gives, whatever it has room for."""
    made, rnd = [], random.Random(2)

    def make(new):
        made.append(len(new))
        return np.array([x for u in new.to_pylist() for x in u], np.uint16), np.array([len(u) for u in new.to_pylist()], np.int64)

    store = Known(make, np.uint16, most)
    for _ in range(40):
        some = list({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 4))) for _ in range(30)})
        flat, first, size = store.runs(pa.array(some, pa.binary()))
        assert [flat[a : a + n].tobytes() for a, n in zip(first, size, strict=True)] == [np.array(list(x), np.uint16).tobytes() for x in some]
        assert store.keys.nbytes + store.flat.nbytes <= most
    assert (sum(made) <= 121) == (most == 1 << 20)


def test_a_worker_keeps_one_tool():
    assert [kept_in_worker(k, lambda k=k: [k]) for k in ("a", "a", "b")] == [["a"], ["a"], ["b"]]
    was = kept_in_worker("b", list)
    assert was == ["b"] and kept_in_worker("a", lambda: "new") == "new"


def test_token_counts(docs, none, library):
    got = by_id(tokens.token_counts(docs, limit=50))
    for k, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 50)
    assert tokens.token_counts(none).collect() == []


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, none, library):
    root = tokens.write_token_files(docs, end_id=2)
    start, got = 0, by_id(tokens.read_token_files(spark, root))
    for k, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert tokens.read_token_files(spark, tokens.write_token_files(none)).collect() == []
    odd = spark.createDataFrame([(None, "b"), (-1, "a"), (None, None), (0, "c")], "doc_id long, text string")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tokens.read_token_files(spark, tokens.write_token_files(odd)).collect())
    assert sorted(x[2] for x in got[:2]) == [1, 2]
    assert [x[1] for x in got] == [None, None, -1, 0]
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r["start"] for r in tokens.read_token_files(spark, tokens.write_token_files(twice)).collect()) == [0, 2, 4]


def test_packing(docs, none, library):
    size = 64
    r = tokens.pack(docs, size).collect()
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in TEXTS]
    for k, x in enumerate(ids):
        own = sorted((p for p in r if p["doc_id"] == k), key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(x) and p["ids_crc32"] == crc(x[at : at + p["length"]])
            at += p["length"]
        assert at == len(x)
    sequences = {}
    for p in r:
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
    assert sum(map(len, ids)) / (len(sequences) * size) > 0.9
    assert tokens.pack(none, size).collect() == []


def test_packing_by_the_method(docs):
    """Longest first into the pattern with the most room, with one sequence at a time instead of counts."""
    size = 64
    r = tokens.pack(docs, size).collect()
    room = []
    for n in sorted((p["length"] for p in r), reverse=True):
        k = max((k for k, left in enumerate(room) if left >= n), key=lambda k: room[k], default=None)
        if k is None:
            room.append(size - n)
        else:
            room[k] -= n
    sequences = Counter()
    for p in r:
        sequences[p["sequence_id"]] += p["length"]
    assert sorted(sequences.values()) == sorted(size - left for left in room)


def test_pack_histogram_places_all():
    rnd = random.Random(2)
    counts = {k: rnd.randint(1, 500) for k in rnd.sample(range(1, 513), 200)}
    patterns = tokens.pack_histogram(counts, 512)
    placed = Counter()
    for n, lengths in patterns:
        assert n > 0 and sum(lengths) <= 512
        for x in lengths:
            placed[x] += n
    assert placed == counts and tokens.pack_histogram({}, 512) == []
    assert sum(n for n, _ in tokens.pack_histogram({10: 100_000, 3: 5}, 512)) == 1961
    for first, _, _ in tokens.seats(patterns).values():
        assert first[0] == 0 and (np.diff(first) > 0).all()


# ---- 4 -----------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are not here")
def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.predictions(d, langid.fit(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(r) > 150 and sum(x["lang_pred"] == x["lang"] for x in r) / len(r) >= 0.97
    assert all(0 <= x["score"] <= 1 for x in r)


def test_language_of_odd_texts(spark, docs, none):
    model = langid.Model([("en", "the", 50), ("en", "house", 5), ("fr", "le", 50), ("fr", "maison", 5)])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "THE house"), (5, "Le maisons"), (6, "the " * 50000)], "doc_id long, text string")
    got = by_id(langid.predictions(df, model))
    assert [(got[k]["lang_pred"]) for k in range(1, 7)] == ["und", "und", "und", "en", "fr", "en"]
    assert got[1]["score"] == 0 and [got[k]["held_out"] for k in range(1, 7)] == [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(1, 7)]
    assert langid.predictions(none, model).collect() == []
    assert {r["lang_pred"] for r in langid.predictions(docs, langid.fit(none)).collect()} == {"und"}
    assert langid.identified(df, model).count() == 3 and langid.identified(df, model).columns == df.columns


def test_language_ignores_the_labels(spark):
    """What is predicted doesn't depend on lang and source of the row itself."""
    rows = [(k, "the house " * 5 if k % 2 else "le maison " * 5, "en" if k % 2 else "fr", "s") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    held = langid.fit(df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang"))))
    assert held.languages == ["en", "fr"]


def test_language_of_many_languages(spark):
    """Each of more than 64 values of lang can be predicted."""
    rows = [(k, " ".join(chr(97 + v % 26) + chr(97 + v // 26) + "".join(chr(97 + (v * j + j) % 26) for j in range(2, 5)) for _ in range(4)), f"l{v}") for k in range(800) for v in [k % 80]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.predictions(df, langid.fit(df)))
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)


def brute_language(model_rows, text):
    """Scores by the definition, from (lang, word, count): a word's log frequency, else the mean of twice the longest known n-grams'."""
    import regex

    langs = sorted({r[0] for r in model_rows})
    tables = [{} for _ in range(langid.LONGEST_GRAM + 1)]
    for lang, word, n in model_rows:
        tables[0].setdefault(word, Counter())[lang] += n
        for size in range(1, langid.LONGEST_GRAM + 1):
            m = f" {word} "
            for k in range(len(m) - size + 1):
                tables[size].setdefault(m[k : k + size], Counter())[lang] += n
    total = [{x: sum(c[x] for c in t.values()) + langid.SMOOTHING * len(t) for x in langs} for t in tables]
    log = lambda t, key, x: np.log((tables[t][key][x] + langid.SMOOTHING) / total[t][x])
    words = regex.findall(r"\p{L}+", (text or "").lower())
    if not words:
        return "und", 0.0
    score = dict.fromkeys(langs, 0.0)
    for w in words:
        m = f" {w} "
        for x in langs:
            if w in tables[0]:
                score[x] += log(0, w, x)
                continue
            for k in range(len(m) - 1):
                size = next((s for s in range(langid.LONGEST_GRAM, 0, -1) if k + s <= len(m) and m[k : k + s] in tables[s]), 0)
                score[x] += log(size, m[k : k + size], x) * 2 / len(m) if size else 0
    best = max(langs, key=lambda x: score[x])
    return best, 1 / sum(np.exp(v - score[best]) for v in score.values())


def test_language_by_brute_force(spark):
    rnd = random.Random(3)
    say = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5)))
    rows = [(lang, say(letters), rnd.randint(1, 30)) for lang, letters in (("aa", "abcé"), ("bb", "bcdß"), ("cc", "abd日本")) for _ in range(40)]
    texts = [" ".join(say("abcdeéß日本xÉ") + rnd.choice(["", ".", "1", "’s", "\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    texts += [None, "", "²", "½ ①", "Ⅷ", "12 !!", "_", "١٢"]
    got = by_id(langid.predictions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), langid.Model(rows)))
    for k, t in enumerate(texts):
        lang, score = brute_language(rows, t)
        assert got[k]["lang_pred"] == lang and abs(got[k]["score"] - score) < 1e-5, (t, got[k])


def test_language_learns_all_of_the_sample(spark):
    """Rare words and their n-grams count; fit() gives what the counts by hand give, and each sampled text counts once."""
    texts = ["Often often rarely²x", "often, l'été!", None, ""]
    df = spark.createDataFrame([(k, texts[k % 4], "en") for k in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    n = Counter(w for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2 for w in [["often", "often", "rarely", "x"], ["often", "l", "été"], [], []][k % 4])
    want = langid.Model([("en", w, c) for w, c in n.items()])
    assert set(model.words.to_pylist()) == set(n) and all((model.grams[s] == want.grams[s]).all() for s in want.grams)
    both = pa.array([*n, "often unseen words", "oft"])
    assert np.allclose(model.word_scores(both), want.word_scores(both))


# ---- 5 -----------------------------------------------------------------------------------------


def brute_lines(rows):
    seen, gone = {}, {}
    for doc, text in sorted({(d, t or "") for d, t in rows}):
        for first, n, chunk in lines.removable(text):
            seen.setdefault(chunk, []).append((doc, text, first, n))
    for places in seen.values():
        for doc, text, first, n in sorted(places)[1:]:
            gone.setdefault((doc, text), set()).update(range(first, first + n))
    return {k: "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in v) for k, v in gone.items()}


def test_line_dedup(spark):
    rnd = random.Random(4)
    line = lambda n: " ".join(str(rnd.randrange(1000)) for _ in range(n))
    shared = "\n".join(line(8) for _ in range(40))
    passage = line(60)
    rows = [(k, "\n".join([line(6), shared, line(7)] if k % 2 else [line(9), passage, line(3)])) for k in range(12)]
    rows += [(20, None), (21, ""), (22, "short\nshort"), (23, "\n\n\n"), (24, shared), (24, shared), (25, passage + "\n" + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(1)).withColumn("first", F.lit(2)).withColumn("lines", F.lit(3)).withColumn("_x", F.lit(4)).withColumn("_lines", F.lit(5))
    want = brute_lines(rows)
    got = lines.without_repeated_lines(df).collect()
    assert len(got) == len(rows)
    for r in got:
        old = dict(rows)[r["doc_id"]]
        assert r["text"] == (want.get((r["doc_id"], old or ""), old))
    texts = [r["text"] for r in got if r["text"]]
    assert all(sum(t.count(c) for t in set(texts)) == 1 for c in [passage, *shared.split("\n")])
    assert lines.without_repeated_lines(df.limit(0)).collect() == []


def test_line_dedup_of_twelve_lines(spark):
    """Twelve lines of 8 words and one of 60, with unique lines around: once afterwards, told from the texts alone."""
    rnd = random.Random(4)
    line = lambda n: " ".join(str(rnd.randrange(1000)) for _ in range(n))
    shared = "\n".join(line(8) for _ in range(12))
    passage = line(60)
    around = [(line(9), line(3)) for _ in range(12)]
    rows = [(k, "\n".join([around[k][0], shared if k % 2 else passage, around[k][1]])) for k in range(12)]
    rows += [(20, None), (21, ""), (22, "short\nshort"), (23, "\n\n\n"), (24, shared), (24, shared), (25, passage + "\n" + passage)]
    got = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(k, t if k < 2 else "\n".join(around[k])) for k, t in rows[:12]] + rows[12:16] + [(24, ""), (24, ""), (25, "")]
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == [(k, t or "") for k, t in want]
    assert all("\n".join(r["text"] or "" for r in got).count(x) == 1 for x in [passage, *shared.split("\n")])


@pytest.mark.parametrize("sizes", [[30] * 2, [20] * 4, [45] * 6, [8] * 12, [1] * 60, [60, 3, 3]])
def test_line_dedup_of_runs(spark, sizes):
    """A run of lines of 50 words or more appears once afterwards, whatever its lines are; the lines around it stay."""
    rnd = random.Random(sum(sizes))
    line = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    runs = ["\n".join(map(line, sizes)) for _ in range(8)]
    around = [(line(6), line(7)) for _ in range(48)]
    rows = [(k, "\n".join([around[k][0], runs[k % 8], around[k][1]])) for k in range(48)]
    got = by_id(lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    for k, text in rows:
        assert got[k]["text"] == (text if k < 8 else "\n".join(around[k]))
        assert got[k]["lines_removed"] == (0 if k < 8 else len(sizes))


def test_line_dedup_of_exact_copies(spark):
    """Nothing but white space is left of a copy of two lines with words or more, wherever its chunks end."""
    rnd = random.Random(8)
    line = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    texts = ["\n".join(["", *(line(rnd.choice([1, 4, 9, 60]) if k % 3 else rnd.randint(1, 4)) for _ in range(rnd.randint(2, 12))), "", ""]) for k in range(120)]
    rows = [(k, texts[k % 120]) for k in range(240)]
    got = by_id(lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k]["text"] for k in range(120)] == texts
    assert all(not got[k]["text"].strip() for k in range(120, 240))


def test_line_dedup_of_null_ids_and_hot_parts(spark, monkeypatch):
    """Documents without doc_id are told apart by their texts; a part that all documents have is spread over tasks."""
    monkeypatch.setattr(lines, "HOT", 3)
    rnd = random.Random(5)
    line = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    shared, other = line(60), line(70)
    around = [line(4) for _ in range(40)]
    rows = [(None if k % 4 == 0 else k, "\n".join([around[k], shared, *([other] if k > 37 else [])])) for k in range(40)] + [(None, None), (None, "")]
    got = [r["text"] for r in lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 42 and sum((t or "").count(shared) for t in got) == 1 and sum((t or "").count(other) for t in got) == 1
    assert sorted(t.split("\n")[0] for t in got if t) == sorted(around)


def test_line_dedup_without_passages(spark):
    """With passage 0 only chunks and whole texts of two lines or more go."""
    rnd = random.Random(5)
    line = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    one, many = line(60), "\n".join(line(8) for _ in range(60))
    rows = [(k, "\n".join([line(5), one if k % 2 else many, line(6)])) for k in range(6)]
    got = by_id(lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), passage=0))
    assert [got[k]["text"].count(one) for k in (1, 3, 5)] == [1, 1, 1]
    assert got[0]["lines_removed"] == 0 and 40 <= got[2]["lines_removed"] <= 60


def test_line_dedup_of_overlaps(spark):
    """Of a line that repeats itself the first run of 50 words stays; in a later document all of it goes."""
    rows = [(k, "\n".join([f"first {k}", *["ten words in a line that is once more said"] * 9, f"last {k}"])) for k in (1, 2)]
    got = by_id(lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1]["text"].split("\n") == ["first 1", *["ten words in a line that is once more said"] * 5, "last 1"]
    assert got[2]["text"] == "first 2\nlast 2"


def test_line_dedup_confirms_bytes(spark):
    """Digests only find lines: one goes only if the line that stays for it has the same bytes, also with null doc_ids."""
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\nb\nd"), (None, "b\ne"), (3, "c")]
    own = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.xxhash64("text")).select("doc_id", "x", "text")
    x = {r["text"]: r["x"] for r in own.collect()}
    place = lambda k, line: (rows[k][0], x[rows[k][1]], line)
    said = [(place(2, 1), place(0, 1), True), (place(2, 2), place(0, 2), False), (place(3, 0), place(0, 1), True), (place(0, 1), place(3, 0), True), (place(4, 0), place(0, 2), True), (place(4, 0), place(0, 7), False)]
    pairs = lambda of: spark.createDataFrame([(*p, q) for p, q, _ in of], "doc_id long, x long, line int, other struct<doc_id: long, x: long, line: int>")
    shown = lambda df: sorted((str(r["doc_id"]), r["x"], r["line"], str(r["other"])) for r in df.collect())
    right = [s for s in said if s[2]]
    assert shown(lines.confirmed(own, pairs(said))) == shown(pairs(right)) == shown(lines.confirmed(own, pairs(right)))


@pytest.mark.parametrize("stage", [lines.without_repeated_lines, lambda docs: corpus_pipeline.line_dedup(docs.sparkSession, docs, "")])
def test_line_dedup_of_clashing_digests(spark, monkeypatch, stage):
    """Texts that share no line stay as they are where all their parts have one digest."""
    keys = lines._keys

    def alike(batches, passage):
        for b in keys(batches, passage):
            zero = pa.array(np.zeros(len(b), np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], zero, zero], names=b.schema.names)

    monkeypatch.setattr(lines, "_keys", alike)
    rnd = random.Random(7)
    line = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    rows = [(k, "\n".join(line(rnd.choice([3, 9, 60])) for _ in range(12))) for k in range(12)]
    got = stage(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(1).cast("long"))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == rows


def test_chunks_resist_shifts():
    rnd = random.Random(6)
    text = "\n".join(str(rnd.random()) for _ in range(200))
    a = {"\n".join(text.split("\n")[f : f + n]) for f, n in lines.chunks(text)}
    moved = "new first line\n" + text
    b = {"\n".join(moved.split("\n")[f : f + n]) for f, n in lines.chunks(moved)}
    assert len(a & b) >= len(a) - 2
    assert sum(n for _, n in lines.chunks(text)) == 200 and lines.chunks("") == [(0, 1)]


# ---- 6 -----------------------------------------------------------------------------------------


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(13, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_contamination(spark, docs, none, most):
    long = TEXTS[25].split()
    items = [(1, " ".join(long[:20])), (2, TEXTS[3]), (10, None), (11, ""), (12, "..."), (13, " ".join(TEXTS[71].split()[:30])), (14, " ".join(long[:20])), (15, "café naïve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(contamination.contamination(docs, bench, most_bytes=most))
    for k, t in enumerate(TEXTS):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_hits(t, items), k
    kept = contamination.without_contaminated(docs, bench, most_bytes=most)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["contaminated"]}
    assert contamination.contamination(none, bench, most_bytes=most).collect() == []
    assert all(r["n_hit"] == 0 for r in contamination.contamination(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_contamination_keeps_every_row(spark, most):
    """Rows alike, and rows without doc_id, each get a row, with one block and with many; an item longer than a block is cut."""
    rnd = random.Random(9)
    say = lambda n: " ".join(f"w{rnd.randrange(500)}" for _ in range(n))
    items = [(k, say(rnd.choice([3, 13, 40]))) for k in range(12)] + [(20, say(400)), (21, "x" * 1000), (22, " ".join(["y" * 400] * 14))]
    long = items[12][1].split()
    texts = [" ".join(long[a : a + 30]) + " " + say(20) for a in range(0, 380, 7)] + [say(5) + " " + t + " " + say(9) for _, t in items] + [None, "", "x" * 1000]
    rows = [(k if k % 3 else None, t) for k, t in enumerate(texts)] + [(1, texts[1])] * 3 + [(None, texts[3])] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = contamination.contamination(df, bench, most_bytes=most).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r) for r in got], key=key) == sorted([(k, *brute_hits(t, items)) for k, t in rows], key=key)
    left = contamination.without_contaminated(df, bench, most_bytes=most).collect()
    assert Counter(map(tuple, left)) == Counter(r for r in rows if not brute_hits(r[1], items)[4])


# ---- 7 -----------------------------------------------------------------------------------------

KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute_secrets(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
    return [f"{KINDS[k][0]}:{s}:{e}" for s, k, e in sorted(spans)]


def test_secrets(spark, none):
    rnd = random.Random(1)
    parts = ["token", "=", "password", " ", ":", '"', "abcdef", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJ0123456789", "secret", "api_key", "apikey", "é", "日", "sec", "\n", "Token", "PASSWD", "'", "a", "dead", "ghp_" + "A1" * 20, "ı", "x" * 700]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(400)] + [None, "", "token=token:abcdefg", "a" * 5000, "token" + " " * 3000 + "=" + "s3cret9", "x" * 511 + "password=hunter22"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    for k, r in by_id(secrets.secret_spans(df)).items():
        want = brute_secrets(texts[k])
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")] == want
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(x[0]) for s in want) for x in KINDS]
    assert secrets.secret_spans(none).collect() == []


ADDED = (
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 1),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 40),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 20),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 40),
)


def test_added_kinds_of_secrets(spark):
    rnd = random.Random(12)
    parts = ["-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-----", "gh", "p_", "ghs_", "A1b2" * 9, "xox", "b-", "xoxp-", "12-34-" * 4, "eyJ", ".", "eyJhbGciOi.eyJzdWIiOi.s1g_" + "x" * 30, "é", " ", "ab", "日"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    found = Counter()
    for k, r in by_id(secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).items():
        want = {f"{n}:{m.start()}:{m.end()}" for n, p, least in ADDED for m in p.finditer(texts[k]) if len(m[0].encode()) >= least}
        got = {x for x in r["spans"].split(",") if x and x.split(":")[0] in [a[0] for a in ADDED]}
        assert got == want, texts[k]
        found.update(x.split(":")[0] for x in got)
    assert set(found) == {a[0] for a in ADDED}


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "ab{2,3}c?", "[a-c]+d", r"x\x20*y", "(ab|a)(c|bcd)", "a{3,}"])
def test_automaton(pattern):
    rnd, tree = random.Random(pattern), _Parser(pattern).parse()
    forward, backward, scan = compile_rules([tree], False), compile_rules([reverse(tree)], False), compile_rules([tree], True)
    for _ in range(300):
        t = "".join(rnd.choice("abcdxy ") for _ in range(rnd.randint(0, 14)))
        lengths = [n for n in range(len(t) + 1) if re.fullmatch(pattern, t[:n])]
        assert forward.longest(t.encode(), 0, len(t)) == max([n for n in lengths if n] or [-1])
        starts = [k for k in range(len(t)) if re.fullmatch(pattern, t[k:])]
        assert backward.longest(t.encode(), len(t), 0, -1) == min(starts or [-1])
        ends = [e for e in range(1, len(t) + 1) if any(re.fullmatch(pattern, t[k:e]) for k in range(e))]
        assert scan.ends(np.frombuffer(t.encode(), np.uint8), 4)[0].tolist() == ends


# ---- 10 ----------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, none):
    got = by_id(fingerprints.edited_likeness(docs))
    for k, t in enumerate(TEXTS):
        t, after = t or "", TEXTS[(k + 1) % len(TEXTS)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (shingle_set(x.lower(), 5) for x in (t, edited, after))
        for est, (p, s) in ((r["near_edited"], (a, b)), (r["near_next"], (a, c))):
            real = len(p & s) / len(p | s) if p | s else 1.0
            assert 0 <= est <= 1 and abs(est - real) < 0.2
        if edited == t:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    same = {}
    for k, t in enumerate(TEXTS):
        assert same.setdefault(t or "", got[k]["fingerprint"]) == got[k]["fingerprint"]
    assert len({len(r["fingerprint"]) for r in got.values()}) == 1
    assert fingerprints.edited_likeness(none).collect() == []
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    assert fingerprints.edited_likeness(one).collect()[0]["edited_sha256"] == hashlib.sha256(b"a b c d e f a b").hexdigest()
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "doc_id long, text string")
    assert fingerprints.edited_likeness(twice).count() == 3


def test_fingerprint_hashes_on(spark):
    """An empty bin takes the value of the first filled one that the hash of its number and the try meets, however many tries."""
    n = fingerprints.BINS
    texts = [" ".join(f"v{k}x{j}" for j in range(5 + k % 6)) for k in range(12)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    shingles = F.expr("transform(sequence(0, size(split(text, ' ')) - 5), i -> slice(transform(split(text, ' '), w -> xxhash64(w)), i + 1, 5))")
    hashed = F.transform(shingles, lambda s: F.xxhash64(*[s[j] for j in range(5)]))
    tried = [r["p"] for r in spark.range(n).coalesce(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda j: F.pmod(F.xxhash64(F.col("id").cast("int"), j), F.lit(n))).alias("p")).orderBy("id").collect()]
    for r in fingerprints.with_fingerprint(df, "text", "out").select("out", hashed.alias("h")).collect():
        least = {}
        for h in r["h"]:
            at = (h >> fingerprints.LOW) + n // 2
            least[at] = min(h, least.get(at, h))
        at = [i if i in least else next(p for p in tried[i] if p in least) for i in range(n)]
        assert r["out"] == "".join(f"{least[p] % 256:02x}" for p in at)


def test_fingerprints_of_null_ids(spark):
    rows = [(None, "a b c d e f g h"), (None, None), (None, "z y x w"), (1, "one two three four five six"), (2, "last of all the rows")]
    got = fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((k or 0, len(t or "")) for k, t in rows)
    first = min((r for r in got if r["doc_id"] is None), key=lambda r: r["n_chars"])
    assert first["n_chars"] == 0 and all(r["near_next"] is not None for r in got)


def test_neardup_of_null_ids(spark):
    """A text without any doc_id links two that are too far from each other."""
    words = [f"w{k}" for k in range(400)]
    a, b, c = (" ".join(words[k : k + 340]) for k in (0, 30, 60))
    df = spark.createDataFrame([(1, a), (None, b), (2, c), (3, "some other text that is not like the rest of them")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 5, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 3, None: 1}


def test_neardup_keeps_one_of_null_ids(spark):
    """Of a group whose row with a null doc_id isn't kept, that row goes and others with null doc_ids stay."""
    say = lambda k: " ".join(f"w{k * 50 + i}" for i in range(50))
    rows = [(1, say(1)), (None, say(1) + " x"), (None, say(2)), (None, None), (None, say(3)), (None, say(3) + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.without_near_duplicates(df, 5).collect())
    assert got == sorted((k or 0, t or "") for i, (k, t) in enumerate(rows) if i != 1)


# ---- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(8)
    words = {"en": ["the", "of", "house", "water", "and", "with"], "fr": ["le", "de", "maison", "eau", "avec", "et"]}
    say = lambda lang, n: " ".join(rnd.choice(words[lang]) + str(rnd.randrange(50)) + " " + rnd.choice(words[lang]) for _ in range(n))
    rows = [(k, say(lang, 60), lang, "s", 0) for k in range(40) for lang in [["en", "fr"][k % 2]]]
    near = rows[0][1].split()
    near[5] = "changed"
    item = say("en", 20)
    rows += [(50, " ".join(near), "en", "s", 0), (51, "123 !!", None, None, 0), (52, None, None, None, 0), (53, item + " " + say("en", 30), "en", "s", 0), (54, rows[2][1], "en", "s", 0)]
    d = tmp_path / "sf"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    docs = spark.read.parquet(str(d / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(d))
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r["doc_id"] for r in docs.collect()}
    assert left == set(range(40)), left ^ set(range(40))
    packed = corpus_pipeline.run(spark, str(d)).collect()
    assert {r["doc_id"] for r in packed} == left
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(d)).collect() == []


def test_shared_folder_is_the_session_s(spark):
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs://some/shared/"}

    assert shared_root(Session) == "hdfs://some/shared"


def test_written_tables_can_be_removed(spark):
    among = []
    assert written(spark.range(3), "three", among).count() == 3
    folder = os.path.dirname(among[0].removeprefix("file:").replace("//", "/"))
    assert os.path.isdir(folder)
    removed(spark, among)
    assert among == [] and not os.path.exists(folder)


def test_no_shared_folder_on_a_cluster():
    """Without the setting a cluster is refused; only a local master gets a temporary folder."""

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_root(Session)
