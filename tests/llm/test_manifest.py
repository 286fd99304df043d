"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from loomtext.llm import manifest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part long, at long, leaf string, path int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(hashes, arity):
    """(root, for each leaf its siblings left and right by level), every level whole."""
    paths, where, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, k in enumerate(where):
            first = k // arity * arity
            paths[i].append((level[first:k], level[k + 1 : first + arity]))
            where[i] = k // arity
        level = [h(*level[j : j + arity]) for j in range(0, len(level), arity)]
    return level[0], paths


def brute(rows, arity=3):
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    groups = []
    for s in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        groups.append((members, *tree([leaf(r) for r in members], arity)))
    root, tops = tree([g[1] for g in groups], arity)
    out = []
    for (members, subroot, paths), top in zip(groups, tops, strict=True):
        for r, path in zip(members, paths, strict=True):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for left, right in path + top:
                now = h(*left, now, *right)
            proof = h(*(x for left, right in path + top for x in left + right))
            out.append((r[0], leaf(r), subroot, root, proof, now, now == root))
    return out


def made(n, sources):
    rnd = random.Random(n)
    texts = [None, "", "a\nb", "é\n\n日本", "x" * 70000 + "\n", "-", "1:a"]
    rows = [(None if rnd.random() < 0.05 else k, str(k) if sources == n else rnd.choice([None, "", "É", *map(str, range(sources))]), rnd.choice(["en", None]), rnd.choice([None, 5]), rnd.choice(texts), 1, 2, "x", 3) for k in range(n)]
    return rows + rows[:3]  # rows alike


def by_all(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("n", "sources", "arity", "parts"), [(1, 1, 3, None), (120, 2, 3, 1), (120, 2, 3, 7), (61, 61, 3, 5), (200, 9, 3, None), (200, 9, 2, 6), (90, 1, 5, 4)])
def test_manifest(spark, n, sources, arity, parts):
    rows = made(n, sources)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = manifest.verified(df, changed=manifest.without_line_ends(), arity=arity, parts=parts)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_all([tuple(r) for r in out.collect()]) == by_all(brute(rows, arity))


def test_proofs_fold_to_the_root(spark):
    df = spark.createDataFrame(made(40, 3), SCHEMA)
    out = manifest.proofs(df, parts=3).withColumn("folded", manifest.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(out) == 43 and all(r["folded"] == r["root"] and r["changed"] is None for r in out)
    assert manifest.proofs(df.limit(0)).collect() == []


def test_forests_are_a_monoid():
    rnd = random.Random(1)
    hashes = [h(str(k)) for k in range(29)]
    sizes = {0: 17, 1: 1, 2: 11}
    nodes, at = [], 0
    for t, n in sizes.items():
        nodes += [((t, n, 0, k), hashes[at + k]) for k in range(n)]
        at += n
    want = tree([tree(hashes[a:z], 3)[0] for a, z in ((0, 17), (17, 18), (18, 29))], 3)[0]
    for _ in range(20):
        rnd.shuffle(nodes)
        forests = [manifest.merged(({}, {}), ({k: v}, {}), 3, 3) for k, v in nodes]
        while len(forests) > 1:  # any order, any brackets
            j = rnd.randrange(len(forests) - 1)
            forests[j : j + 2] = [manifest.merged(forests[j], forests[j + 1], 3, 3)]
        assert list(forests[0][0].values()) == [want]
        assert manifest.merged(forests[0], ({}, {}), 3, 3) == forests[0]
