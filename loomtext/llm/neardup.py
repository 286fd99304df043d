"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full sets of shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, byte_table, column_slices, fresh, gathered, mix, nothing_kept, removed, text_bytes, written

#: Half-keys in each of the two collections, and minima in a half-key. A table's key combines a half-key of either
#: collection: HALVES**2 tables of 2 * WIDTH minima from 2 * HALVES * WIDTH minima in all. At similarity s a pair
#: is missed with probability 1 - (1 - (1 - s**WIDTH)**HALVES)**2: 0.0004 at 0.8, 0.00002 at 0.85.
HALVES, WIDTH = 12, 3
LINK = 0.8
#: Rounds of leaders; what they leave far from all leaders is compared within its buckets, in blocks.
ROUNDS = 3
#: Shingles in a block of documents that one task compares with another.
BLOCK_SHINGLES = 100_000
#: Keys over which the nodes of one group are spread where they meet the group's sizes.
SALTS = 32
#: Bytes of text looked at at once.
SLICE = 2 << 20
IS_WORD = byte_table(gaps=b"\x20\x09\x0a\x0b\x0c\x0d")
_STEP = np.uint64(0xD1342543DE82EF95)
_SEEDS = mix(np.arange(1, 4 * HALVES * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """(first, number, distinct): the words of text k, A-Z in lower case, are distinct[number[first[k] : first[k + 1]]]."""
    data, offsets = text_bytes(column)
    low = _LOWER[data]
    inside = IS_WORD[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    packed = low[inside]
    starts = np.append(np.flatnonzero(begins[inside]), len(packed)).astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(packed)]).dictionary_encode()
    return np.searchsorted(np.flatnonzero(begins), offsets), np.asarray(coded.indices).astype(np.int64), coded.dictionary


def shingle_sets(column: pa.Array, words: int):
    """For runs of texts: (first of each text's shingles, hashes of 64 bits, sorted and distinct in a text, further 64 bits of them).

    A shingle's hash is made of 128-bit hashes of its words. A text of fewer words has all of them as its one shingle;
    one without words has none.
    """
    for _, texts in column_slices(column, SLICE):
        first, number, distinct = words_of(texts)
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in distinct.to_pylist()]), np.uint64).reshape(-1, 2)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        short = np.flatnonzero((n > 0) & (n < words))
        whole = doc[: max(0, len(doc) - words + 1)] == doc[words - 1 :]
        of, parts = np.concatenate([doc[: len(whole)][whole], short]), []
        for h in (both[:, 0][number], both[:, 1][number]):
            s = np.zeros(len(whole), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(words):
                    s = s * _STEP + h[k : k + len(s)]
                more = []
                for d in short:
                    x = np.uint64(n[d])
                    for w in h[first[d] : first[d + 1]]:
                        x = x * _STEP + w
                    more.append(x)
                parts.append(mix(np.concatenate([s[whole], np.array(more, np.uint64)])))
        order = np.lexsort((parts[1], parts[0], of))
        s, more, of = parts[0][order], parts[1][order], of[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (more[1:] != more[:-1]) | (of[1:] != of[:-1])
        s, more, of = s[new], more[new], of[new]
        yield np.searchsorted(of, np.arange(len(n) + 1)), s, more


def exact_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, shingles): the sorted sets of shingles of text k, shingles[first[k] : first[k + 1]], as numbers that are equal for equal shingles only.

    Numbers, not hashes: words are numbered by a dictionary and runs of words by the distinct pairs of shorter runs.
    They are good for the texts of this call.
    """
    first, number, distinct = words_of(column)
    n, total, base = np.diff(first), len(number), max(len(distinct), 1)
    doc = np.repeat(np.arange(len(n)), n)

    def runs(length: int) -> tuple[np.ndarray, int]:
        if length == 1:
            return number, base
        half = length // 2 if length % 2 == 0 else length - 1
        x, size = runs(half)
        y, by = (x[half:], size) if length % 2 == 0 else (number[half:], base)
        keys = x[: max(0, total - length + 1)] * by + y[: max(0, total - length + 1)]
        kinds, out = np.unique(keys, return_inverse=True)
        return out, max(len(kinds), 1)

    s = runs(words)[0]
    whole = doc[: len(s)] == doc[words - 1 :] if len(s) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < words))
    kinds: dict[bytes, int] = {}
    few = np.array([-1 - kinds.setdefault(number[first[d] : first[d + 1]].tobytes(), len(kinds)) for d in short], np.int64)
    s, of = np.concatenate([s[whole], few]), np.concatenate([doc[: len(s)][whole], short])
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return np.searchsorted(of[new], np.arange(len(n) + 1)), s[new]


def _set_hashes(first: np.ndarray, s: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of the sets, two of 64 bits, 0 for empty ones."""
    size = np.diff(first)
    some = np.flatnonzero(size)
    out = np.zeros((2, len(size)), np.uint64)
    if len(some):
        with np.errstate(over="ignore"):
            for k, x in enumerate((s, more)):
                out[k, some] = mix(np.add.reduceat(mix(x ^ _SEEDS[-1 - k]), first[:-1][some]) + size[some].astype(np.uint64))
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, x, n, h1, h2, halves) of (doc_id, x, text): size of the set of shingles, its hashes, and the half-keys; the lowest bit of one tells its collection."""

    def run(batches):
        nothing_kept()
        for b in batches:
            n, sums, halves = [np.zeros(0, np.int64)], [np.zeros((2, 0), np.uint64)], [np.zeros((0, 2 * HALVES), np.uint64)]
            for first, s, more in shingle_sets(b.column(2), words):
                size = np.diff(first)
                some = np.flatnonzero(size)
                keys = np.zeros((len(size), 2 * HALVES), np.uint64)
                if len(some):
                    at = first[:-1][some]
                    with np.errstate(over="ignore"):
                        for k in range(2 * HALVES):
                            key = np.full(len(some), _SEEDS[k], np.uint64)
                            for j in range(WIDTH):
                                x = (s ^ _SEEDS[k * WIDTH + j]) * (_SEEDS[2 * HALVES * WIDTH + k * WIDTH + j] | np.uint64(1))
                                key = mix(key * _STEP + np.minimum.reduceat(x ^ (x >> np.uint64(32)), at))
                            keys[some, k] = (key & ~np.uint64(1)) | np.uint64(k >= HALVES)
                n.append(size)
                sums.append(_set_hashes(first, s, more))
                halves.append(keys)
            h = np.concatenate(sums, axis=1).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * 2 * HALVES), pa.array(np.concatenate(halves).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n).astype(np.int64)), pa.array(h[0]), pa.array(h[1]), flat], names=["doc_id", "x", "n", "h1", "h2", "halves"])

    return docs.mapInArrow(run, "doc_id long, x long, n long, h1 long, h2 long, halves array<long>")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(y) else 0


def _compared(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, leader, both, either): sizes of intersection and union for the pairs (node, leader), worked out on whole texts."""

    def run(batches):
        nothing_kept()
        for b in batches:
            sizes = np.cumsum(np.asarray(pa.compute.binary_length(b.column(2))).astype(np.int64)) // SLICE
            edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(b)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(a, z - a)
                leaders = part.column(3).dictionary_encode()  # the same for many rows
                first, s = exact_sets(pa.concat_arrays([part.column(2), leaders.dictionary]), words)
                both = np.array([_common(s[first[k] : first[k + 1]], s[first[q] : first[q + 1]]) for k, q in enumerate((np.asarray(leaders.indices) + len(part)).tolist())], np.int64)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both), pa.array(n[: len(part)] + n[len(part) :][np.asarray(leaders.indices)] - both)], names=["node", "leader", "both", "either"])

    left = pairs.join(_grown(texts.withColumnRenamed("text", "p")), "node")
    right = texts.select(F.col("node").alias("leader"), F.col("text").alias("q"))
    return left.join(_grown(right), "leader").select("node", "leader", "p", "q").mapInArrow(run, "node long, leader long, both long, either long")


def _grown(df: DataFrame) -> DataFrame:
    """df, never broadcast by a join. It grows with the documents; Spark takes its size from compressed files, without the rows that explode makes of one."""
    return df.hint("merge")


def _linked(percent: int):
    return F.col("both") * 100 >= F.col("either") * percent


def components(edges: DataFrame, among: list[str] | None = None) -> DataFrame:
    """(node, root) for the nodes of edges (u, v): root is the least node that can be reached, for all others than the roots.

    Large-star and small-star steps by turns until nothing changes; each is an aggregation and a join,
    and every result is a written table, which the next step's replaces. The last is added to among.
    """
    spark, was_at, now_at = edges.sparkSession, [], []
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", now_at)
    state = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    was = state(now)
    while was["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(_grown(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_grown(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        was_at, now_at = now_at, []
        now = written(small, "edges", now_at)
        removed(spark, was_at)
        if (is_now := state(now)) == was:
            break
        was = is_now
    if among is not None:
        among += now_at
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _block_links(rows, words: int, percent: int):
    """Pairs of components that links join: between the texts of two blocks, those with side 1 and those with side 0. Columns side, comp, text."""
    side, comp = (rows.column(c).to_numpy() for c in ("side", "comp"))
    first, s = exact_sets(rows.column("text").combine_chunks(), words)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1).tolist()
    size = np.diff(first)
    flat = s[gathered(first[:-1][left], size[left])]
    owner = np.repeat(np.arange(len(left)), size[left])
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while up.setdefault(k, k) != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out = []
    for k in right:
        own = s[first[k] : first[k + 1]]
        a, z = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        both = np.bincount(owner[gathered(a, z - a)], minlength=len(left))
        either = size[left] + len(own) - both
        for i in np.flatnonzero((both * 100 >= either * percent) & (both > 0)).tolist():
            p, q = root(int(comp[left[i]])), root(int(comp[k]))
            if p != q:
                up[p] = q
                out.append((p, q))
    return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})


def _strays(rows: DataFrame, made: DataFrame, words: int, among: list[str]) -> DataFrame | None:
    """(its_id, its_x, tag): the documents whose sets aren't those of the others with the same hashes; None if there are none.

    Texts of one hash are grouped by their bytes, which takes care of copies before anything is shuffled for them; a text that differs from the
    least of its hash is compared with that, set by set. One with another set gets a tag of its own, so that it is a node of its own.
    """
    crowd = made.where("n > 0").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h1", "h2")
    members = made.select(F.col("doc_id").alias("its_id"), F.col("x").alias("its_x"), "h1", "h2").join(_grown(crowd), ["h1", "h2"]).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("x") == F.col("its_x"))
    said = rows.join(_grown(members), same).select("doc_id", "x", "h1", "h2", "text")
    texts = written(said.groupBy("h1", "h2", "text").agg(F.count(F.lit(1)).alias("times")), "said", among)
    several = texts.groupBy("h1", "h2").agg(F.min("text").alias("first"), F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h1", "h2", "first")

    def apart(batches):
        nothing_kept()
        for b in batches:
            for at, part in column_slices(b.column(2), SLICE):
                firsts = b.column(3).slice(at, len(part)).dictionary_encode()  # the same for many rows
                first, s = exact_sets(pa.concat_arrays([part, firsts.dictionary]), words)
                other = np.asarray(firsts.indices) + len(part)
                differ = [not np.array_equal(s[first[k] : first[k + 1]], s[first[q] : first[q + 1]]) for k, q in enumerate(other.tolist())]
                yield b.slice(at, len(part)).select(["h1", "h2", "text"]).filter(pa.array(differ, pa.bool_()))

    pairs = texts.join(_grown(several), ["h1", "h2"]).where("text <> first").select("h1", "h2", "text", "first")
    strays = written(pairs.mapInArrow(apart, "h1 long, h2 long, text string"), "strays", among)
    if not strays.take(1):
        return None
    tagged = written(strays.withColumn("tag", F.monotonically_increasing_id() + 1), "tagged", among)
    return said.join(_grown(tagged), ["h1", "h2", "text"]).select(F.col("doc_id").alias("its_id"), F.col("x").alias("its_x"), "tag").distinct()


def judged(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates() with x, the hash of the row's text."""
    far = 1 - percent / 100
    spark, among, mine_at = docs.sparkSession, [], []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("x", F.xxhash64("text"))
    made = written(sketches(rows.select("doc_id", "x", "text"), words), "sketches", mine_at)
    if (strays := _strays(rows, made, words, mine_at)) is None:
        made = made.withColumn("tag", F.lit(0).cast("long"))
    else:
        ids = [F.col("doc_id").eqNullSafe(F.col("its_id")), F.col("x") == F.col("its_x")]
        made = made.join(_grown(strays), ids, "left").drop("its_id", "its_x").withColumn("tag", F.coalesce("tag", F.lit(0)))
        made = written(made, "told_apart", mine_at)
    # 1. nodes and half-keys
    alike = made.where("n > 0").groupBy("h1", "h2", "tag").agg(F.min("doc_id").alias("least"), F.first(F.struct("doc_id", "x")).alias("row"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    nodes = written(alike.withColumn("node", F.monotonically_increasing_id()), "nodes")
    all_nodes = _grown(nodes)
    keys = nodes.select("node", "n", F.explode("halves").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    mine = keys.join(_grown(shared), "key").groupBy("node", "n").agg(F.sum("times").alias("lead"), F.collect_list("key").alias("keys"))
    side = lambda s: F.filter("keys", lambda k: k.bitwiseAND(F.lit(1)) == s)
    tables = F.flatten(F.transform(side(0), lambda a: F.transform(side(1), lambda b: F.xxhash64(a, b))))
    members = written(mine.select("node", "n", "lead", tables.alias("tables")).where(F.size("tables") > 0), "members", among)
    buckets = members.select("node", "n", "lead", F.explode("tables").alias("bucket"))
    # 2. rounds of leaders
    texts, found = None, []
    for _ in range(ROUNDS):
        leaders = buckets.groupBy("bucket").agg(F.max(F.struct("lead", "node", "n")).alias("l"), F.count(F.lit(1)).alias("times")).where("times > 1")
        led = buckets.join(_grown(leaders), "bucket").where("node <> l.node").select("bucket", "node", "n", "lead", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n"))
        led = written(led, "led", among)
        pairs = written(led.select("node", "leader", "n", "leader_n").distinct(), "pairs", among)
        if not pairs.take(1):
            break
        if texts is None:
            wanted = pairs.select("node").union(pairs.select("leader")).distinct().join(all_nodes, "node").select("node", F.col("row.doc_id").alias("its_id"), F.col("row.x").alias("its_x"))
            its = rows.join(_grown(wanted), F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("x") == F.col("its_x")))
            texts = written(its.groupBy("node").agg(F.first("text").alias("text")), "texts", among)  # rows alike once
        # sets whose sizes alone keep them apart need no comparing
        apart = F.least("n", "leader_n") < F.greatest("n", "leader_n") * F.lit(1 - 3 * far)
        compared = written(_compared(pairs.where(~apart).select("node", "leader"), texts, words), "compared", among)
        found.append(compared)
        near = compared.where(F.col("both") > F.col("either") * F.lit(1 - 2 * far)).select("node", "leader")
        buckets = led.join(_grown(near), ["node", "leader"], "left_anti").select("node", "n", "lead", "bucket")
    nodes_of = nodes.select("h1", "h2", "tag", "node", "least")
    if found:
        # what is in a component: a small table, told from which the least doc_id of a root comes, before all nodes are touched
        comps, roots = _roots(found, buckets, all_nodes, texts, words, percent, far, among)
        salt, each = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        alone = comps.select("comp").union(roots.select("comp")).union(roots.select("root")).distinct().select(F.col("comp").alias("node"), "comp")
        member = comps.select("node", "comp").unionByName(alone.join(_grown(comps.select("node")), "node", "left_anti")).withColumn("salt", salt)
        member = member.join(_grown(roots.select("comp", "root").withColumn("salt", each)), ["comp", "salt"], "left").select("node", F.coalesce("root", "comp").alias("root"))
        member = written(member.join(_grown(nodes.select("node", "least")), "node"), "roots", among)
        least = member.groupBy("root").agg(F.min("least").alias("of_root")).withColumn("salt", each)
        moved = member.select("node", "root", salt.alias("salt")).join(_grown(least), ["root", "salt"]).select("node", "of_root")
        nodes_of = nodes_of.join(_grown(moved), "node", "left").withColumn("least", F.when(F.col("of_root").isNotNull(), F.col("of_root")).otherwise(F.col("least")))
        nodes_of = written(nodes_of.select("h1", "h2", "tag", "least"), "leasts")
    removed(spark, among)
    out = made.select("doc_id", "x", "n", "h1", "h2", "tag").join(_grown(nodes_of.select("h1", "h2", "tag", "least")), ["h1", "h2", "tag"], "left")
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "x")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = int(LINK * 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of shingles; component_id is
    the least doc_id that links lead to and kept tells that it is the row's own.

    1. Documents with the same set are one node: 128 bits of hash find them, then their bytes are compared, and their sets where bytes differ. Two collections of half-keys are made of minima
       over the set; a half-key that no other node has is dropped, and every remaining one of the first with every
       one of the second makes the key of a table.
    2. In each bucket the node that shares most half-keys leads, and every other is compared with it on whole texts, shingle
       by shingle. No pair of two others is made. Jaccard distance is a metric, so with 1 - percent/100 = d a node farther
       than 3d from the leader has no link to one within 2d: nodes farther than 2d go on to a round with another leader.
    3. Nodes within 3d of a leader form groups, by connected components, and so do the nodes of a bucket that are left
       after ROUNDS rounds. In a group that its links leave in several components, all nodes but those of the
       largest component are compared with every node, in pairs of blocks of bounded size. Work on a group grows with its
       size times that of this rest, which is what copies near the threshold leave.
    4. Components of all links.

    Texts are shuffled to the nodes that share a bucket only. Null and empty texts, and those without words, are
    linked with nothing. Rows alike in doc_id, or in text, are linked if their sets are. A null doc_id is no
    component_id if another can be reached; where none can, component_id is null and the row is kept. An empty table
    gives an empty result. Other columns aren't read.
    """
    return judged(docs, words, percent, id_col, text_col).drop("x")


def _roots(found: list[DataFrame], buckets: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int, far: float, among: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node, comp) and (comp, root): components by the links with leaders, and what links within the groups that these leave open join them to.

    Only the links with leaders go through components() node by node; all else is between components.
    """
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    close = every.where(F.col("both") >= F.col("either") * F.lit(1 - 3 * far)).withColumn("linked", _linked(percent))
    comps = components(close.where("linked").select(F.col("node").alias("u"), F.col("leader").alias("v")), among).withColumnRenamed("root", "comp")
    of = lambda df, c, out: df.join(_grown(comps.select(F.col("node").alias(c), F.col("comp").alias("_comp"))), c, "left").withColumn(out, F.coalesce("_comp", c)).drop("_comp")
    # groups of components that are near each other, and buckets whose nodes are left
    open_pairs = of(of(close.where(~F.col("linked")).select("node", "leader"), "node", "u"), "leader", "v").where("u <> v").select("u", "v").distinct()
    groups = components(open_pairs, among)
    grouped = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("comp"), "root")
    salt = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(SALTS)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    met = close.select("node").union(close.select("leader")).distinct()
    # a component, or group, of any size is spread over SALTS keys where it meets the few rows that say where it belongs
    inside = of(met, "node", "comp").withColumn("salt", salt).join(_grown(grouped.withColumn("salt", each)), ["comp", "salt"]).select("root", "node", "comp")
    rest = inside.unionByName(of(buckets.select(F.col("bucket").alias("root"), "node"), "node", "comp").select("root", "node", "comp"))
    rest = written(rest.join(nodes, "node").select("root", "node", "comp", "n"), "rest", among)
    if not rest.take(1):  # no group is open
        return comps, comps.limit(0).select("comp", F.col("comp").alias("root"))
    # in groups of several components: sizes of all, and of all but the largest
    by_comp = rest.groupBy("root", "comp").agg(F.sum("n").alias("size"))
    of_all = by_comp.groupBy("root").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda size: F.ceil(size / BLOCK_SHINGLES).cast("int")
    of_all = of_all.select("root", F.col("main.comp").alias("main"), blocks(F.col("size")).alias("blocks"), blocks(F.col("size") - F.col("main.size")).alias("rests"))
    dealt = rest.withColumn("salt", salt).join(_grown(of_all.withColumn("salt", each)), ["root", "salt"])
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    zero = dealt.withColumn("i", part(3, "blocks")).withColumn("j", upto("rests")).withColumn("side", F.lit(0))
    one = dealt.where("comp <> main").withColumn("j", part(4, "rests")).withColumn("i", upto("blocks")).withColumn("side", F.lit(1))
    both = zero.unionByName(one).select(F.xxhash64("root", "i", "j").alias("task"), "side", "node", "comp")
    more = both.join(_grown(texts), "node").groupBy("task").applyInArrow(lambda t: _block_links(t, words, percent), "u long, v long")
    return comps, components(more).withColumnRenamed("node", "comp")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = int(LINK * 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component: that of the least doc_id. Rows alike in doc_id and text stay or go together; see near_duplicates."""
    id_, x_ = fresh(docs, "_gone", "_x")
    gone = judged(docs, words, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_), F.col("x").alias(x_)).distinct()
    return docs.join(_grown(gone), F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(x_)), "left_anti")
