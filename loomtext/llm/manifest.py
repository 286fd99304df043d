"""A Merkle manifest of a dataset: a tree of hashes for each source, one tree over the sources, and a proof for each row."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: The tree over the sources; those of the sources are numbered from 0 in their order.
TOP = -1
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(columns: list) -> F.Column:
    """sha256 (binary) of the columns one after another: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    as_text = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    said = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in as_text]
    return F.unhex(F.sha2(F.concat(*said), 256))


def ranges(a: int, z: int, n: int, arity: int):
    """For each level of a tree of n leaves, of which a task holds a to z: (size, first and last + 1 of the nodes that it can work out
    alone, first and last + 1 of the nodes in the runs that the ways from its leaves to the root pass through)."""
    size, alone, way = n, (a, z), (a, z)
    while True:
        if size == 1:
            yield 1, *alone, 0, 1
            return
        yield size, *alone, way[0] // arity * arity, min(-(-way[1] // arity) * arity, size)
        alone = -(-alone[0] // arity), (-(-alone[1] // arity) if alone[1] == size else alone[1] // arity)
        alone = alone if alone[0] < alone[1] else (0, 0)
        way, size = (way[0] // arity, -(-way[1] // arity)), -(-size // arity)


def built(leaves: bytes, a: int, n: int, arity: int) -> list[bytes]:
    """For each level the nodes that a task with these leaves (hex digits, one after another, the first is a) can work out alone."""
    out, before = [], leaves
    steps = list(ranges(a, a + len(leaves) // HEX, n, arity))
    for (size, first, _, _, _), (_, to, end, _, _) in zip(steps[:-1], steps[1:], strict=True):
        out.append(before)
        runs = ((arity * k - first, min(arity * k + arity, size) - first) for k in range(to, end))
        before = "".join([hashlib.sha256(before[x * HEX : y * HEX]).hexdigest() for x, y in runs]).encode()
    return [*out, before]


# ---- the monoid: forests of nodes whose runs are not whole yet -----------------------------------


def size_at(n: int, level: int, arity: int) -> int:
    for _ in range(level):
        n = -(-n // arity)
    return n


def merged(x: tuple[dict, dict], y: tuple[dict, dict], n_trees: int, arity: int) -> tuple[dict, dict]:
    """The forest of two forests: (open, closed) nodes, each (tree, leaves of the tree, level, index) -> hex digits.

    A run of siblings, whose number the size of its level tells, becomes its parent as soon as all are there; the root of
    a source's tree becomes a leaf of the tree over the sources. Associative and commutative; ({}, {}) is neutral. Closed
    nodes are those that were open in some forest: the seams, which proofs pass through.
    """
    opened, closed, work = {**x[0], **y[0]}, {**x[1], **y[1]}, list(y[0])
    while work:
        tree, n, level, k = key = work.pop()
        if key not in opened:
            continue
        size = size_at(n, level, arity)
        if size == 1 and tree == TOP:
            continue
        first = k // arity * arity
        run = [(tree, n, level, i) for i in range(first, min(first + arity, size))]
        if not all(r in opened for r in run):
            continue
        own = [opened.pop(r) for r in run]
        closed.update(zip(run, own, strict=True))
        parent, value = ((TOP, n_trees, 0, tree), own[0]) if size == 1 else ((tree, n, level + 1, k // arity), hashlib.sha256("".join(own).encode()).hexdigest())
        opened[parent] = value
        work.append(parent)
    return opened, closed


class Part:
    """What one task knows of its rows: the runs of the sources in it, and where they stand in the whole."""

    def __init__(self, table: pa.Table, rank: int, offset: int, n_first: int, n_last: int, n_trees: int, arity: int):
        self.table = table.sort_by("at").combine_chunks()
        self.arity, self.n_trees, self.rank = arity, n_trees, rank
        data = b"".join(self.table["leaf"].to_pylist()).hex().encode()
        source = self.table["source"].to_pylist()
        edges = [0, *(k for k in range(1, len(source)) if source[k] != source[k - 1]), len(source)]
        self.runs = []  # (tree, first leaf, leaves of the tree, levels, first row)
        for j, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            first = offset if j == 0 else 0
            n = n_first if j == 0 else n_last if j == len(edges) - 2 else z - a
            self.runs.append((rank + j, first, n, built(data[a * HEX : z * HEX], first, n, arity), a))
        whole = [(tree, levels[-1]) for tree, first, n, levels, _ in self.runs if len(levels[0]) == n * HEX]
        self.tops = (whole[0][0] if whole else 0, built(b"".join(root for _, root in whole), whole[0][0] if whole else 0, n_trees, arity))

    def trees(self):
        """(tree, first leaf, end, leaves of the tree, levels): the runs, then the tree over the sources."""
        for tree, first, n, levels, _ in self.runs:
            yield tree, first, first + len(levels[0]) // HEX, n, levels
        first, levels = self.tops
        yield TOP, first, first + len(levels[0]) // HEX, self.n_trees, levels

    def open(self):
        """(tree, leaves of the tree, level, index, hex digits) of the nodes whose parents this task can't work out."""
        for tree, first, end, n, levels in self.trees():
            if first == end:
                continue
            steps = list(ranges(first, end, n, self.arity))
            for level, (size, a, z, _, _) in enumerate(steps):
                to, upto = steps[level + 1][1:3] if size > 1 else (0, int(tree != TOP and len(levels[0]) == n * HEX))
                for k in {*range(a, min(z, to * self.arity)), *range(max(a, upto * self.arity), z)} if to < upto else range(a, z):
                    yield tree, n, level, k, levels[level][(k - a) * HEX : (k - a + 1) * HEX].decode()

    def ways(self, tree: int, first: int, end: int, n: int, levels: list[bytes], seams: dict):
        """For each level: (first node, nodes) of the runs that the ways from leaves first to end pass through."""
        a0 = self.tops[0] if tree == TOP else first
        z0 = a0 + len(levels[0]) // HEX
        alone = list(ranges(a0, z0, n, self.arity))
        for level, (_, _, _, lo, hi) in enumerate(ranges(first, end, n, self.arity)):
            _, a, z, _, _ = alone[level]
            left = "".join(seams[tree, level, k] for k in range(lo, min(hi, a) if a < z else hi)).encode()
            own = levels[level][(max(lo, a) - a) * HEX : max(0, min(hi, z) - a) * HEX] if a < z else b""
            right = "".join(seams[tree, level, k] for k in range(max(lo, z), hi)).encode() if a < z else b""
            yield lo, left + own + right

    def paths(self, seams: dict):
        """For each row in order: (subroot, [(left siblings, right siblings)] up to the root). The root is the same for all."""
        trees = [self.rank, self.rank + len(self.runs)]
        top = list(self.ways(TOP, *trees, self.n_trees, self.tops[1], seams))
        for tree, first, n, levels, _ in self.runs:
            end = first + len(levels[0]) // HEX
            ways = list(self.ways(tree, first, end, n, levels, seams))
            above = list(self.path(top, tree, self.n_trees))
            subroot, known = ways[-1][1].decode(), None
            for k in range(first, end):
                if known != k // self.arity:
                    known, upper = k // self.arity, list(self.path(ways, k, n, 1))
                yield subroot, [*self.path(ways[:2], k, n), *upper, *above]
        self.root = top[-1][1].decode()

    def path(self, ways: list, k: int, n: int, level: int = 0):
        size = size_at(n, level, self.arity)
        k //= self.arity**level
        for lo, nodes in ways[level:-1]:
            first = k // self.arity * self.arity
            end = min(first + self.arity, size)
            yield nodes[(first - lo) * HEX : (k - lo) * HEX].decode(), nodes[(k + 1 - lo) * HEX : (end - lo) * HEX].decode()
            k, size = k // self.arity, -(-size // self.arity)


# ---- DataFrames -----------------------------------------------------------------------------------


def _places(summary: list, arity: int) -> tuple[dict, int]:
    """({part: (rank of its first source, first leaf of that, leaves of its first and last sources' trees, rows of both, sources)}, number of sources)."""
    whole, rank, last, before, starts = {}, -1, None, 0, {}
    for r in summary:
        if last is None or r["first"]["source"] != last["source"]:
            rank, before = rank + 1, 0
        starts[r["part"]] = rank, before
        whole[rank] = whole.get(rank, 0) + r["first"]["n"]
        end = rank + r["sources"] - 1
        if end > rank:
            whole[end], before = r["last"]["n"], 0
        before += r["last"]["n"]
        rank, last = end, r["last"]
    out = {}
    for r in summary:
        first, offset = starts[r["part"]]
        out[r["part"]] = first, offset, whole[first], whole[first + r["sources"] - 1], r["first"]["n"], r["last"]["n"], r["sources"]
    return out, rank + 1


def _needs(place: tuple, n_trees: int, arity: int):
    """(tree, leaves of the tree, level, index) of the nodes that the ways of a part's leaves need and the part can't work out."""
    rank, offset, n_first, n_last, rows_first, rows_last, sources = place
    end = rank + sources
    runs = [(rank, offset, offset + rows_first, n_first)] + ([(end - 1, 0, rows_last, n_last)] if sources > 1 else [])
    whole = [tree for tree, a, z, n in runs if z - a == n]
    known = (rank + (rank not in whole), end - (sources > 1 and end - 1 not in whole))
    known = known if known[0] < known[1] else (0, 0)
    for tree, own, way, n in [*((t, (a, z), (a, z), n) for t, a, z, n in runs), (TOP, known, (rank, end), n_trees)]:
        for level, ((_, a, z, _, _), (_, _, _, lo, hi)) in enumerate(zip(ranges(*own, n, arity), ranges(*way, n, arity), strict=True)):
            for k in {*range(lo, min(hi, a)), *range(max(lo, z), hi)} if a < z else range(lo, hi):
                yield tree, n, level, k


def proofs(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", changed: F.Column | None = None, arity: int = 3, parts: int | None = None) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, path) for each row of docs.

    leaf is the hash of the row's columns. The leaves of a source, by ascending doc_id, are hashed in runs of ``arity``, the last
    of which may be shorter, level by level until one node, the subroot, is left; the subroots, by source, are hashed likewise
    to the root. path holds for each level the siblings to the left and to the right, hex digits one after another: the root is
    the fold of ``sha256(left || own || right)`` over it. changed, if given, is another text in place of the last column (null: the same);
    the column changed is the leaf of such a row, null if the text is as it was.

    Only hashes are moved. Rows are dealt into ranges of (source, doc_id), so that a source of any size is spread; each task builds
    what it can of the trees it has rows of, and gives the nodes that are left, some of each level at both ends. ``treeReduce``
    merges these forests into the root. The driver holds the places of the parts and the seams, at most 2 x arity nodes a level for
    each task, whatever the number of rows; each part gets those that its own proofs need.

    Null doc_ids come first, a null source is the first source; rows alike are leaves of their own, next to each other; an empty table gives
    an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    own = leaf_hash(list(columns))
    other = leaf_hash([*columns[:-1], F.coalesce(changed, F.col(columns[-1]))]) if changed is not None else own
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), own.alias("leaf"), (other if changed is not None else F.lit(None).cast("binary")).alias("changed"))
    rows = written(rows.withColumn("changed", F.nullif("changed", "leaf")).withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = ["source", "doc_id", "leaf", "row"]
    ranged = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order).drop("row")
    # a partition's number is in the upper bits, the place in it in the lower ones
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "placed")
    counts = placed.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"))
    one = F.struct("source", "n")
    summary = counts.groupBy("part").agg(F.min(one).alias("first"), F.max(one).alias("last"), F.count(F.lit(1)).alias("sources"))
    places, n_trees = _places(sorted(summary.collect(), key=lambda r: r["part"]), arity)  # a row for each part
    schema = "doc_id long, leaf string, changed string, subroot string, root string, path array<struct<left: string, right: string>>"
    if not places:
        return spark.createDataFrame([], schema)
    known = spark.sparkContext.broadcast({k: v[:4] for k, v in places.items()})  # four numbers for each part

    def part_of(table: pa.Table) -> Part:
        return Part(table, *known.value[table["part"][0].as_py()], n_trees, arity)

    def fragment(table: pa.Table) -> pa.Table:
        c = list(zip(*part_of(table).open(), strict=True))
        return pa.table(dict(zip(("tree", "n", "level", "k", "hash"), c, strict=True)))

    narrow = placed.select("part", "at", "source", "leaf")
    left = written(narrow.groupBy("part").applyInArrow(fragment, "tree long, n long, level long, k long, hash string"), "fragments")
    forests = left.rdd.mapPartitions(lambda it: [({tuple(r[:4]): r[4] for r in it}, {})]).map(lambda f: merged(({}, {}), f, n_trees, arity))
    opened, closed = forests.treeReduce(lambda x, y: merged(x, y, n_trees, arity))
    seams = closed | opened
    if len(opened) != 1:
        raise RuntimeError("nodes are left beside the root")
    needed = [(part, *key[::2], key[3], seams[key]) for part, place in places.items() for key in _needs(place, n_trees, arity)]
    needs = spark.createDataFrame(needed, "part long, tree long, level long, k long, hash string")

    def prove(table: pa.Table, seams: pa.Table) -> pa.Table:
        part = part_of(table)
        ways = list(part.paths({(t, v, k): h for t, v, k, h in zip(*(seams[c].to_pylist() for c in ("tree", "level", "k", "hash")), strict=True)}))
        ends = np.cumsum([0, *(len(p) for _, p in ways)], dtype=np.int32)
        sides = pa.StructArray.from_arrays([pa.array([x[i] for _, p in ways for x in p], pa.string()) for i in (0, 1)], names=["left", "right"])
        hexes = lambda c: pa.array([x and x.hex() for x in part.table[c].to_pylist()], pa.string())
        n = len(ways)
        return pa.table([part.table["doc_id"], hexes("leaf"), hexes("changed"), pa.array([s for s, _ in ways], pa.string()), pa.array([part.root] * n, pa.string()), pa.ListArray.from_arrays(pa.array(ends), sides)], names=["doc_id", "leaf", "changed", "subroot", "root", "path"])

    return placed.groupBy("part").cogroup(needs.groupBy("part")).applyInArrow(prove, schema)


def fold(leaf: F.Column, path: F.Column) -> F.Column:
    """The root that a leaf (hex digits) and a path give."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def verified(docs: DataFrame, changed: F.Column | None = None, **options) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof, folded from the leaf that the row has now.

    proof_sha256 is the hash of all siblings, level by level, left to right. A row whose text is changed folds to another root. Options and odd
    rows: see proofs().
    """
    out = proofs(docs, changed=changed, **options)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_ends(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """The texts of rows whose crc32 of the decimal doc_id is even, without line feeds; others, and rows without doc_id, null."""
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.translate(text_col, "\n", ""))
