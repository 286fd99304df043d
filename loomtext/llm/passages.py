"""Removal of passages that repeat across documents: a count-min prefilter, then exact groups of windows of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _powers, byte_table, fresh, kept_in_worker, mix, nothing_kept, text_slices, word_hashes, written
from .tokens import _file_system

WINDOW = 50
#: Words are what lies between these bytes.
IS_WORD = byte_table(gaps=b"\x20\x09\x0a\x0b\x0c\x0d")
#: Rows of the sketch, and counters (by their bits) that are merged by one task at once.
ROWS, SLICE_BITS = 2, 20
#: Bytes of text for each counter of a row, and the most bits that number a row's counters: 2 x 128 MB where tasks hold the sketch.
BYTES_A_COUNTER, MOST_BITS = 16, 30
#: Keys that have more than one in HOT of all windows, of which there are fewer than HOT, are spread over SALTS tasks.
HOT, SALTS = 1000, 64
#: Words of a block in which bytes are compared.
BLOCK = 64
#: A null doc_id stands before all others.
_NULL = -(1 << 63)


# ---- windows -----------------------------------------------------------------------------------


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n words, by differences of one running sum."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (n - width)], values[n - width :])


def windows(data: np.ndarray, offsets: np.ndarray, window: int):
    """(text, first word in it, hash, anchor) of the windows of texts (see text_slices), and the words' starts, ends and each text's first.

    A window's anchor is the least hash of the runs of window // 2 + 1 words in it: equal windows have equal anchors, and
    neighbours mostly share one, so that a text has few.
    """
    starts, ends, h, _ = word_hashes(data, IS_WORD, lower=False)
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), starts, ends, first
    short = window // 2 + 1
    key, anchor = run_hashes(h, window), least(run_hashes(h, short), window - short + 1)
    at = np.flatnonzero(text[: len(key)] == text[window - 1 :])
    return text[at], at - first[text[at]], key[at], anchor[at], starts, ends, first


def cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each anchor in each row of the sketch."""
    with np.errstate(over="ignore"):
        return [mix(anchors + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits) for k in range(ROWS)]


# ---- the sketch ----------------------------------------------------------------------------------


def sketch_bits(n_bytes: int, most_bits: int = MOST_BITS) -> int:
    return min(most_bits, max(SLICE_BITS, (n_bytes // BYTES_A_COUNTER).bit_length()))


def sketch(texts: DataFrame, window: int, bits: int) -> str:
    """The folder of a written table (slice, repeated): for each counter of the merged sketch a bit, whether it counts two documents or more.

    texts: one column. Each partition counts the anchors of its documents, each once a document; its counters, at most two of one, go
    to the tasks that add up a slice of a row each. An anchor's estimate is the least of its counters, so at least the number
    of documents that have it, and thereby of those that have any window with it.
    """
    slices = 1 << (bits - SLICE_BITS)

    def count(batches):
        nothing_kept()
        for b in batches:
            for _, data, offsets in text_slices(b.column(0)):
                text, _, _, anchor, *_ = windows(data, offsets, window)
                new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(anchor, prepend=anchor[:1] + np.uint64(1)) != 0))
                text, anchor = text[new], anchor[new]
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                anchor = anchor[(np.diff(text, prepend=-1) != 0) | (np.diff(anchor, prepend=anchor[:1] + np.uint64(1)) != 0)]
                for row, cell in enumerate(cells(anchor, bits)):
                    cell, n = np.unique(cell, return_counts=True)
                    cell = np.repeat(cell, np.minimum(n, 2)).astype(np.int64)
                    edges = np.searchsorted(cell, np.arange(slices + 1) << SLICE_BITS)
                    some = np.flatnonzero(np.diff(edges))
                    own = (cell & ((1 << SLICE_BITS) - 1)).astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array(row * slices + some, pa.int32()), pa.array([own[edges[s] : edges[s + 1]].tobytes() for s in some.tolist()], pa.binary())], names=["slice", "cells"])

    def merge(batches):
        at, counts = None, None
        bits_of = lambda: pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "repeated": [np.packbits(counts > 1, bitorder="little").tobytes()]})
        for b in batches:
            for s, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != at:
                    if at is not None:
                        yield bits_of()
                    at, counts = s, np.zeros(1 << SLICE_BITS, np.uint8)
                cell, n = np.unique(np.frombuffer(own, "<u4"), return_counts=True)
                counts[cell] = np.minimum(counts[cell] + np.minimum(n, 2), 2)
        if at is not None:
            yield bits_of()

    parts = texts.mapInArrow(count, "slice int, cells binary")
    paths: list[str] = []
    written(parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, repeated binary"), "sketch", paths)
    return paths[0]


def load_sketch(path: str, bits: int) -> np.ndarray:
    """The bits of a sketch, a row for each of its rows; slices that no one counted in are zeros."""
    out = np.zeros((ROWS << (bits - SLICE_BITS), 1 << (SLICE_BITS - 3)), np.uint8)
    fs, at = _file_system(path)
    for f in fs.get_file_info(pa.fs.FileSelector(at)):
        if f.path.endswith(".parquet"):
            t = pa.parquet.read_table(f.path, filesystem=fs)
            for s, own in zip(t["slice"].to_pylist(), t["repeated"].to_pylist(), strict=True):
                out[s] = np.frombuffer(own, np.uint8)
    return out.reshape(ROWS, -1)


def maybe_repeated(bits_set: np.ndarray, anchors: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch's estimate of each anchor is two documents or more; false only if it is one."""
    out = np.ones(len(anchors), bool)
    for row, cell in zip(bits_set, cells(anchors, bits), strict=True):
        out &= (row[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


# ---- groups ----------------------------------------------------------------------------------------


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """The columns (o, x) that together name a document: doc_id with null as the least, and a digest of the text.

    Each window carries both through the shuffles. Where no doc_id comes twice, which one count tells, the digest is empty.
    """
    o = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL))
    if not docs.select(o.alias("o")).groupBy("o").count().where("count > 1").take(1):
        return o, F.lit(b"")
    return o, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _own(docs: DataFrame, name: tuple[Column, Column], text_col: str) -> DataFrame:
    """(o, x, text): what names a document (see _named), and the text."""
    return docs.select(name[0].alias("o"), name[1].alias("x"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def candidates(own: DataFrame, window: int, path: str, bits: int, key_bits: int = 64) -> DataFrame:
    """(o, x, pos, key) of each window whose anchor the sketch takes for repeated; pos is its first word."""

    def run(batches):
        for b in batches:
            known = kept_in_worker(("sketch", path), lambda: load_sketch(path, bits))
            for at, data, offsets in text_slices(b.column(2)):
                text, pos, key, anchor, *_ = windows(data, offsets, window)
                new = np.diff(anchor, prepend=anchor[:1] + np.uint64(1)) != 0
                some = np.flatnonzero(maybe_repeated(known, anchor[new], bits)[np.cumsum(new) - 1])
                rows = pa.array(text[some] + at)
                key = (key[some] >> np.uint64(64 - key_bits)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(pos[some], pa.int32()), pa.array(key)], names=["o", "x", "pos", "key"])

    return own.mapInArrow(run, "o long, x binary, pos int, key long")


def _hits(found: DataFrame, of: list[str]) -> DataFrame:
    """The windows that start in a document before, with the first place (o, x, pos) of their group as f; of: the columns that name a group.

    Places are aggregated before they are shuffled; a group with more than one in HOT of all windows is spread over SALTS tasks.
    """
    firsts = found.groupBy(*of).agg(F.min(F.struct("o", "x", "pos")).alias("f"), F.max("o").alias("last"), F.count(F.lit(1)).alias("n")).where("f.o < last").select(*of, "f", "n")
    firsts = written(firsts, "firsts")
    total = found.count()
    hot = F.broadcast(firsts.where(F.col("n") > F.lit(total // HOT)).select(*of, F.lit(True).alias("hot")))  # fewer than HOT rows
    dealt = F.when(F.col("hot"), F.pmod(F.xxhash64("o", "x", "pos"), F.lit(SALTS))).otherwise(0).cast("int")
    each = F.explode(F.when(F.col("n") > F.lit(total // HOT), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    rows = found.join(hot, of, "left").withColumn("salt", dealt).drop("hot")
    return rows.join(firsts.select(*of, "f", each.alias("salt")).hint("merge"), [*of, "salt"]).where("o > f.o").drop("salt")


def _runs(hits: DataFrame) -> DataFrame:
    """(o, x, start, n, fo, fx, fpos): runs of n windows one after another whose first places are one after another too."""

    def run(batches):
        for b in batches:
            o, pos, fo, fpos = (np.asarray(b.column(c)) for c in ("o", "pos", "fo", "fpos"))
            x, fx = (np.array(pa.compute.rank(b.column(c), tiebreaker="dense")) for c in ("x", "fx"))
            same = [np.diff(v, prepend=v[:1] - 1) == 0 for v in (o, x, fo, fx)]
            next_ = [np.diff(v, prepend=v[:1] - 5) == 1 for v in (pos, fpos)]
            first = np.flatnonzero(~np.logical_and.reduce(same + next_))
            at = pa.array(first)
            n = np.diff(np.append(first, len(o)))
            yield pa.RecordBatch.from_arrays([b.column("o").take(at), b.column("x").take(at), b.column("pos").take(at), pa.array(n, pa.int32()), *(b.column(c).take(at) for c in ("fo", "fx", "fpos"))], names=["o", "x", "start", "n", "fo", "fx", "fpos"])

    rows = hits.select("o", "x", "pos", F.col("f.o").alias("fo"), F.col("f.x").alias("fx"), F.col("f.pos").alias("fpos"))
    dealt = rows.repartition("o", "x").sortWithinPartitions("o", "x", "pos")
    return dealt.mapInArrow(run, "o long, x binary, start int, n int, fo long, fx binary, fpos int")


def marks(own: DataFrame) -> tuple[str, int]:
    """The folder of a written table (part, marks) with a bit set for each (o, x) in own, by its hash, and the bits of that hash: 16 bits a row, at most 2**MOST_BITS."""
    bits = min(MOST_BITS, max(_PART_BITS, (16 * own.count()).bit_length()))
    cell = F.shiftrightunsigned(F.xxhash64("o", "x"), 64 - bits) + 1
    paths: list[str] = []
    written(own.select(cell.alias("c")).groupBy(F.bitmap_bucket_number("c").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("marks")), "marks", paths)
    return paths[0], bits


def load_marks(path: str, bits: int) -> np.ndarray:
    out = np.zeros((1 << (bits - _PART_BITS), 1 << (_PART_BITS - 3)), np.uint8)
    fs, at = _file_system(path)
    for f in fs.get_file_info(pa.fs.FileSelector(at)):
        if f.path.endswith(".parquet"):
            t = pa.parquet.read_table(f.path, filesystem=fs)
            for part, own in zip(t["part"].to_pylist(), t["marks"].to_pylist(), strict=True):
                out[part - 1] = np.frombuffer(own, np.uint8)
    return out.reshape(-1)


def marked(own: DataFrame, path: str, bits: int) -> DataFrame:
    """The rows of own (o, x, text) whose (o, x) marks may have been given; all that were given are among them. Texts that no one asks for aren't shuffled."""

    def run(batches):
        for b in batches:
            known = kept_in_worker(("marks", path), lambda: load_marks(path, bits))
            cell = np.asarray(b.column(3)).view(np.uint64) >> np.uint64(64 - bits)
            some = known[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 > 0
            yield b.filter(pa.array(some)).select(["o", "x", "text"])

    return own.withColumn("h", F.xxhash64("o", "x")).mapInArrow(run, "o long, x binary, text string")


#: Bits of the places in one of Spark's bitmaps.
_PART_BITS = 15


def words_of(text: str) -> list[str]:
    return [w.decode() for w in text.encode().translate(_GAPS).split(b" ") if w]


_GAPS = bytes(32 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b for b in range(256))


def _wrong(own: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(o, x, start, n) of the runs whose words aren't those of their first places.

    Words are compared in blocks of BLOCK words of the first document. Of a block the distinct words that others have in its
    place are compared, found by an aggregation: a block that very many repeat burdens no task.
    """
    kind = "struct<start: int, n: int, fo: bigint, fx: binary, fpos: int>"
    theirs = runs.select("o", "x", F.struct("start", "n", "fo", "fx", "fpos").alias("run"), F.lit(None).cast("int").alias("block"))
    end = F.col("fpos") + F.col("n") + F.lit(window - 2)  # the last word
    blocks = F.explode(F.sequence(F.expr(f"fpos div {BLOCK}").cast("int"), (end / BLOCK).cast("int"))).alias("block")
    kept = runs.groupBy("fo", "fx", "fpos").agg(F.max("n").alias("n")).select(F.col("fo").alias("o"), F.col("fx").alias("x"), blocks).distinct()
    wanted = theirs.unionByName(kept.select("o", "x", F.lit(None).cast(kind).alias("run"), "block")).groupBy(F.col("o").alias("its_o"), F.col("x").alias("its_x")).agg(F.collect_list("run").alias("runs"), F.collect_list("block").alias("blocks"))
    its = marked(own, *marks(runs.select("o", "x").unionByName(runs.select(F.col("fo").alias("o"), F.col("fx").alias("x"))).distinct()))
    its = its.join(wanted.hint("merge"), (F.col("o") == F.col("its_o")) & (F.col("x") == F.col("its_x"))).select("o", "x", "text", "runs", "blocks")

    def said(batches):
        names = ["o", "x", "block", "lo", "hi", "words", "of_o", "of_x", "start", "n"]
        for b in batches:
            out: list[list] = [[] for _ in names]

            def put(*values, out=out):
                for c, v in zip(out, values, strict=True):
                    c.append(v)

            for o, x, text, own_runs, own_blocks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                for k in own_blocks:
                    put(o, x, k, None, None, " ".join(words[k * BLOCK : (k + 1) * BLOCK]), None, None, None, None)
                for r in own_runs:
                    at, to = r["fpos"], r["fpos"] + r["n"] + window - 1
                    for k in range(at // BLOCK, (to - 1) // BLOCK + 1):
                        lo, hi = max(at, k * BLOCK), min(to, (k + 1) * BLOCK)
                        put(r["fo"], r["fx"], k, lo - k * BLOCK, hi - k * BLOCK, " ".join(words[r["start"] + lo - at : r["start"] + hi - at]), o, x, r["start"], r["n"])
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    said_ = written(its.mapInArrow(said, "o long, x binary, block int, lo int, hi int, words string, of_o long, of_x binary, start int, n int"), "said")
    place = ["o", "x", "block"]
    of_first = said_.where("lo IS NULL").select(*place, F.col("words").alias("kept"))
    others = said_.where("lo IS NOT NULL").select(*place, "lo", "hi", "words").distinct()
    part = F.array_join(F.slice(F.split("kept", " "), F.col("lo") + 1, F.col("hi") - F.col("lo")), " ")
    unlike = written(others.join(of_first.hint("merge"), place).where(F.col("words") != part).select(*place, "lo", "hi", "words"), "unlike")
    return said_.where("lo IS NOT NULL").join(unlike, [*place, "lo", "hi", "words"], "left_semi").select(F.col("of_o").alias("o"), F.col("of_x").alias("x"), "start", "n").distinct()


def _window_words(own: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """found (o, x, pos, key) with the words of each window."""
    lists = found.groupBy(F.col("o").alias("its_o"), F.col("x").alias("its_x")).agg(F.collect_list(F.struct("pos", "key")).alias("at"))

    def say(batches):
        for b in batches:
            rows = [(o, x, r["pos"], r["key"], " ".join(words[r["pos"] : r["pos"] + window])) for o, x, text, at in zip(*(c.to_pylist() for c in b.columns), strict=True) for words in [words_of(text)] for r in at]
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["o", "x", "pos", "key", "words"])

    its = own.join(lists.hint("merge"), (F.col("o") == F.col("its_o")) & (F.col("x") == F.col("its_x"))).select("o", "x", "text", "at")
    return its.mapInArrow(say, "o long, x binary, pos int, key long, words string").distinct()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_bits: int = MOST_BITS, key_bits: int = 64, name: tuple[Column, Column] | None = None) -> DataFrame:
    """(o, x, start, words): for each document the runs of words that repeat those of documents with a smaller doc_id; o and x as in _named.

    The sketch of the first scan tells which windows may be repeated; the second scan gives these with a 64-bit hash, and they are grouped by it. Then the words of
    each run are compared with those at its first place. Where hashes clashed, all windows of these hashes are grouped by their words.
    """
    own = _own(docs, name or _named(docs, id_col, text_col), text_col)
    n_bytes = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = sketch_bits(n_bytes, most_bits)
    path = sketch(own.select("text"), window, bits)
    found = written(candidates(own, window, path, bits, key_bits), "windows")
    hits = _hits(found, ["key"])
    runs = written(_runs(hits), "runs")
    wrong = written(_wrong(own, runs, window), "wrong")
    if not wrong.take(1):
        return runs.select("o", "x", "start", (F.col("n") + F.lit(window - 1)).alias("words"))
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("n"))
    clashing = written(found.join(wrong, ["o", "x"]).where(inside).select("key").distinct(), "clashing")
    exact = _hits(written(_window_words(own, found.join(clashing, "key", "left_semi"), window), "exact"), ["key", "words"])
    right = hits.join(clashing, "key", "left_anti")
    again = _runs(right.select("o", "x", "pos", "f").unionByName(exact.select("o", "x", "pos", "f")))
    return written(again, "runs").select("o", "x", "start", (F.col("n") + F.lit(window - 1)).alias("words"))


def without_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_bits: int = MOST_BITS, key_bits: int = 64) -> DataFrame:
    """docs, all columns, with ``kept`` (the words that stay, joined by one space), ``n_words`` and ``n_removed``.

    A window is ``window`` consecutive words of a document, as they are. Each word in a window whose words also start in a document with a smaller
    doc_id goes; windows are judged on the input. A first scan counts windows in a count-min sketch, by their anchors; a second one groups exactly those
    that it takes for repeated. Estimates are never too low, so that none is lost. The sketch has a counter for each BYTES_A_COUNTER bytes of
    text and at most 2**most_bits a row: beyond 16 GB of text with the default it lets more windows through, which costs time, not rows.

    Null and empty texts have no words. A null doc_id stands before all others; rows with one doc_id don't repeat each other, and rows alike get rows
    alike. An empty table gives an empty one. Columns of docs named kept, n_words or n_removed are replaced.
    """
    o_, x_, id_, of_, runs_ = fresh(docs, "_o", "_x", "_id", "_of", "_runs")
    name = _named(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col, window, most_bits, key_bits, name)
    lists = spans.distinct().groupBy(F.col("o").alias(id_), F.col("x").alias(of_)).agg(F.collect_list(F.struct("start", "words")).alias(runs_))
    named = docs.drop("kept", "n_words", "n_removed") if text_col not in ("kept", "n_words", "n_removed") else docs
    named = named.withColumn(o_, name[0]).withColumn(x_, name[1])
    both = named.join(lists.hint("merge"), (F.col(o_) == F.col(id_)) & (F.col(x_) == F.col(of_)), "left").drop(o_, x_, id_, of_)
    names = [c for c in both.columns if c != runs_]
    k = names.index(text_col)

    def run(batches):
        nothing_kept()
        for b in batches:
            kept, n_words, n_removed = [], [], []
            for text, runs in zip(b.column(k).to_pylist(), b.column(runs_).to_pylist(), strict=True):
                words = words_of(text or "")
                gone = bytearray(len(words))
                for r in runs or []:
                    gone[r["start"] : r["start"] + r["words"]] = b"\1" * r["words"]
                n_words.append(len(words))
                n_removed.append(sum(gone))
                kept.append(" ".join([w for w, g in zip(words, gone, strict=True) if not g]) if runs else " ".join(words))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "kept", "n_words", "n_removed"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name != runs_] + ["kept string", "n_words long", "n_removed long"])
    return both.mapInArrow(run, schema)
