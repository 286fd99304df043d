"""Pieces that several operators share: written tables, distributed ranks and byte scans."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one ordered window handles; ranks are offset by counts of the windows before.
ROWS_A_BUCKET = 1024
#: Rows that go to a Python worker at once while a table is written: whole texts, which both sides hold.
ARROW_ROWS, ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 2500


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's ``spark.checkpoint.dir``.

    Only a local master, as in tests, whose executors are the driver itself, may do without: a temporary
    folder takes its place. On a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomtext-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, name: str, among: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputing.

    The table's folder is added to among, which removed() takes when no more is read from it.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/loomtext-{uuid.uuid4().hex}/{name}"
    schema = df.schema
    rows = spark.conf.get(ARROW_ROWS)  # 0 and less: no limit
    if not 0 < int(rows) <= ROWS_A_BATCH:
        spark.conf.set(ARROW_ROWS, ROWS_A_BATCH)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    if among is not None:
        among.append(path)
    return spark.read.schema(schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing will read any more, through Spark's own file systems."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


_KEPT: dict = {}


def kept_in_worker(key, make):
    """What make() gave for key, kept by this worker process until a task asks for another key.

    A worker serves the tasks of many stages one after another. It keeps one tool at a time, a tokenizer or a language
    model, so that what stages before have left doesn't add up.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def nothing_kept() -> None:
    """Let this worker process drop what kept_in_worker() keeps, and give free memory back to the system: for tasks that use no tool."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores before them until df has no such columns."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        out.append(n)
    return out


def bucket_bits(total: int) -> int:
    """Bits of a hash that deal total rows into buckets of about ROWS_A_BUCKET."""
    return max(0, (max(total, 1) // ROWS_A_BUCKET).bit_length())


def running_before(counts: DataFrame, order: str, n: str, by: list[str], out: str) -> DataFrame:
    """counts with out: the sum of n over the rows before in its group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn(out, F.sum(n).over(w) - F.col(n))


def hash_rank(df: DataFrame, group: str, key: str, ties: list[str], total: int, out: str) -> DataFrame:
    """out: 0-based rank of each row within its group, by the hash in key, then ties.

    No task gets a whole group: the upper bits of the hash deal a group into buckets, each ranked
    alone, and a bucket's rank starts at the count of the buckets before, a running sum over two levels. Null
    groups are a group.
    Also adds ``{out}_of``, the group's number of rows.
    """
    bits = bucket_bits(total)
    deal = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    dealt = df.withColumn("_g", F.struct(F.col(group).alias("v"))).withColumn("_b", deal)
    counts = dealt.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.floor(F.col("_b") / ROWS_A_BUCKET))
    fine = running_before(counts, "_b", "_n", ["_g", "_c"], "_fine")
    sums = running_before(counts.groupBy("_g", "_c").agg(F.sum("_n").alias("_m")), "_c", "_m", ["_g"], "_base").withColumn("_of", F.sum("_m").over(Window.partitionBy("_g")))
    counts = fine.join(sums, ["_g", "_c"]).select("_g", "_b", (F.col("_fine") + F.col("_base")).alias("_before"), "_of")
    within = F.row_number().over(Window.partitionBy("_g", "_b").orderBy(key, *ties)) - 1
    ranked = dealt.withColumn("_r", within).join(counts, ["_g", "_b"])
    return ranked.withColumn(out, F.col("_before") + F.col("_r")).withColumn(f"{out}_of", F.col("_of")).drop("_g", "_b", "_r", "_before", "_of")


def ordered_position(df: DataFrame, place: str, ties: list[str], total: int, out: str) -> DataFrame:
    """out: 0-based position of each row in the order of place (0 to 1, spread evenly), then ties.

    Buckets of place are ranked alone; their bases are running sums over two levels of counts.
    """
    n = max(1, total // ROWS_A_BUCKET)
    dealt = df.withColumn("_b", F.least(F.floor(F.col(place) * n), F.lit(n - 1)).cast("long"))
    counts = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.floor(F.col("_b") / ROWS_A_BUCKET))
    fine = running_before(counts, "_b", "_n", ["_c"], "_fine")
    coarse = running_before(counts.groupBy("_c").agg(F.sum("_n").alias("_m")).withColumn("_all", F.lit(0)), "_c", "_m", ["_all"], "_base")
    bases = fine.join(coarse.select("_c", "_base"), "_c").select("_b", (F.col("_fine") + F.col("_base")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(place, *ties)) - 1
    ranked = dealt.withColumn("_r", within).join(bases, "_b")
    return ranked.withColumn(out, F.col("_before") + F.col("_r")).drop("_b", "_r", "_before")


# ---- scans of bytes: one numpy pass over many texts -------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, modulo 2**64, grown as needed."""
    have = _powers.__dict__.setdefault("have", {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)})
    if len(have["up"]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for k, b in (("up", _BASE), ("down", inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                have[k] = np.multiply.accumulate(p)
    return have["up"], have["down"]


def byte_table(word: bytes | None = None, gaps: bytes = b"") -> np.ndarray:
    """For each byte whether it belongs to a word: those in word, or all but gaps."""
    t = np.zeros(256, bool) if word is not None else np.ones(256, bool)
    t[list(word if word is not None else gaps)] = word is not None
    return t


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words in data (bytes, made lower case here unless lower is off), and that lower case."""
    low = _LOWER[data] if lower else data
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = is_word[low]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), low
    up, down = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h = mix(h + (ends - starts).astype(np.uint64) * _MIX2)
    return starts, ends, h, low


def text_slices(column: pa.Array, gap: bytes = b" ", most: int = 1 << 21):
    """(first row, bytes, offsets) for runs of rows of about most bytes; a longer text is a run of its own.

    bytes has the UTF-8 of the texts, each with gap (one byte) behind it; text k lies from
    offsets[k] to offsets[k + 1] - 1. Null is empty.
    """
    n = len(column)
    if not n:
        return
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64) + 1
    total, at = np.cumsum(lengths), 0
    while at < n:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        part = column.slice(at, to - at)
        data = b"".join([x + gap if x else gap for x in part.cast(pa.binary() if pa.types.is_string(part.type) else pa.large_binary()).to_pylist()])
        offsets = np.zeros(to - at + 1, np.int64)
        np.cumsum(lengths[at:to], out=offsets[1:])
        yield at, np.frombuffer(data, np.uint8), offsets
        at = to


# ---- units: texts as numbers of distinct short pieces -----------------------------------------

_SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes that begin no white space: U+0085, U+00A0, U+1680, U+2000 on and U+3000 begin with one of the last four.
_NO_SPACE = byte_table(gaps=b"\x20\x09\x0a\x0b\x0c\x0d\xc2\xe1\xe2\xe3")
_LETTER = byte_table(bytes([*range(65, 91), *range(97, 123)]))
_SIGN = byte_table(bytes(b for b in range(33, 127) if not chr(b).isalnum()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings without nulls; text k lies from offsets[k] to offsets[k + 1]. Nothing is copied."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def column_slices(column: pa.Array, most: int):
    """(first row, rows) for runs of rows of about most bytes, nulls made empty; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pa.compute.fill_null(column, "")
    total, at = np.cumsum(np.asarray(pa.compute.binary_length(column)).astype(np.int64)), 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, column.slice(at, to - at)
        at = to


def units(column: pa.Array, signs: bool = False) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """(first, number, distinct): the units of text k are distinct[number[first[k] : first[k + 1]]].

    A text is cut before each ASCII white space that ends a run of white space and isn't the last of the text, and with
    signs also between an ASCII letter and an ASCII sign. Put together the units are the text.
    No more is cut than that where other white space may follow, which costs nothing but repetition.
    """
    data, offsets = text_bytes(column)
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        here, after = data[:-1], data[1:]
        cut[:-2] = _SPACE[here] & _NO_SPACE[after]
        if signs:
            cut[1:-1] |= _LETTER[here] & _SIGN[after]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        cut[last[_SPACE[data[last]]]] = False
    cut[offsets] = True
    starts = np.flatnonzero(cut)
    if starts[-1] != len(data):
        starts = np.append(starts, len(data))
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    return np.searchsorted(starts, offsets), np.asarray(coded.indices), coded.dictionary


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs one after another: starts[k], starts[k] + 1 and so on, sizes[k] of them."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[k] : first[k + 1]], 0 for empty runs; equal runs have equal sums."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[:-1][some], axis=0)
    return out


class Known:
    """What was made of units before: for each a run of numbers. Bounded in bytes; when full, the units of the last slice stay."""

    def __init__(self, make, dtype, most: int = 32 << 20):
        """make(units) gives (numbers, size of each unit's run)."""
        self.make, self.most = make, most
        self.keys, self.flat, self.sizes = pa.array([], pa.binary()), np.zeros(0, dtype), np.zeros(0, np.int32)

    def runs(self, distinct: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, first of each unit's run, size of each unit's run)."""
        found = pa.compute.index_in(distinct, value_set=self.keys)
        new = np.asarray(pa.compute.is_null(found))
        old = np.asarray(found.drop_null())
        flat, sizes = self.make(distinct.filter(pa.array(new)))
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        known = self.flat[gathered(starts[old], self.sizes[old])]
        size = np.zeros(len(distinct), np.int64)
        size[~new], size[new] = self.sizes[old], sizes
        first = np.zeros(len(distinct), np.int64)
        first[~new] = np.cumsum(self.sizes[old]) - self.sizes[old]
        first[new] = len(known) + np.cumsum(sizes) - sizes
        out = np.concatenate([known, flat])
        if len(flat) or new.any():
            if self.keys.nbytes + self.flat.nbytes + self.sizes.nbytes + distinct.nbytes + out.nbytes > self.most:
                self.keys, self.flat, self.sizes = self.keys.take(pa.array(old)), known, self.sizes[old]
            if self.keys.nbytes + distinct.nbytes + out.nbytes > self.most:  # one slice alone is too much to keep
                self.keys, self.flat, self.sizes = self.keys.slice(0, 0), self.flat[:0], self.sizes[:0]
            else:
                self.keys = pa.concat_arrays([self.keys, distinct.filter(pa.array(new))])
                self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes.astype(np.int32)])
        return out, first, size
