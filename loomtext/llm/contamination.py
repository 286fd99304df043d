"""Benchmark decontamination with a broadcast set of word windows."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, fresh, mix, nothing_kept, text_slices, word_hashes, written

WINDOW = 13
#: Bytes of benchmark text whose windows are broadcast at once; more is scanned for in blocks of about this size, longer
#: items in parts. A block's windows take some seven bytes for each byte of text.
MOST_BYTES = 8 << 20
#: Bytes of a word after lower-casing: digits, a-z and all of 128 or more.
IS_WORD = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: One bit for each value of a hash's upper 20 bits is looked at before the sorted hashes.
_UPPER = 20


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _STEP + words[k : len(words) - n + 1 + k]
        return mix(out)


def _joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, n: int) -> bytes:
    return b" ".join(low[a:z].tobytes() for a, z in zip(starts[k : k + n], ends[k : k + n], strict=True))


class Windows:
    """The windows of benchmark items, by length: sorted hashes, and for each hash the places of its windows in the items' words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.names = [item for item, _ in items]
        texts = [(text or "").encode() for _, text in items]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        starts, ends, h, self.low = word_hashes(np.frombuffer(b"".join([t + b" " for t in texts]), np.uint8), IS_WORD)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        first = np.searchsorted(starts, offsets)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
        size = np.minimum(np.diff(first), window)[owner] if len(owner) else np.zeros(0, np.int64)
        self.sorted, self.bounds, self.places, self.maybe, self.found = {}, {}, {}, {}, {}
        self.owner = owner
        for n in np.unique(size).tolist():
            hashes = window_hashes(h, n)
            at = np.flatnonzero((size[: len(hashes)] == n) & (owner[: len(hashes)] == owner[n - 1 :]))
            at = at[np.argsort(hashes[at], kind="stable")]
            self.sorted[n], begin = np.unique(hashes[at], return_index=True)
            self.bounds[n], self.places[n] = np.append(begin, len(at)).astype(np.int32), at.astype(np.int32)
            self.maybe[n] = np.zeros(1 << _UPPER, bool)
            self.maybe[n][self.sorted[n] >> np.uint64(64 - _UPPER)] = True

    def items_of(self, n: int, hash_: int, words: bytes) -> frozenset[str]:
        """The items that have the window words, told by their bytes; remembered for windows that were met."""
        key = (n, hash_)
        if key not in self.found:
            k = int(np.searchsorted(self.sorted[n], np.uint64(hash_)))
            items = defaultdict(set)
            for place in self.places[n][self.bounds[n][k] : self.bounds[n][k + 1]].tolist():
                items[_joined(self.low, self.starts, self.ends, place, n)].add(self.names[self.owner[place]])
            self.found[key] = {w: frozenset(x) for w, x in items.items()}
        return self.found[key].get(words, frozenset())

    def scan(self, column: pa.Array):
        """For each text: (number of words, [(first word, number of words)] of its hits, items)."""
        for _, data, offsets in text_slices(column):
            starts, ends, h, low = word_hashes(data, IS_WORD)
            first = np.searchsorted(starts, offsets)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            hits, items = defaultdict(list), defaultdict(set)
            for n, hashes in self.sorted.items():
                w = window_hashes(h, n)
                at = np.flatnonzero(self.maybe[n][w >> np.uint64(64 - _UPPER)])
                at = at[np.isin(w[at], hashes)]
                at = at[doc[at] == doc[at + n - 1]] if len(at) else at
                for k in at.tolist():
                    found = self.items_of(n, int(w[k]), _joined(low, starts, ends, k, n))
                    if found:
                        d = int(doc[k])
                        hits[d].append((k - int(first[d]), n))
                        items[d] |= found
            for d, n_words in enumerate(np.diff(first).tolist()):
                yield n_words, hits.get(d, []), items.get(d, set())


def covered(hits: list[tuple[int, int]]) -> int:
    """Words inside any of the runs."""
    total, to = 0, 0
    for a, n in sorted(hits):
        total += max(0, a + n - max(a, to))
        to = max(to, a + n)
    return total


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def parts_of(text: str | None, window: int, most: int) -> list[str | None]:
    """A text in parts of about most bytes that together have its windows: neighbours share window - 1 words. One of fewer words stays whole."""
    data = (text or "").encode()
    if len(data) <= most:
        return [text]
    starts, ends, _, _ = word_hashes(np.frombuffer(data, np.uint8), IS_WORD)
    out, a = [], 0
    while len(starts) > window and a + window <= len(starts):
        z = max(a + window, int(np.searchsorted(ends, starts[a] + most, "right")))
        out.append(data[starts[a] : ends[min(z, len(ends)) - 1]].decode())
        a = z - window + 1
    return out or [text]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most_bytes: int, window: int):
    """(number of blocks, a broadcast of each block's windows): one block if the benchmark's text is no longer than most_bytes."""

    def cut(batches):
        for b in batches:
            rows = [(i, p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in parts_of(t, window, most_bytes // 2)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["item", "text"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    n = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] // most_bytes + 1
    if n > 1:
        items = items.mapInArrow(cut, "item string, text string")
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield n, benchmark.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in block.collect()], window))


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _verdicts(ids, found) -> pa.RecordBatch:
    rows = [(i, n, covered(hits), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()) for i, (n, hits, items) in zip(ids, found, strict=True)]
    c = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c[:4]] + [pa.array(c[4], pa.string()), pa.array([is_contaminated(n, h) for n, h in zip(c[1], c[2], strict=True)], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """SCHEMA and _row for (_row, doc_id, text), a written table, from several blocks of windows: a scan for each, and the hits of a row put together."""
    parts = []
    for _, windows in blocks:

        def hits(batches, windows=windows):
            nothing_kept()
            for b in batches:
                found = [(r, n, [v for h in hits for v in h], sorted(items)) for r, (n, hits, items) in zip(b.column(0).to_pylist(), windows.value.scan(b.column(2)), strict=True) if hits]
                c = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)], names=["_row", "n", "hits", "items"])

        parts.append(written(rows.mapInArrow(hits, "_row long, n long, hits array<long>, items array<string>"), "hits"))
        windows.unpersist()
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = whole.groupBy("_row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))

    def merge(batches):
        for b in batches:
            row, ids, texts, hits, items = (b.column(c) for c in ("_row", "doc_id", "text", "hits", "items"))
            counts = [n for n, _, _ in NOTHING.scan(texts)]
            found = [(n, [(v[k], v[k + 1]) for k in range(0, len(v or []), 2)], set(i or [])) for n, v, i in zip(counts, hits.to_pylist(), items.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*_verdicts(ids.to_pylist(), found).columns, row], names=[*NAMES, "_row"])

    return rows.join(whole, "_row", "left").mapInArrow(merge, f"{SCHEMA}, _row long")


NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
NOTHING = Windows([])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    Words are runs of digits, a-z (A-Z in lower case) and characters from U+0080 on. An item's windows are
    its runs of ``window`` words, or all its words if fewer. Their hashes are broadcast; documents'
    windows with such a hash are compared word by word. A benchmark of more than most_bytes of text is
    taken in blocks, one scan each, and the hits of a row are put together.

    Null and empty texts have no words and no hits, on either side. Items alike all count. Rows alike get rows
    alike, one for each, and a null doc_id stays null. Empty tables give no hits, or no rows. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, most_bytes, window)
    n, windows = next(blocks)
    if n > 1:
        rows = written(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "rows")
        return _in_blocks(rows, chain([(n, windows)], blocks)).drop("_row")

    def run(batches):
        for b in batches:
            yield _verdicts(b.column(0).to_pylist(), windows.value.scan(b.column(1)))

    return rows.mapInArrow(run, SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that contamination() finds contaminated. No shuffle with a benchmark of one block."""
    names = docs.columns
    blocks = _blocks(benchmark, "item_id", "text", most_bytes, window)
    n, windows = next(blocks)
    if n > 1:
        (row,) = fresh(docs, "_row")
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        rows = numbered.select(F.col(row).alias("_row"), F.lit(0).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        bad = _in_blocks(rows, chain([(n, windows)], blocks)).where("contaminated").select(F.col("_row").alias(row))
        return numbered.join(bad, row, "left_anti").select(*names)
    k = names.index(text_col)

    def run(batches):
        for b in batches:
            keep = [not is_contaminated(n, covered(hits)) for n, hits, _ in windows.value.scan(b.column(k))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
