"""One scan of a batch of texts by a table of character classes: words, CJK characters, marks and white space counted together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chars as C

#: Classes of code points; a letter or digit is ASCII.
OTHER, LETTER, JOINT, SPACE, FAMILY, MARK = range(6)
#: White space beyond ASCII, and the marks that quality counts leave out beside ASCII ones.
_SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MARKS = {ord(c) for c in C.QUALITY_PUNCTUATION.replace("\\", "")}
#: Bytes of text that are scanned at once.
SLICE = 1 << 21


def _table() -> np.ndarray:
    table = np.full(0x10000, OTHER, np.uint8)
    for a, z in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        table[a:z] = LETTER
    for a, z in ((0x3400, 0xA000), (0x3040, 0x3100), (0xAC00, 0xD7B0)):
        table[a:z] = FAMILY
    table[_SPACES] = SPACE
    table[[c for c in _MARKS if c < 0x10000]] = MARK
    return table


CLASSES = _table()
_JOINTS = (ord("'"), ord("-"))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of their first bytes, code points) of UTF-8 bytes; those beyond the basic plane are given as 0xFFFF, which is in no class."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[first].astype(np.uint32)
    if not len(first) or lead.max() < 0x80:
        return first, lead
    at = lambda k: data[np.minimum(first + k, len(data) - 1)].astype(np.uint32) & 0x3F
    two, three = ((lead & 0x1F) << 6) | at(1), ((lead & 0x0F) << 12) | (at(1) << 6) | at(2)
    return first, np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, two, three], 0xFFFF)


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """For each text of UTF-8 bytes, from offsets[k] to offsets[k + 1]: chars, visible (no white space), family, marks, and what the estimate of
    tokens is made of: ``fixed``, CJK characters and a quarter of each word's length, rounded up, and ``rest``, the other characters.

    A word is a run of ASCII letters and digits, in which single apostrophes and hyphens may stand between two of them.
    """
    first, points = code_points(data)
    kinds = CLASSES[points]
    edges = np.searchsorted(first, offsets)
    n = len(offsets) - 1

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[edges[1:]] - sums[edges[:-1]]

    plain = kinds == LETTER
    inside = np.zeros(len(kinds) + 2, np.int8)
    inside[1:-1] = plain
    joint = np.flatnonzero((points == _JOINTS[0]) | (points == _JOINTS[1])) + 1
    inside[joint[(inside[joint - 1] == 1) & (inside[joint + 1] == 1)]] = 2  # 2 beside 1: a joint beside a joint is none
    word = inside[1:-1] > 0
    # a text's edge ends a word; a joint whose neighbour is in another text is none
    start = edges[:-1][np.diff(edges) > 0]
    end = edges[1:][np.diff(edges) > 0] - 1
    word[start[~plain[start]]] = False
    word[end[~plain[end]]] = False
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[start] |= word[start]
    at = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    stops[end] |= word[end]
    quarters = np.zeros(len(kinds), np.int64)
    quarters[at] = (np.flatnonzero(stops) - at + 4) // 4
    family, space = kinds == FAMILY, kinds == SPACE
    chars = np.diff(edges)
    spaces, cjk = total(space), total(family)
    return {"chars": chars, "visible": chars - spaces, "family": cjk, "marks": total(kinds == MARK), "fixed": cjk + total(quarters), "rest": chars - total(word) - spaces - cjk} if n else {}


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, number) of the tokens of texts in order, and how many numbers: words of ASCII letters and digits, in lower case, and single CJK characters; equal ones have one number."""
    first, points = code_points(data)
    kinds = CLASSES[points]
    letter, family = kinds == LETTER, kinds == FAMILY
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = np.searchsorted(first, offsets)
    start = edges[:-1][np.diff(edges) > 0]
    begins[start] |= letter[start]
    begins |= family
    sizes = np.diff(np.append(first, len(data)))
    inside = letter | family
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    packed = low[np.repeat(inside, sizes)]
    at = np.cumsum(np.where(inside, sizes, 0)) - sizes
    starts = np.append(at[begins], len(packed)).astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(packed)]).dictionary_encode()
    text = np.searchsorted(edges, np.flatnonzero(begins), "right") - 1
    return text, np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)


def repeated_runs(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(runs, repeats) for each of rows: runs of n tokens, not all the same, within the texts of a row (row[k] is that of text k), and those beyond the first of their kind.

    Exact: a run of tokens is numbered by the distinct pairs of a shorter run and a token.
    """
    text, number, base = tokens_of(data, offsets)
    m = len(text) - n + 1
    if m <= 0:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    code, differ = number[:m], np.zeros(m, bool)
    for k in range(1, n):
        differ |= number[k : k + m] != number[:m]
        code = np.unique(code * base + number[k : k + m], return_inverse=True)[1]
    at = np.flatnonzero((text[:m] == text[n - 1 :]) & differ)
    own = row[text[at]]
    kinds = np.unique(own * (m + 1) + code[at])
    runs = np.bincount(own, minlength=rows)
    return runs, runs - np.bincount(kinds // (m + 1), minlength=rows)


def estimate(fixed: np.ndarray, rest: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Estimated tokens: text.estimate_tokens."""
    return np.where(chars > 0, np.maximum(1, fixed + (rest + 3) // 4), 0)


def scanned(column: pa.Array) -> dict[str, np.ndarray]:
    """counts() of a column of strings, null as empty, slice by slice, with ``tokens``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.compute.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    parts, k = [], 0
    while k < len(column):
        z = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, "right")) - 1)
        parts.append(counts(data[offsets[k] : offsets[z]], offsets[k : z + 1] - offsets[k]))
        k = z
    names = ("chars", "visible", "family", "marks", "fixed", "rest")
    out = {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64) for name in names}
    return out | {"tokens": estimate(out["fixed"], out["rest"], out["chars"])}


_ONE = ("tokens", "chars", "visible", "family", "marks")


def text_counts(text: Column) -> Column:
    """struct(tokens, chars, visible, family, marks) of a text, all from one scan; for columns, not within higher-order functions."""

    @F.arrow_udf(f"struct<{', '.join(f'{c}: bigint' for c in _ONE)}>")
    def of_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = scanned(texts)
            yield pa.StructArray.from_arrays([pa.array(found[c]) for c in _ONE], names=list(_ONE))

    return of_batches(F.coalesce(text, F.lit("")))


def counted(lists: pa.Array) -> pa.Array:
    """list<struct(tokens, chars, fixed, rest)> of lists of texts, null for null."""
    found = scanned(lists.flatten())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    rows = pa.StructArray.from_arrays([pa.array(found[c].astype(np.int32)) for c in _UNIT], names=list(_UNIT))
    out = pa.ListArray.from_arrays(offsets, rows)
    return pa.compute.if_else(pa.compute.is_valid(lists), out, pa.scalar(None, out.type)) if lists.null_count else out


_UNIT = ("tokens", "chars", "fixed", "rest")


def unit_counts(units: Column) -> Column:
    """array<struct(tokens, chars, fixed, rest)> of an array of texts, null for null."""

    @F.arrow_udf(f"array<struct<{', '.join(f'{c}: int' for c in _UNIT)}>>")
    def of_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield counted(lists)

    return of_batches(units)


def run_counts(texts: Column, n: int) -> Column:
    """struct(runs, repeats) of an array of texts: repeated_runs, none of which reaches from one text into the next."""

    @F.arrow_udf("struct<runs: int, repeats: int>")
    def of_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            flat = pa.compute.fill_null(lists.flatten(), "")
            per = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
            lengths = np.asarray(pa.compute.binary_length(flat)).astype(np.int64)
            ends, out, k = np.append(0, np.cumsum(per)), [], 0
            sums = np.append(0, np.cumsum(lengths))
            while k < len(per):  # rows of about SLICE bytes at once
                z = max(k + 1, int(np.searchsorted(sums[ends], sums[ends[k]] + SLICE, "right")) - 1)
                own = flat.slice(ends[k], ends[z] - ends[k])
                data = np.frombuffer(b"".join(own.cast(pa.binary()).to_pylist()), np.uint8)
                offsets = sums[ends[k] : ends[z] + 1] - sums[ends[k]]
                out.append(repeated_runs(data, offsets, np.repeat(np.arange(z - k), per[k:z]), z - k, n))
                k = z
            both = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in (0, 1)]
            yield pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in both], names=["runs", "repeats"])

    return of_batches(texts)
