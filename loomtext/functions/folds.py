"""Folds over one document's units that hold state from unit to unit, as Arrow functions.

An interpreted fold in the JVM copies its state at each step, which makes long documents quadratic. These take a
column of arrays, run one pass over each, and give back numbers or the few pieces that are cut, not texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chars as C
from . import scan


def ranges_of(size: np.ndarray, fresh: np.ndarray | None, limit: int, gap: int) -> list[int]:
    """The first units of the chunks of units of these sizes: one search in the prefix sums for each chunk."""
    n = len(size)
    if not n:
        return []
    upto = np.cumsum(size + gap, dtype=np.int64)
    begins = np.flatnonzero(fresh) if fresh is not None else np.zeros(0, np.int64)
    out, k = [], 0
    while k < n:
        out.append(k)
        # a chunk from k holds units as long as their sizes and gaps, without the last gap, stay within limit
        to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + limit + gap, "right")))
        if len(begins) and (j := int(np.searchsorted(begins, k, "right"))) < len(begins):
            to = min(to, int(begins[j]))
        k = to
    return out


def chunk_ranges(sizes: Column, fresh: Column | None, limit: int, gap: int, measures: Column | None = None) -> Column:
    """array<struct(first, units, tokens)>: the chunks of units of these sizes, greedily.

    A unit begins a chunk where fresh has true for it, or where the chunk's sizes and gaps would pass limit with it. tokens is the estimate for
    a chunk's units with white space between, from measures (scan.unit_counts), 0 without.
    """

    @F.arrow_udf("array<struct<first:int,units:int,tokens:int>>")
    def ranges(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for size, new, measured in batches:
            flat, flags, parts = np.asarray(size.flatten()).astype(np.int64), new.flatten(), measured.flatten()
            fixed, rest, chars = (np.asarray(parts.field(c)).astype(np.int64) for c in ("fixed", "rest", "chars")) if len(parts) else (np.zeros(len(flat), np.int64),) * 3
            flags = np.asarray(pa.compute.fill_null(flags, False)) if len(flags) else None
            counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(size), 0))
            at, firsts, units, starts, per = 0, [], [], [], []
            for n in counts.tolist():
                own = ranges_of(flat[at : at + n], None if flags is None else flags[at : at + n], limit, gap)
                firsts += own
                units += np.diff([*own, n]).tolist() if own else []
                starts += [at + k for k in own]
                per.append(len(own))
                at += n
            if starts:
                total = [np.add.reduceat(v, starts) for v in (fixed, rest, chars)]
                tokens = scan.estimate(total[0], total[1], total[2] + (np.array(units) > 1)) if len(parts) else np.zeros(len(starts), np.int64)
            else:
                tokens = np.zeros(0, np.int64)
            rows = pa.StructArray.from_arrays([pa.array(firsts, pa.int32()), pa.array(units, pa.int32()), pa.array(tokens.astype(np.int32))], names=["first", "units", "tokens"])
            out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), rows)
            yield pa.compute.if_else(pa.compute.is_valid(size), out, pa.scalar(None, out.type)) if size.null_count else out

    none = F.lit(None).cast("array<boolean>")
    unmeasured = F.lit(None).cast("array<struct<tokens:int,chars:int,fixed:int,rest:int>>")
    return ranges(sizes, none if fresh is None else fresh, unmeasured if measures is None else measures)


# The estimate of text.estimate_tokens, character by character.
_WORD = re.compile(r"[A-Za-z0-9]")
_FAMILY = re.compile(f"[{C.FAMILY}]")
_OTHER = re.compile(rf"[^\s{C.FAMILY}]")


def cut_by_tokens(text: str, size: int) -> list[str]:
    """Pieces, from the left, each as long as its estimate stays within size; stripped, blank ones left out.

    One step for each character: its class moves the counts of CJK characters, of the running word, of finished words
    and of other marks, and where their sum would pass size a piece begins, with counts anew.
    """
    cuts, done, word, rest, n = [0], 0, 0, 0, 0
    for i, c in enumerate(text):
        plain, family, other = _WORD.match(c) is not None, _FAMILY.match(c) is not None, _OTHER.match(c) is not None
        joint = c in "'-" and i + 1 < len(text) and _WORD.match(text[i + 1]) is not None
        for fresh in (False, True):
            if fresh:
                cuts.append(i)
                done = word = rest = n = 0
            inside = plain or (joint and word > 0)
            d = (done if inside else done + (word + 3) // 4) + family
            w = word + 1 if inside else 0
            r = rest + (not inside and other)
            if not n or d + (w + 3) // 4 + (r + 3) // 4 <= size:
                break
        done, word, rest, n = d, w, r, n + 1
    edges = [*cuts, len(text)]
    return [p for p in (text[a:z].strip() for a, z in zip(edges[:-1], edges[1:], strict=True)) if p]


def pieces_of(units: Column, sizes: Column, size: int) -> Column:
    """array<array<string>>: for each unit larger than size its pieces by cut_by_tokens, null for the others."""

    @F.pandas_udf("array<array<string>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, many in batches:
            yield pd.Series([None if t is None else [cut_by_tokens(u, size) if u is not None and n > size else None for u, n in zip(t, m, strict=True)] for t, m in zip(texts, many, strict=True)])

    return cut(units, sizes)


def fitted_units(units: Column, size: int) -> Column:
    """struct(pieces, measures) of an array of texts: with those of more than size tokens cut by cut_by_tokens, null if there are none; and scan.unit_counts of what results."""
    kind = pa.list_(pa.string())

    @F.arrow_udf("struct<pieces:array<string>,measures:array<struct<tokens:int,chars:int,fixed:int,rest:int>>>")
    def fit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            parts = []
            for k in range(0, len(lists), _ROWS):
                own = lists.slice(k, _ROWS).cast(kind)
                measured = scan.counted(own)
                tokens = np.asarray(measured.flatten().field("tokens"))
                per = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(own), 0))
                ends = np.append(0, np.cumsum(per))
                cut: list[list[str] | None] = [None] * len(own)
                for i in np.unique(np.searchsorted(ends, np.flatnonzero(tokens > size), "right") - 1).tolist():
                    sizes = tokens[ends[i] : ends[i + 1]].tolist()
                    cut[i] = [p for u, n in zip(own[i].as_py(), sizes, strict=True) for p in (cut_by_tokens(u, size) if n > size else [u])]
                pieces = pa.array(cut, kind)
                if pieces.null_count < len(own):
                    measured = scan.counted(pa.compute.coalesce(pieces, own))
                parts.append(pa.StructArray.from_arrays([pieces, measured], names=["pieces", "measures"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("pieces", kind), ("measures", scan.counted(pa.array([], kind)).type)]))

    return fit(units)


#: Rows that are measured and cut at once.
_ROWS = 512


def borders(text: str) -> list[int]:
    """The lengths of the beginnings of text that it ends with, itself left out, longest first; by the prefix function."""
    fail, k = [0] * len(text), 0
    for i in range(1, len(text)):
        while k and text[i] != text[k]:
            k = fail[k - 1]
        k += text[i] == text[k]
        fail[i] = k
    out, k = [], fail[-1] if text else 0
    while k:
        out.append(k)
        k = fail[k - 1]
    return out


#: First characters of a beginning that are looked for at once, and places beyond which the prefix function takes over.
_HEAD, _PLACES = 8, 64


def shared(a: str | None, b: str | None) -> list[int]:
    """The lengths of the beginnings of b that a ends with, longest first. Work grows with their lengths, not with the product."""
    if not a or not b:
        return []
    most = min(len(a), len(b))
    tail, head = a[len(a) - most :], b[:most]
    out, at = [], tail.find(head[:_HEAD]) if most >= _HEAD else -1
    places = 0
    while at >= 0:
        if tail.endswith(head[: most - at]):
            out.append(most - at)
        places += 1
        if places > _PLACES:
            # \x00 is in neither: no text of the engine has it, and one that had would only shorten an overlap
            return [n for n in borders(f"{head}\x00{tail}") if n <= most]
        at = tail.find(head[:_HEAD], at + 1)
    return out + [n for n in range(min(_HEAD - 1, most), 0, -1) if tail.endswith(head[:n])]


def shared_lengths(previous: Column, current: Column) -> Column:
    """array<int>: shared() of two texts."""

    @F.pandas_udf("array<int>")
    def lengths(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for before, after in batches:
            yield pd.Series([shared(a, b) for a, b in zip(before, after, strict=True)])

    return lengths(previous, current)


def neighbour_lengths(texts: Column) -> Column:
    """array<array<int>>: shared() of each text of an array and the one behind it."""

    @F.pandas_udf("array<array<int>>")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if t is None else [shared(a, b) for a, b in zip(t[:-1], t[1:], strict=True)] for t in rows])

    return lengths(texts)
