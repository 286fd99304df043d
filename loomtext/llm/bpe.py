"""Byte-pair encoding: token counts by own merging, and identifiers from the tokenizers library.

Both work on pretokens, which the byte-level scheme encodes one by one: texts are cut into units that no pretoken
reaches across, and each distinct unit of a slice of texts is worked out once.
"""

from __future__ import annotations

import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute

from .common import _NO_SPACE, _SPACE, Known, column_slices, gathered, kept_in_worker, sums_by, text_bytes, units

#: The pattern that cuts a text into pretokens before merging (also public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text whose parts are looked up at once.
SLICE = 8 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself, or one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in out)})
    return out


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = [x["content"] for x in spec["added_tokens"]]
        symbols = byte_symbols()
        self.of_byte = [vocab[symbols[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[left] << 20) | vocab[right], (rank, vocab[left + right]))


class Counter:
    """Counts the tokens of texts without making identifiers."""

    def __init__(self, path: str | None = None):
        import regex

        self.vocabulary = Vocabulary(path or default_path())
        self.cut = regex.compile(PATTERN).findall
        self.special = re.compile("|".join(map(re.escape, self.vocabulary.specials))) if self.vocabulary.specials else None
        self.known = Known(lambda new: (np.array([self.unit(x) for x in new.to_pylist()], np.uint32), np.ones(len(new), np.int64)), np.uint32)

    def merged(self, piece: bytes) -> int:
        """Symbols left of a pretoken when no pair merges any more.

        The adjacent pairs lie in a heap by rank, then place; symbols form a linked list. A popped pair counts
        only if both its symbols are still there. Each merge takes one symbol away.
        """
        n = len(piece)
        if n < 2:
            return n
        of_byte, merges = self.vocabulary.of_byte, self.vocabulary.merges
        ids = [of_byte[b] for b in piece]
        heap = []
        for k in range(n - 1):
            pair = (ids[k] << 20) | ids[k + 1]
            if m := merges.get(pair):
                heap.append((m[0], k, pair, m[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        count = n
        while heap:
            _, k, pair, new = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right >= n or (ids[k] << 20) | ids[right] != pair:
                continue
            ids[k], ids[right] = new, -1
            count -= 1
            after[k] = far = after[right]
            if far < n:
                before[far] = k
                pair = (new << 20) | ids[far]
                if m := merges.get(pair):
                    heapq.heappush(heap, (m[0], k, pair, m[1]))
            if (left := before[k]) >= 0:
                pair = (ids[left] << 20) | new
                if m := merges.get(pair):
                    heapq.heappush(heap, (m[0], left, pair, m[1]))
        return count

    def unit(self, piece: bytes) -> int:
        return sum(self.merged(x.encode()) for x in self.cut(piece.decode()))

    def count(self, text: str | None) -> int:
        """Tokens of text as the library gives them by default: a special token's string is one token."""
        parts = self.special.split(text or "") if self.special else [text or ""]
        return len(parts) - 1 + sum(self.unit(x.encode()) for x in parts)

    def count_all(self, column: pa.Array) -> np.ndarray:
        """count() of each text; no pretoken reaches from one unit into the next, so that each distinct unit is counted once a slice."""
        out = np.zeros(len(column), np.int64)
        for at, texts in column_slices(column, SLICE):
            plain, special = without_specials(texts, self.vocabulary.specials)
            first, number, distinct = units(plain, signs=True)
            counts, place, _ = self.known.runs(distinct)
            out[at : at + len(texts)] = sums_by(counts[place][number].astype(np.int64), first)
            for k in special:
                out[at + k] = self.count(texts[k].as_py())
        return out


def without_specials(texts: pa.Array, specials: list[str]) -> tuple[pa.Array, list[int]]:
    """texts with those that contain a special token's string made empty, and the rows of these."""
    found = None
    for s in specials:
        hit = pa.compute.match_substring(texts, s)
        found = hit if found is None else pa.compute.or_(found, hit)
    rows = np.flatnonzero(np.asarray(found)).tolist() if found is not None else []
    return (pa.compute.if_else(found, "", texts) if rows else texts), rows


class Encoder:
    """Identifiers from the tokenizers library, which sees each distinct unit of a slice of texts once."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or default_path())
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.specials = [x.content for x in self.library.get_added_tokens_decoder().values()]
        # a symbol stands for a byte, so that an identifier's bytes are its symbols
        self.n_bytes = np.zeros(size, np.int64)
        for token, k in self.library.get_vocab(with_added_tokens=False).items():
            self.n_bytes[k] = len(token)
        self.known = Known(self.encode_units, self.dtype)

    def encode(self, text: str | None) -> bytes:
        """The identifiers of text, little-endian, as the library gives them without begin or end tokens."""
        return np.array(self.library.encode(text or "", add_special_tokens=False).ids, self.dtype).tobytes()

    def encode_units(self, distinct: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers, number of each unit's): units that begin with a white space before other than white space are put together for the library.

        Nothing is merged across such a white space, and the bytes of the identifiers tell where each unit ends.
        """
        data, offsets = text_bytes(distinct)
        size = np.diff(offsets)
        joins = np.zeros(len(size), bool)
        long = np.flatnonzero(size > 1)
        joins[long] = _SPACE[data[offsets[long]]] & _NO_SPACE[data[offsets[long] + 1]]
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n = int(joins.sum())
        flat = data[gathered(offsets[:-1][order[:n]], size[order[:n]])].tobytes()
        ends = np.cumsum(size[order[:n]])
        runs, a = [], 0
        while a < n:  # runs of about 64 KB, which keep the library's working memory small
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 16), "right")))
            runs.append(flat[ends[a - 1] if a else 0 : ends[z - 1]].decode())
            a = z
        single = distinct.take(pa.array(order[n:])).to_pylist()
        ids = [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(runs + [x.decode() for x in single], add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids[len(runs) :]], np.int64)
        joined = np.concatenate(ids[: len(runs)]) if runs else np.zeros(0, self.dtype)
        at = np.searchsorted(np.cumsum(self.n_bytes[joined]), ends, "left") + 1
        counts = np.zeros(len(size), np.int64)
        counts[order[:n]] = np.diff(at, prepend=0)
        counts[order[n:]] = sizes
        first = np.zeros(len(size), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([joined, *ids[len(runs) :]])[gathered(first, counts)], counts

    def encode_all(self, column: pa.Array, end_id: int):
        """(identifiers, ends) for runs of texts: those of the texts one after another, each with end_id behind it, and where each ends."""
        for _, texts in column_slices(column, SLICE):
            plain, special = without_specials(texts, self.specials)
            first, number, distinct = units(plain, signs=True)
            ids, start, count = self.known.runs(distinct)
            of_unit = count[number]
            n = sums_by(of_unit, first)
            out = ids[gathered(start[number], of_unit)]
            if special:
                ends = np.cumsum(n)
                parts, at = [], 0
                for k in special:
                    own = np.frombuffer(self.encode(texts[k].as_py()), self.dtype)
                    parts += [out[at : ends[k]], own]
                    at, n[k] = ends[k], len(own)
                out = np.concatenate([*parts, out[at:]])
            yield np.insert(out, np.cumsum(n), end_id), np.cumsum(n + 1)


def of(kind, path: str | None):
    """The Counter or Encoder of this worker process for a vocabulary file."""
    return kept_in_worker((kind, path), lambda: kind(path))
