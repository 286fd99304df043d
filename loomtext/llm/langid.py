"""Language identification: known words first, then character n-grams that grow shorter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_slices, gathered, mix, nothing_kept, sums_by, units, written

#: Bounds of the sample that is learned from, in expectation: labelled documents of each language, and of all together.
#: All words and n-grams of the sampled texts are learned.
DOCS_A_LANGUAGE, DOCS = 3000, 48_000
LONGEST_GRAM = 4
#: What is added to each count.
SMOOTHING = 0.5
#: Bytes of text looked at at once, with four languages or fewer; with more languages less.
SLICE = 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def learn_from(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the doc_id as text, modulo 4, is not 2."""
    return docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2)


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(first, number, words): the words of text k, runs of letters in lower case, are words[number[first[k] : first[k + 1]]]."""
    runs = pa.compute.split_pattern_regex(pa.compute.utf8_lower(texts), r"\P{L}+")
    flat, parent = pa.compute.list_flatten(runs), pa.compute.list_parent_indices(runs)
    some = pa.compute.greater(pa.compute.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(np.asarray(parent.filter(some)), minlength=len(texts)), out=first[1:])
    return first, np.asarray(coded.indices), coded.dictionary


def _codes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, word of each) of the words, each between two spaces."""
    lengths = np.asarray(pa.compute.utf8_length(words)).astype(np.int64) + 2
    codes = np.frombuffer("".join([f" {w} " for w in words.to_pylist()]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(words)), lengths)


def _gram_keys(codes: np.ndarray, owner: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, 64-bit keys) of the n-grams of size characters that begin at places and end within their words."""
    places = places[places + size <= len(codes)]
    places = places[owner[places + size - 1] == owner[places]]
    keys = np.full(len(places), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            keys = mix(keys * _STEP + codes[places + k])
    return places, keys


class Table:
    """Log frequencies by language of keys: a number for all keys, and what each key has beyond it in the languages where it was seen."""

    def __init__(self, row: np.ndarray, lang: np.ndarray, n: np.ndarray, rows: int, languages: int):
        cells, at = np.unique(row * max(languages, 1) + lang, return_inverse=True)
        row, lang, n = cells // max(languages, 1), cells % max(languages, 1), np.bincount(at, n, minlength=len(cells))
        self.first = np.searchsorted(row, np.arange(rows + 1))
        self.lang, self.more = lang.astype(np.int32), np.log((n + SMOOTHING) / SMOOTHING).astype(np.float32)
        total = np.bincount(lang, n, minlength=languages) + SMOOTHING * max(rows, 1)
        self.least = np.log(SMOOTHING / total)

    def add(self, out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
        """Add the frequencies of rows to the rows at of out."""
        languages = out.shape[1]
        out += np.bincount(at, minlength=len(out))[:, None] * self.least
        size = self.first[rows + 1] - self.first[rows]
        entries = gathered(self.first[rows], size)
        cells = np.repeat(at, size) * languages + self.lang[entries]
        out += np.bincount(cells, self.more[entries], minlength=out.size).reshape(out.shape)


class Model:
    """Log frequencies by language of words and of n-grams of characters."""

    def __init__(self, counts: pa.Table | list[tuple[str, str, int]], gram_counts: pa.Table | None = None):
        """counts: lang, part (a word), n; gram_counts: lang, size, key, n of n-grams, those of the words if None."""
        if not isinstance(counts, pa.Table):
            counts = pa.table({k: [c[i] for c in counts] for i, k in enumerate(("lang", "part", "n"))}, schema=pa.schema({"lang": pa.string(), "part": pa.string(), "n": pa.int64()}))
        if gram_counts is None:
            gram_counts = pa.Table.from_batches(_grams(counts.to_batches()), GRAMS)
        self.languages = sorted(pa.compute.unique(counts["lang"]).to_pylist())
        number = lambda c: np.asarray(pa.compute.index_in(c, value_set=pa.array(self.languages, pa.string())).combine_chunks()).astype(np.int64)
        coded = counts["part"].combine_chunks().dictionary_encode()
        self.words = coded.dictionary
        self.word_table = Table(np.asarray(coded.indices).astype(np.int64), number(counts["lang"]), np.asarray(counts["n"]), len(self.words), len(self.languages))
        self.grams, self.gram_tables = {}, {}
        lang, size, key, n = number(gram_counts["lang"]), *(np.asarray(gram_counts[c]) for c in ("size", "key", "n"))
        for s in range(1, LONGEST_GRAM + 1):
            own = size == s
            self.grams[s], row = np.unique(key[own].view(np.uint64), return_inverse=True)
            self.gram_tables[s] = Table(row, lang[own], n[own], len(self.grams[s]), len(self.languages))

    def word_scores(self, words: pa.StringArray) -> np.ndarray:
        """Log frequencies of words by language: a known word's own, else the mean over the longest known n-gram at each place, twice."""
        out = np.zeros((len(words), len(self.languages)))
        found = pa.compute.index_in(words, value_set=self.words)
        rows = np.asarray(pa.compute.fill_null(found, -1)).astype(np.int64)
        old = np.flatnonzero(rows >= 0)
        self.word_table.add(out, old, rows[old])
        new = np.flatnonzero(rows < 0)
        if not len(new):
            return out
        unseen = words.take(pa.array(new))
        codes, owner = _codes(unseen)
        sums = np.zeros((len(new), len(self.languages)))
        last = np.ones(len(codes), bool)
        last[:-1] = owner[1:] != owner[:-1]
        left = np.flatnonzero(~last)
        for size in range(LONGEST_GRAM, 0, -1):
            places, keys = _gram_keys(codes, owner, left, size)
            known = self.grams[size]
            if not len(known) or not len(places):
                continue
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            self.gram_tables[size].add(sums, owner[places[hit]], at[hit])
            left = np.setdiff1d(left, places[hit], assume_unique=True)
        out[new] = sums * (2.0 / np.bincount(owner, minlength=len(new)))[:, None]
        return out

    def predict_all(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(languages, scores) of the texts of a column."""
        langs, scores = [], [np.zeros(0)]
        for _, texts in column_slices(column, SLICE * 4 // max(4, len(self.languages))):
            first, number, distinct = units(texts)
            word_first, word_number, words = letter_runs(distinct.cast(pa.string()))
            n_words = sums_by(np.diff(word_first)[number], first)
            if not self.languages:
                langs += ["und"] * len(texts)
                scores.append(np.zeros(len(texts)))
                continue
            by_unit = sums_by(self.word_scores(words)[word_number], word_first)
            total = sums_by(by_unit[number], first)
            share = np.exp(total - total.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            best = np.argmax(total, 1)
            langs += [self.languages[b] if n else "und" for b, n in zip(best.tolist(), n_words.tolist(), strict=True)]
            scores.append(np.where(n_words > 0, share[np.arange(len(best)), best], 0.0))
        return langs, np.concatenate(scores)


WORDS = pa.schema({"lang": pa.string(), "part": pa.string(), "n": pa.int64()})
GRAMS = pa.schema({"lang": pa.string(), "size": pa.int32(), "key": pa.int64(), "n": pa.int64()})


def _words(batches):
    """(lang, word, count) of (lang, text), summed up within a slice of texts of one language."""
    nothing_kept()
    for b in batches:
        for lang in pa.compute.unique(b.column(0)).to_pylist():
            for _, texts in column_slices(b.column(1).filter(pa.compute.equal(b.column(0), lang)), SLICE):
                _, number, distinct = units(texts)
                first, word_number, words = letter_runs(distinct.cast(pa.string()))
                times = np.repeat(np.bincount(number, minlength=len(distinct)), np.diff(first))
                n = np.bincount(word_number, times, minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(n)], schema=WORDS)


def _grams(batches):
    """(lang, size, key, count) of (lang, word, count), summed up within a language of a batch."""
    nothing_kept()
    for b in batches:
        for lang in pa.compute.unique(b.column(0)).to_pylist():
            own = b.filter(pa.compute.equal(b.column(0), lang))
            codes, owner = _codes(own.column(1))
            n = np.asarray(own.column(2))
            for size in range(1, LONGEST_GRAM + 1):
                places, keys = _gram_keys(codes, owner, np.arange(len(codes)), size)
                keys, at = np.unique(keys, return_inverse=True)
                sums = np.bincount(at, n[owner[places]], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(sums)], schema=GRAMS)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count words and n-grams of a bounded sample of labelled rows, by a hash of doc_id.

    The sample is of DOCS_A_LANGUAGE documents of each language in expectation, or of an equal share of DOCS if there
    are so many languages. That is the only bound: each sampled text counts whole, and all languages, words and n-grams
    of the sample are learned. The driver and each worker hold counts for these, of 16 bytes for a word or n-gram and language.
    """
    rows = learn_from(docs, id_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return Model([])
    chance = F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    each = min(DOCS_A_LANGUAGE, DOCS / len(sizes))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in sizes], "lang string, share double")
    sample = rows.join(F.broadcast(shares), "lang").where(chance < F.col("share")).select("lang", "text")
    counts = sample.mapInArrow(_words, "lang string, part string, n long").groupBy("lang", "part").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    grams = counts.mapInArrow(_grams, "lang string, size int, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))
    return Model(counts.toArrow(), grams.toArrow())


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs.

    A text's score for a language is the sum over its words (runs of letters, those of Unicode's category L, in lower
    case) of the word's log frequency there or, for a word not learned, of n-grams of its characters, from LONGEST_GRAM
    characters down; score is the best language's share of the exponentials. Null texts and texts without letters, and
    all texts if nothing was learned, are ``und`` with score 0. Each text is scored whole where it
    is read, with no shuffle; rows alike get rows alike; a null doc_id is not held out; an empty table gives an empty
    result; only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        nothing_kept()
        for b in batches:
            lang, score = shared.value.predict_all(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose language can't be told: ``und``, or a best score below least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index(text_col)

    def run(batches):
        nothing_kept()
        for b in batches:
            lang, score = shared.value.predict_all(b.column(k))
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
