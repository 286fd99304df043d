"""Line dedup over content-defined chunks and runs of lines."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, nothing_kept, written

#: Lines that a rolling hash covers, and the number of its values that end a chunk once.
ROLL, ONE_IN = 2, 3
#: Words of a passage: a run of lines of so many words goes wherever it is repeated, whatever chunks it lies in.
PASSAGE = 50
#: Keys that have more than one in HOT of all parts, of which there are fewer than HOT, are spread over SALTS tasks.
HOT, SALTS = 1000, 64
MASK = (1 << 64) - 1


def chunks(text: str) -> list[tuple[int, int]]:
    """(first line, number of lines) of the chunks of a text.

    A chunk ends behind a line where the rolling hash over the hashes of the last ROLL lines has remainder 0 by
    ONE_IN. Whether it ends depends on these lines alone, so that lines put in or taken out elsewhere shift no boundary.
    """
    out, first, hashes = [], 0, []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        hashes.append(xxhash.xxh64_intdigest(line.encode()))
        rolled = 0
        for h in hashes[-ROLL:]:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & MASK
        if len(hashes) >= ROLL and (rolled >> 20) % ONE_IN == 0:
            out.append((first, k + 1 - first))
            first = k + 1
    if first < len(lines):
        out.append((first, len(lines) - first))
    return out


def _units(text: str, lines: list[str], passage: int = PASSAGE) -> list[tuple[int, int]]:
    """(first line, number of lines) of the parts of a text that go if they are repeated, in order.

    The chunks of two lines with words or more, the whole text if it has as many, and the least runs of lines of passage words: from each line with
    words the shortest such run that begins with it, and the shortest that ends with it. These runs overlap and
    cover each longer run of lines whole, so that none of its lines depends on where a chunk ends. A passage of 0 has no runs.
    """
    counts = [len(x.split()) for x in lines]
    at = [k for k, c in enumerate(counts) if c]
    whole = {(0, len(lines))} if len(at) >= 2 else set()
    out = whole | {(first, n) for first, n in chunks(text) if sum(1 for c in counts[first : first + n] if c) >= 2}
    words, left = 0, 0
    for k in at if passage else []:
        words += counts[k]
        while words >= passage:  # the first end for each line that is left behind
            out.add((at[left], k + 1 - at[left]))
            words -= counts[at[left]]
            left += 1
        if left:
            out.add((at[left - 1], k + 1 - at[left - 1]))
    return sorted(out)


def removable(text: str) -> list[tuple[int, int, str]]:
    """(first line, number of lines, lines) of the parts that go if they are repeated; see _units."""
    lines = text.split("\n")
    return [(first, n, "\n".join(lines[first : first + n])) for first, n in _units(text, lines)]


def _keys(batches, passage: int):
    """Rows of the removable parts: a digest of 128 bits over the digests of the lines, in two columns. It finds parts; confirmed() compares bytes."""
    names = ["doc_id", "x", "first", "n", "key", "key2"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    nothing_kept()
    digest = lambda data: hashlib.blake2b(data, digest_size=16).digest()
    for b in batches:
        ids, firsts, sizes, keys = [], [], [], []
        for row, text in enumerate(b.column(2).to_pylist()):
            lines = text.split("\n")
            units = _units(text, lines, passage)
            if not units:
                continue
            own = b"".join([digest(x.encode()) for x in lines])
            for first, n in units:
                firsts.append(first)
                sizes.append(n)
                keys.append(digest(own[16 * first : 16 * (first + n)]))
            ids += [row] * len(units)
        both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        rows = pa.array(ids, pa.int32())
        columns = [b.column(0).take(rows), b.column(1).take(rows), firsts, sizes, both[:, 0].copy(), both[:, 1].copy()]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def confirmed(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, x, line, other) whose lines have the same bytes; other is the doc_id, x and line that stays. own: (doc_id, x, text).

    Only lines that pairs name are taken out of the texts. A line that stays for many is compared with their distinct
    lines, found by an aggregation, so that it burdens no task.
    """
    kept = pairs.select("other.doc_id", "other.x", "other.line").distinct().withColumn("other", F.lit(None).cast(pairs.schema["other"].dataType))
    wanted = pairs.select("doc_id", "x", "line", "other").unionByName(kept)
    wanted = wanted.groupBy(F.col("doc_id").alias("its_id"), F.col("x").alias("its_x")).agg(F.collect_list(F.struct("line", "other")).alias("at"))
    its = own.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("x") == F.col("its_x")))
    bound = F.array(F.struct(F.split("text", "\n", -1).alias("all"), F.col("at").alias("at")))  # worked out once
    each = F.transform(bound, lambda b: F.transform(b["at"], lambda k: F.struct(k["line"].alias("line"), k["other"].alias("other"), F.get(b["all"], k["line"]).alias("said"))))[0]
    said = written(its.select("doc_id", "x", F.explode(each).alias("s")).select("doc_id", "x", "s.line", "s.other", "s.said"), "said")
    of_kept = said.where(F.col("other").isNull()).select(F.struct("doc_id", "x", "line").alias("place"), F.col("said").alias("kept_said"))
    wrong = said.where(F.col("other").isNotNull()).select("other", "said").distinct().join(of_kept.hint("merge"), F.col("other").eqNullSafe(F.col("place")))
    wrong = wrong.where(~F.col("said").eqNullSafe(F.col("kept_said"))).select(F.col("other").alias("wrong_other"), F.col("said").alias("wrong_said"))
    wrong = written(wrong.distinct(), "wrong")
    if not wrong.take(1):
        return pairs
    right = said.where(F.col("other").isNotNull()).join(wrong, F.col("other").eqNullSafe(F.col("wrong_other")) & F.col("said").eqNullSafe(F.col("wrong_said")), "left_anti")
    return right.select("doc_id", "x", "line", "other").distinct()  # rows alike once


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """(doc_id, x, lines): the lines to be removed from each document that has any; x is the hash of its text.

    Each part of a text that removable names goes where it is repeated: all occurrences but that of the least
    (doc_id, x, line), whose own lines stay if a later occurrence overlaps it; null doc_ids come first. So a line goes if it
    lies in a run of lines of passage words or more that occurred before, or in a shorter chunk or whole text that did.
    128-bit BLAKE2b digests find the parts; a line goes only if its bytes are those of its line in a part that stays. Counts are aggregated
    before they are shuffled, and a part that has more than one in HOT of all occurrences is spread over SALTS tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("x"), text.alias("text"))
    keys = written(own.mapInArrow(lambda batches: _keys(batches, passage), "doc_id long, x long, first int, n int, key long, key2 long"), "keys")
    often = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "often")
    hot = F.broadcast(often.where(F.col("times") > F.lit(keys.count() // HOT)).select("key", F.lit(True).alias("hot")))  # fewer than HOT rows
    dealt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "x", "first"), F.lit(SALTS))).otherwise(0).cast("int")
    each = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    all_keys = often.join(hot, "key", "left").select("key", each.alias("salt")).hint("merge")  # grows with the documents, as kept does
    parts = written(keys.join(hot, "key", "left").withColumn("salt", dealt).drop("hot").join(all_keys, ["key", "salt"]), "parts")
    place = F.struct("doc_id", "x", "first")
    # Rows alike in doc_id and text are one document: their parts have one place.
    kept = parts.groupBy("key", "key2").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where(~F.col("kept").eqNullSafe(F.col("last"))).select("key", "key2", "kept")
    kept = kept.join(hot, "key", "left").withColumn("salt", each).drop("hot").hint("merge")
    gone = parts.join(kept, ["key", "key2", "salt"]).where(~place.eqNullSafe(F.col("kept")))
    inside = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("x") == F.col("kept.x"))
    begin = F.when(inside, F.greatest("first", F.col("kept.first") + F.col("n"))).otherwise(F.col("first"))
    gone = gone.select("doc_id", "x", "first", "kept", begin.alias("begin"), (F.col("first") + F.col("n") - 1).alias("end")).where("begin <= end")
    # one line that stays for each that goes; a document's rows come together before they are made many
    each = gone.repartition("doc_id", "x").select("doc_id", "x", "first", "kept", F.explode(F.sequence("begin", "end")).alias("line"))
    other = F.struct(F.col("kept.doc_id").alias("doc_id"), F.col("kept.x").alias("x"), (F.col("kept.first") + F.col("line") - F.col("first")).alias("line"))
    pairs = written(each.groupBy("doc_id", "x", "line").agg(F.min(other).alias("other")), "pairs")
    return confirmed(own, pairs).groupBy("doc_id", "x").agg(F.collect_list("line").alias("lines"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """docs, all columns, their texts without the lines of repeated_lines, with ``lines_removed``.

    Null texts stay null; empty ones stay empty; rows alike in doc_id and text get texts alike; rows with null doc_ids are
    documents like others, told apart by their texts; an empty table gives an empty one. A column of docs named
    lines_removed is replaced.
    """
    id_, x_, lines_ = fresh(docs, "_id", "_x", "_lines")
    gone = repeated_lines(docs, id_col, text_col, passage).withColumnsRenamed({"doc_id": id_, "x": x_, "lines": lines_})
    x = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    both = docs.join(gone.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (x == F.col(x_)), "left")
    bound = F.array(F.struct(F.split(F.col(text_col), "\n", -1).alias("all"), F.col(lines_).alias("gone")))  # worked out once
    left = lambda b: F.array_except(F.sequence(F.lit(0), F.size(b["all"]) - 1), b["gone"])
    kept = F.transform(bound, lambda b: F.array_join(F.transform(left(b), lambda k: F.get(b["all"], k)), "\n"))[0]
    removed = F.coalesce(F.size(lines_), F.lit(0)).cast("long")
    out = both.withColumn(text_col, F.when(F.col(lines_).isNull(), F.col(text_col)).otherwise(kept)).withColumn("lines_removed", removed)
    return out.drop(id_, x_, lines_)
