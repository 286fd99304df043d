"""Document fingerprints by one-permutation MinHash, in DataFrame functions only."""

from __future__ import annotations

from functools import cache

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BINS = 128
#: Low-order bits kept of each bin's minimum, as hexadecimal digits.
BITS = 8
DIGITS = BITS // 4
#: Bits of a shingle's hash below those that choose its bin.
LOW = 64 - (BINS.bit_length() - 1)
WORDS = 5
SEED = 29
#: Rows that are put in order in one task.
ROWS_A_RANGE = 1_000_000


@cache
def _met() -> str:
    """For each bin all bins, in the order in which its tries (xxhash64 of its number and the try) first meet them; comma separated."""
    out: list[int] = []
    for i in range(BINS):
        seed, seen, j = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42), {}, 0
        while len(seen) < BINS:
            j += 1
            seen.setdefault(xxhash.xxh64_intdigest(j.to_bytes(4, "little"), seed) % BINS)
        out += seen
    return ",".join(map(str, out))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: the fingerprint of the column text, BITS of each of BINS bins in hexadecimal digits.

    Words are the runs between white space (space, tab to carriage return), in lower case. Each
    run of WORDS words is a shingle, hashed once to 64 bits: the upper ones choose its bin and
    each bin keeps its least hash. With fewer words all of them are one shingle; with none the
    fingerprint is dashes, like only to another such. An empty bin takes the value of a filled one,
    found by hashing its own number and the count of tries until it meets one (optimal densification). Null text is empty.
    """
    a, b, c, d = (f"_{out}_{k}" for k in "abcd")
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))
    df = df.withColumn(a, F.transform(words, lambda w: F.xxhash64(w)))
    whole = F.array(F.xxhash64(F.lit(SEED), F.col(a)))
    runs = F.transform(F.slice(F.col(a), F.lit(1), F.greatest(F.size(a) - F.lit(WORDS - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(F.col(a), i + F.lit(k)) for k in range(1, WORDS)]))
    # A sentinel in each bin is larger than all hashes there, so that the first of a bin is its least hash, or the sentinel if the bin is empty.
    empty = F.lit((1 << LOW) - 1)
    sentinels = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda k: F.shiftleft(k.cast("long"), LOW).bitwiseOR(empty))
    df = df.withColumn(b, F.sort_array(F.concat(F.when(F.size(a) >= WORDS, runs).when(F.size(a) > 0, whole).otherwise(F.array().cast("array<bigint>")), sentinels)))
    first = F.filter(F.col(b), lambda x, i: (i == 0) | (F.shiftright(x, LOW) != F.shiftright(F.get(F.col(b), i - F.lit(1)), LOW)))
    df = df.withColumn(c, first)
    low = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1)))), DIGITS, "0")
    filled = lambda p: F.get(F.col(c), p).bitwiseAND(empty) != empty

    met = F.split(F.lit(_met()), ",").cast("array<int>")  # a constant, worked out once

    def dense(x: Column, i: Column) -> Column:
        # the first filled bin in the order of its tries; that order is looked through in two parts, the second where the first has none
        first = lambda a, z: F.get(F.filter(F.slice(met, i * F.lit(BINS) + F.lit(a + 1), F.lit(z - a)), filled), F.lit(0))
        at = F.coalesce(first(0, 8), first(8, BINS))
        return F.when(x.bitwiseAND(empty) != empty, x).otherwise(F.get(F.col(c), at))

    df = df.withColumn(d, F.when(F.size(a) > 0, F.transform(F.col(c), dense)))
    digits = F.array_join(F.transform(F.col(d), low), "")
    return df.withColumn(out, F.coalesce(digits, F.lit("-" * (BINS * DIGITS)))).drop(a, b, c, d)


def likeness(x: str, y: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    Bins agree by chance in one of 2**BITS bins: J = (share - 1/2**BITS) / (1 - 1/2**BITS), at least 0.
    """
    part = lambda c, k: F.substr(F.col(c), k * F.lit(DIGITS) + F.lit(1), F.lit(DIGITS))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: part(x, k) == part(y, k)))
    chance = 1.0 / (1 << BITS)
    share = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(F.col(x) == F.col(y), F.lit(1.0)).when(F.col(x).startswith("-") | F.col(y).startswith("-"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), share))


def next_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x, next_id, next_x) for each distinct document, x being the hash of its text; the last's next is the first.

    Order: doc_id, then x. Ranges of doc_id, of about ROWS_A_RANGE rows or as many as there are shuffle partitions, are
    ordered each in its own task; the first of each range is handed to the range before, so only as many rows as there
    are ranges meet in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("x")).distinct()
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS_A_RANGE)
    ranged = written(keys.repartitionByRange(n, "doc_id", "x").withColumn("range", F.spark_partition_id()), "ranged")
    key = F.struct("doc_id", "x")
    firsts = ranged.groupBy("range").agg(F.min(key).alias("first"))
    every = Window.partitionBy(F.lit(0))
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(every.orderBy("range")), F.min("first").over(every)).alias("after"))
    own = ranged.withColumn("own", F.lead(key).over(Window.partitionBy("range").orderBy("doc_id", "x")))
    linked = own.join(firsts, "range").withColumn("n", F.coalesce("own", "after"))
    return linked.select("doc_id", "x", F.col("n.doc_id").alias("next_id"), F.col("n.x").alias("next_x"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    The edited text: the last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document's by doc_id; after the last comes the first. Equal doc_ids follow each
    other by the hash of their text; rows equal in both are one document and get equal results. Null text is
    empty; null doc_ids are alike and come first. An empty table gives an empty result; a table of one document is its own next. Other columns
    of docs are not looked at.

    Texts are shuffled once, by document; both joins read that exchange. Only the part that replaces
    an end moves a second time.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    nexts = written(next_ids(docs, id_col, text_col), "nexts")
    boxed = lambda c: F.struct(F.col(c).alias("id"))  # noqa: E731  # equal to another null where a bare null isn't
    nexts = nexts.select(boxed("doc_id").alias("doc_id"), "x", boxed("next_id").alias("next_id"), "next_x")
    own = docs.select(boxed(id_col).alias("doc_id"), text.alias("text")).withColumn("x", F.xxhash64("text"))
    own = with_fingerprint(own, "text", "fingerprint")  # both joins read these columns, so that they share one exchange
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    lengths = docs.select(boxed(id_col).alias("doc_id"), F.xxhash64(text).alias("x"), F.char_length(text).alias("n_chars")).distinct()
    wants = nexts.join(lengths, ["doc_id", "x"]).select(F.col("next_id").alias("doc_id"), F.col("next_x").alias("x"), F.col("doc_id").alias("to_id"), F.col("x").alias("to_x"), quarter.alias("need"))
    gives = own.join(wants, ["doc_id", "x"]).select(F.col("to_id").alias("doc_id"), F.col("to_x").alias("x"), F.expr("substring(text, 1, need)").alias("tail"), F.col("fingerprint").alias("next_fingerprint"))
    gives = gives.groupBy("doc_id", "x").agg(F.first("tail").alias("tail"), F.first("next_fingerprint").alias("next_fingerprint"))
    both = own.join(gives, ["doc_id", "x"]).withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.col("tail")))
    both = both.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    both = with_fingerprint(both, "edited", "edited_fingerprint")
    return both.select(
        F.col("doc_id.id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
