"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_rank, ordered_position, written


def interleave(docs: DataFrame, n_shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """Deal rows into shards whose mixture of strata is that of the whole; law ``rows``.

    Rows of a stratum are shuffled by a seeded hash and ranked; rank r of n stands at (r + u) / n,
    where u in 0..1 is the stratum's own phase, so that many small strata don't meet at one place.
    The order of these places, cut into n_shards runs whose lengths differ by one at most, gives
    every shard each stratum's share, but for one or two rows.

    Returns one row for each row of docs: doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot
    (position in the shard), grown_shard (null: another number of shards moves rows anywhere),
    stratum. No text moves; only these narrow columns are shuffled, and a stratum of any size is
    ranked in buckets (hash_rank).

    Null text has size 8 and the crc32 of no bytes, 0. A null stratum is a stratum. Equal texts are rows
    like others: under this law a shard can't hold a group larger than itself. Rows equal in all
    columns get slots of their own. An empty table gives an empty result. Other columns of docs are
    not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum_col).cast("string").alias("stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = written(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")), "rows")
    total = rows.count()
    ties = ["doc_id", "text_crc32", "size"]
    ranked = hash_rank(rows, "stratum", "h", ties, total, "r")
    phase = F.pmod(F.xxhash64(F.lit(seed + 1), F.coalesce("stratum", F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    placed = written(ranked.withColumn("place", (F.col("r") + phase) / F.col("r_of")), "placed")
    at = ordered_position(placed, "place", ["h", *ties, "stratum"], total, "p")
    some = max(total, 1)
    shard = F.expr(f"(({n_shards}L * (p + 1) - 1) div {some}L)")
    return at.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"p - (shard * {some}L) div {n_shards}L").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "stratum",
    )
