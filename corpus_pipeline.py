"""From documents to packed training sequences, in five stages.

Each stage works on all rows the one before kept and is written as a table before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import contamination, langid, lines, neardup, tokens
from loomtext.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: without letters, or no language with half of the score.

    Null and empty texts have no letters and go. Rows alike stay or go together; nulls in other columns stay as they are; a
    table without labelled rows teaches no language, and all its documents go; an empty table gives an empty one.
    """
    return langid.identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated chunks of lines out of the texts; a document of which nothing but white space is left goes.

    n_chars becomes the number of code points that are left where lines went. Of equal parts the one of the least doc_id
    stays, null doc_ids first; rows alike in doc_id and text are one document and keep equal texts. Null texts, if any reach
    this stage, stay null and are kept; empty tables give empty ones.
    """
    out = lines.without_repeated_lines(docs)
    left = (F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least doc_id, of each group of near duplicates: five words, similarity 0.8.

    Null and empty texts are in no group and stay. Rows alike in doc_id and text stay or go together. A row without doc_id goes if
    its group has a doc_id; in a group without any all rows stay. Empty tables give empty ones.
    """
    return neardup.without_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that passages of the benchmark contaminate: at least a twentieth of their words lie in its windows.

    Null and empty texts, on either side, have no words and no hits. Rows alike stay or go together, whatever their doc_ids; an
    empty benchmark drops nothing; an empty table gives an empty one.
    """
    return contamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens: one row for each piece.

    A null text is its end token alone. Rows alike are packed each on its own; a null doc_id stays null; an empty table gives an
    empty result.
    """
    return tokens.pack(docs, size=2048, end_id=1)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: None: SQL has no merges of byte pairs, no language model and no content-defined chunks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result but the last is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
