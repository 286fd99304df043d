"""Sentences against a walk over the characters, over all documents and over built cases."""

import os
import re

import pytest
from loomtext.functions import text as T
from loomtext.plans import catalogue

DATA = "/root/testdata/sf0.001"
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st")
CLOSERS = "”\"'’」)]}"


def stops(t, i):
    """Whether the full stop at place i ends a sentence."""
    before, after, two = t[i - 1 : i], t[i + 1 : i + 2], t[i + 2 : i + 3]
    if after == "." or (before in set("0123456789") and after in set("0123456789") and before and after):
        return False
    if before.isalpha() and after.isalpha() and two == ".":
        return False
    follows = after if after != " " else two
    pair = t[max(0, i - 3) : i + 1]
    if re.fullmatch(r"[A-Za-z]\.[A-Za-z]\.", pair) and not re.match(r"\w", t[i - 4 : i - 3]) and follows.islower():
        return False
    word = re.search(r"[A-Za-z]+\Z", t[:i])
    return not (word and word[0].lower() in TITLES and follows.isupper())


def sentences(text):
    t, out, start, i = " ".join((text or "").split()), [], 0, 0
    while i < len(t):
        if t[i] in "。！？!?" or (t[i] == "." and stops(t, i)):
            i += 1
            while i < len(t) and t[i] in CLOSERS:
                i += 1
            out.append(t[start:i].strip())
            start = i
        else:
            i += 1
    return [s for s in [*out, t[start:].strip()] if s]


CASES = [
    ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
    ("It is 3.14 of it. Done.", ["It is 3.14 of it.", "Done."]),
    ("Dr. Who met Mrs. Smith. They left.", ["Dr. Who met Mrs. Smith.", "They left."]),
    ("He saw the dr. and left.", ["He saw the dr.", "and left."]),
    ("By J.R. Ewing, e.g. here. Next.", ["By J.R.", "Ewing, e.g. here.", "Next."]),
    ("Wait... what? \"No.\" he said.", ["Wait...", "what?", "\"No.\"", "he said."]),
    ("下雨了。他说：“走吧！”好。", ["下雨了。", "他说：“走吧！”", "好。"]),
    ("  \n ", []),
    (None, []),
]


def test_sentences_of_cases(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, text string")
    got = {r["k"]: r["s"] for r in df.select("k", T.split_sentences("text").alias("s")).collect()}
    assert [got[k] for k in range(len(CASES))] == [s for _, s in CASES] == [sentences(t) for t, _ in CASES]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_sentences_of_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    turns = {r["id"]: r["text"] for r in spark.read.parquet(f"{DATA}/conversations.parquet").selectExpr("conv_id * 1000 + turn AS id", "translate(text, ' ae', '.。A') AS text").collect()}
    got = {r["doc_id"]: r["s"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", T.split_sentences("text").alias("s")).collect()}
    assert got == {k: sentences(t) for k, t in docs.items()} and sum(map(len, got.values())) > 1000
    dotted = spark.createDataFrame(list(turns.items()), "id long, text string").select("id", T.split_sentences("text").alias("s")).collect()
    assert {r["id"]: r["s"] for r in dotted} == {k: sentences(t) for k, t in turns.items()}
    assert catalogue.queries()["sentence_list"](spark, DATA).count() > 0
