"""Python functions run once for each row, on no more than they need."""

import random

from loomtext.functions import text as T
from loomtext.operators import chunking, glossary, quality
from loomtext.plans import catalogue
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("ArrowEvalPython ["), plan


def test_pack_lines_sends_sizes_once(spark):
    nodes, plan = python_nodes(catalogue.queries()["pack_lines"](spark, SMALL))
    assert nodes == 1 and "of_batches" not in plan


def test_replan_remaining_measures_and_packs_once(spark):
    nodes, plan = python_nodes(catalogue.queries()["replan_remaining"](spark, SMALL))
    assert nodes == 2 and plan.count("fit(") == plan.count("ranges(") == 1


def test_packing_by_characters_without_texts_in_python(spark):
    units = [["ab", "c" * 9, "甲乙", "", None, "😀" * 4, "d"], [], None, ["x" * 30], [None], ["e", "f"] * 20]
    df = spark.createDataFrame(list(enumerate(units)), "k int, u array<string>")
    packed = df.select("k", chunking.pack(F.col("u"), 12, 12, "chars").alias("a"), chunking.pack(F.col("u"), 12, 12, "chars", tokens=False).alias("b"))
    for r in packed.collect():
        plain = lambda c: None if c is None else [x[:4] for x in c]
        assert plain(r["a"]) == plain(r["b"])
    out = [(r["k"], r["i"], r["c"]["units"]) for r in T.exploded(packed, "b", "i", "c").orderBy("k", "i").collect()]
    assert {k for k, *_ in out} == {0, 3, 4, 5} and [i for k, i, _ in out if k == 0] == [0, 1, 2, 3] and sum(n for k, _, n in out if k == 5) == 40


def test_quality_report_flattens_once(spark):
    plan = python_nodes(catalogue.queries()["quality_report"](spark, SMALL))[1]
    assert plan.count(T._OTHER_SPACES) == 1


def test_white_space_in_runs(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice([" ", " ", "  ", "\n", "\u3000", "\t", "\xa0", "a", "b.", "甲"]) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert df.where(T.collapse(F.col("s")) != F.trim(F.regexp_replace("s", rf"[{T.SPACES}]+", " "))).count() == 0
    assert df.where(T.has_family("s", 4) != (T.family_length("s") >= 4)).count() == 0


def test_seams_of_few_blocks(spark):
    blocks = [None, [], ["a b c"], [" ", "x"], ["one two three four.", "one  two three four."], ["a", "", "a"], ["the end of it all here", "end of it all here we go"]]
    df = spark.createDataFrame(list(enumerate(blocks)), "k int, b array<string>")
    assert [r["n"] for r in df.select("k", quality.seam_count(F.col("b")).alias("n")).orderBy("k").collect()][1:] == [0, 0, 0, 1, 1, 1]


def test_chunk_segments_brings_a_documents_parts_together_once(spark):
    nodes, plan = python_nodes(catalogue.queries()["chunk_segments"](spark, SMALL))
    assert nodes == 3 and plan.count("fit(") == plan.count("ranges(") == 1 and "FlatMapGroupsInPandas" not in plan
    assert "FlatMapGroupsInPandas" not in python_nodes(catalogue.queries()["small_chunks"](spark, SMALL))[1]


def test_joined_chunks_keep_all_parts(spark):
    rnd = random.Random(2)
    rows = [(d, i, rnd.choice([None, "", "word " * rnd.choice([1, 9, 40, 200]), "甲" * 50]), rnd.choice([None, i * 5.0]), rnd.choice([None, i * 5.0 + 4])) for d in range(40) for i in rnd.sample(range(40), d % 14)]
    df = spark.createDataFrame(rows, "doc_id int, id int, text string, start_time double, end_time double")
    breaks = df.where("id % 6 = 0").select("doc_id", "id")
    made = lambda join: chunking.chunk_segments(df, 60, 80, "tokens", breaks, join).orderBy("doc_id", "chunk_id").collect()
    joined, apart = made(True), made(False)
    assert len(joined) < len(apart)
    for d in {r["doc_id"] for r in apart}:
        own, single = ([r for r in x if r["doc_id"] == d] for x in (joined, apart))
        assert [r["chunk_id"] for r in own] == list(range(len(own)))
        text = lambda x: "".join("".join(r["content"] for r in x).split())
        assert text(own) == text(single)
        assert {r["first_segment"] for r in own} <= {r["first_segment"] for r in single}
        begun = lambda x: [r["first_segment"] for r in x if r["starts_chapter"]]
        assert set(begun(own)) <= set(begun(single))


def test_glossaries_are_read_without_python_workers(spark):
    for name in ("glossary_select", "glossary_report", "glossary_drift"):
        assert "Scan ExistingRDD" not in python_nodes(catalogue.queries()[name](spark, SMALL))[1]
    schema = spark.createDataFrame([], "_k int, term string, score long").schema
    rows = [(0, "a", None), (1, None, 7)]
    assert [tuple(r) for r in glossary.listed(spark, rows, schema).collect()] == rows
    assert glossary.listed(spark, [], schema).count() == 0 and glossary.listed(spark, [], schema).schema == schema
