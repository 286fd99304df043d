"""Units measured and cut in one pass, and white space as the pattern (?U)\\s has it."""

from loomtext.functions import folds, scan
from loomtext.functions import text as T
from loomtext.operators import chunking
from pyspark.sql import functions as F


def test_units_are_cut_and_measured_in_one_pass(spark):
    rows = [(k, u) for k, u in enumerate([["a b", "word " * 40, "甲" * 30], None, [], ["x"], ["", "y" * 90]] * 130)]
    df = spark.createDataFrame(rows, "doc_id int, s array<string>")
    f = chunking.fitted(df, F.col("s"), 12, "tokens").withColumn("again", scan.unit_counts(F.col("f.u")))
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0
    out = {r["doc_id"]: r for r in f.collect()}
    for k, u in rows:
        want = None if u is None else [p for x in u for p in (folds.cut_by_tokens(x, 12) if x in u and len(x) > 20 else [x])]
        assert out[k]["f"]["u"] == want and out[k]["f"]["m"] == out[k]["again"]


def test_white_space(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"{c}a{c}b{c}",) for c in chars], "s string")
    old = lambda p, x, to="": F.regexp_replace(x, F.lit(p), F.lit(to))
    both = r"(?U)\A\s+|\s+\z"
    same = (T.strip(F.col("s")) == old(both, F.col("s"))) & (T.collapse(F.col("s")) == old(both, old(r"(?U)\s+", F.col("s"), " ")))
    same = same & (T.lstrip(F.col("s")) == old(r"(?U)\A\s+", F.col("s"))) & (T.rstrip(F.col("s")) == old(r"(?U)\s+\z", F.col("s")))
    assert df.where(~same).count() == 0


def test_manifest_measures_by_one_scan(spark):
    rows = [(1, 0, "It's a well-known 甲乙 test. Two!"), (1, 1, ""), (2, 0, "a　b…")]
    m = chunking.manifest(spark.createDataFrame(rows, "doc_id int, chunk_id int, content string"), "p")
    assert "regexp_extract_all" not in m.select("estimated_input_tokens")._jdf.queryExecution().optimizedPlan().toString()
    want = spark.createDataFrame(rows, "doc_id int, id int, content string").select("doc_id", "id", T.estimate_tokens("content").alias("n"))
    assert m.join(want, ["doc_id", "id"]).where("estimated_input_tokens = n").count() == 3
