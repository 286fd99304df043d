"""Each query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest
from loomtext.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def value(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = db.execute(sql)
    have = [c[0] for c in cur.description]
    want = sorted((tuple(value(dict(zip(have, r, strict=True))[c]) for c in names) for r in cur.fetchall()), key=repr)
    assert sorted(have) == names and got == want


def test_token_sources_of_every_event(spark):
    got = catalogue.queries()["token_sources"](spark, DATA)
    assert got.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
