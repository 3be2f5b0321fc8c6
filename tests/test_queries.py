"""Every core query against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from lexmill.plans import oracle
from lexmill.plans import queries as plans


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, small, con, name):
    df = plans.queries()[name](spark, small)
    got = [tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()]
    if name not in oracle.SQL:
        return
    r = con.execute(oracle.SQL[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    as_float = lambda v: f"{float(v):.9g}" if v.__class__.__name__ == "Decimal" else plain(v)
    assert sorted(got) == sorted(tuple(as_float(row[i]) for i in order) for row in r.fetchall())


def test_no_oracle_without_query():
    assert {*oracle.SQL} <= {*plans.queries()}


def test_windows_and_merges_are_of_the_documents(spark, small):
    from pyspark.sql import functions as F

    from lexmill.operators import tokens

    docs = spark.read.parquet(f"{small}/documents.parquet").where("text IS NOT NULL")
    n = docs.agg(F.sum(F.length("text") + 1)).first()[0]
    w = plans.random_windows(spark, small).collect()
    assert len(w) == n // 128 and {r["n_tokens"] for r in w} == {128}
    got = [(r["first_piece"], r["second_piece"]) for r in plans.bpe_merges(spark, small).orderBy("rank_no").collect()]
    assert got == tokens.train(tokens.pretoken_counts(docs), tokens.VOCABULARY) and len(got) > 500
