"""Corpus queries with an oracle against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from schemaloom.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(got.columns)
    assert columns == sorted(names)
    left = sorted(tuple(repr(r[c]) for c in columns) for r in got.collect())
    assert left == sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, name):
    rows = QUERIES[name](spark, SF_DIR)
    table = {"op1": "pages", "op8": "pages", "op9": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    if name.startswith("op11"):  # a row for each word
        assert rows.count() == rows.select("word").distinct().count() > 0
    else:
        assert rows.count() >= n if name.startswith("op3") else rows.count() == n
