"""The queries that SQL can express, side by side with DuckDB."""

import glob
import os

import duckdb
import pytest
from palimpsest.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, DIR)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(
        map(str, spark.createDataFrame(want.select(*columns).fetchall(), got.select(columns).schema).collect())
    )
