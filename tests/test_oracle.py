"""Every engine query side by side with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from palimpsest.oracle import ORACLE_SQL
from palimpsest.queries import QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, db, name):
    got = QUERIES[name](spark, DIR)
    want = db.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(columns).collect())))
    assert rows == sorted(map(repr, want.select(*columns).fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["edit", "kind", "n_windows", "n_bytes"]
    assert set(ORACLE_SQL) <= set(e.oracle_sql()) <= set(e.queries())


def test_engine_does_not_need_the_corpus_operators():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(here, "palimpsest")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert "palimpsest.llm" not in f.read(), n
