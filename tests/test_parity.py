"""Each query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from pairloom.plans.queries import ORACLE, QUERIES

DATA = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.7g}" if isinstance(v, float) else str(v)

    return sorted(columns), sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    theirs = duck.sql(ORACLE[name])
    assert plain([tuple(r) for r in ours.collect()], ours.columns) == plain(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
