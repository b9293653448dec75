"""Every query with a SQL twin against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from citelens.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, db, name):
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(db.execute(catalog.oracle_sql()[name]).df())
