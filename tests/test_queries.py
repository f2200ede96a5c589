"""Every inventory query against its SQL in DuckDB, over the driver's tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
import stowage.queries_reports  # noqa: F401
from stowage.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    assert plain(frame.select(columns).collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
