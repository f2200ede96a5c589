"""Queries over inventories in which several rows have one path, against their SQL."""

import os

import duckdb
import pytest

from stowage.operators import state
from stowage.plans import rules
from stowage.queries import ORACLE, QUERIES
from test_queries import plain


@pytest.fixture(scope="module")
def same_paths(sf_dir, tmp_path_factory):
    """The driver's tables with documents of two sources only, so that many files have one path, and each line item twice."""
    out = tmp_path_factory.mktemp("same-paths")
    for name in os.listdir(sf_dir):
        if name not in ("documents.parquet", "lineitem.parquet"):
            os.symlink(f"{sf_dir}/{name}", out / name)
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ('src' || (doc_id % 2 * 3) AS source) FROM '{sf_dir}/documents.parquet') TO '{out}/documents.parquet' (FORMAT parquet)")
    duckdb.connect().execute(f"COPY (SELECT l.* FROM '{sf_dir}/lineitem.parquet' l, range(2)) TO '{out}/lineitem.parquet' (FORMAT parquet)")
    return str(out)


@pytest.fixture(scope="module")
def duck_same(same_paths):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(same_paths):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{same_paths}/{name}'")
    return con


@pytest.mark.parametrize("name", ["plan_versions", "action_counts", "review_skips", "review_summary", "plan_limits", "plan_skips", "plan_totals", "staged_hashes", "big_exact_dups"])
def test_same_paths(spark, duck_same, same_paths, name):
    frame = QUERIES[name](spark, same_paths)
    columns = sorted(frame.columns)
    want = duck_same.sql(ORACLE[name]).select(*(f'"{c}"' for c in columns)).fetchall()
    assert plain(frame.select(columns).collect()) == plain(want)


def test_rules_stats_one_folder(spark, sf_dir, tmp_path):
    """The counts and examples are those of the SQL where all files lie in a few folders and many have one path."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * REPLACE ('src3' AS source, 'de' AS lang) FROM '{sf_dir}/documents.parquet') TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    frame = QUERIES["rules_stats"](spark, str(tmp_path))
    want = con.sql(ORACLE["rules_stats"]).select(*(f'"{c}"' for c in frame.columns)).fetchall()
    assert plain(frame.collect()) == plain(want)


@pytest.fixture(scope="module")
def pictures(spark):
    """A plan for two files with one path to move, and two with one path that are where they should be."""
    rows = [("/c/a/x.jpg", "h1"), ("/c/a/x.jpg", "h2"), ("/c/b/y.jpg", "h3"), ("/c/b/y.jpg", "h4")]
    files = spark.createDataFrame([(p, p, p[:5], p[5:], "jpg", 1, h) for p, h in rows], "path string, path_key string, dir_key string, name string, ext string, size long, full_hash string")
    files = files.selectExpr("*", "0L AS mtime", "false AS cloud_only", "false AS is_link", "CAST(NULL AS string) AS category", "CAST(NULL AS double) AS confidence", "CAST(NULL AS map<string,string>) AS fields")
    return rules.plan_rules(files, rules.parse('[[rule]]\nname = "p"\next = "jpg"\ntarget = "b/{stem}.{ext}"'), 0, "/c/")


def test_rules_same_path(pictures):
    got = sorted((r.path, r.target, r.reason) for r in pictures.collect())
    assert got == [("/c/a/x.jpg", "/c/b/x (2).jpg", "rule:p"), ("/c/a/x.jpg", "/c/b/x.jpg", "rule:p"), ("/c/b/y.jpg", None, "already-there"), ("/c/b/y.jpg", None, "already-there")]


def test_rules_stats_same_path(pictures):
    assert [tuple(r) for r in rules.stats(pictures).collect()] == [("p", 2, 2, "/c/a/x.jpg|/c/a/x.jpg")]


def test_merge_latest_ties(spark):
    """Of rows of one path and generation, that with the smallest id stays, in a later part if there is one."""
    part = lambda *rows: spark.createDataFrame(rows, "path_key string, generation long, size long, id long")
    got = state.merge_latest(part(("/a", 1, 9, 5), ("/a", 1, 2, 3), ("/b", 1, 1, 1)), part(("/b", 1, 8, 7), ("/b", 1, 4, 6)), first="id")
    assert sorted((r.path_key, r.size) for r in got.collect()) == [("/a", 2), ("/b", 4)]
