"""Planners, health, protection and histories on small inventories."""

import pytest
from pyspark.sql import functions as F

from stowage.functions import names
from stowage.operators import health, history, order
from stowage.plans import planners

FILES = "path string, path_key string, dir_key string, name string, size long, mtime long, full_hash string, is_link boolean, cloud_only boolean, volume_serial long, file_index long"
DIRS = "dir_key string, parent_key string, mode string, is_link boolean, read_error boolean, summary_size long, summary_files long, direct_entries long"


def inventory(spark, files):
    """(files, dirs) of ``{path: (hash, time, file index)}`` below ``/c/``."""
    rows, dirs = [], {"/c/": 0}
    for path, (content, time, index) in files.items():
        folder, _, name = path.rpartition("/")
        rows.append((path, path.lower(), folder.lower() + "/", name, 0 if content is None else 10, time, content, False, False, 1, index))
        parts = folder.lower().split("/")[1:]
        for i in range(2, len(parts) + 1):
            dirs.setdefault("/" + "/".join(parts[:i]) + "/", 0)
        dirs[folder.lower() + "/"] += 1
    for key in dirs:
        if key != "/c/":
            dirs[key.rstrip("/").rpartition("/")[0] + "/"] += 1
    made = [(k, None if k == "/c/" else k.rstrip("/").rpartition("/")[0] + "/", "full", False, False, 0, 0, n) for k, n in dirs.items()]
    return spark.createDataFrame(rows, FILES), spark.createDataFrame(made, DIRS)


def plan(spark, files, *args, **options):
    f, d = inventory(spark, files)
    return {(r.path, r.action, r.reason, r.keep) for r in planners.plan_dedupe_dirs(f, d, "/c/", *args, **options).collect()}


TREES = {"/c/a/x/1": ("h", 5, 1), "/c/a/2": ("g", 5, 2), "/c/b/x/1": ("h", 6, 3), "/c/b/2": ("g", 6, 4), "/c/c/x/1": ("h", 9, 5), "/c/c/3": ("f", 9, 6)}


def test_copy_of_a_folder_inside_equal_trees(spark):
    """b goes for a; c/x goes for a/x, which stays because a does, though c/x is newer."""
    want = {("/c/b/", "quarantine", "exact-duplicate-dir", "/c/a/"), ("/c/c/x/", "quarantine", "exact-duplicate-dir", "/c/a/x/")}
    assert plan(spark, TREES, "oldest") == want
    newest = plan(spark, TREES, "newest")
    assert newest == {("/c/a/", "quarantine", "exact-duplicate-dir", "/c/b/"), ("/c/c/x/", "quarantine", "exact-duplicate-dir", "/c/b/x/")}


def test_folders_that_cannot_go(spark):
    linked = {"/c/a/1": ("h", 5, 1), "/c/b/1": ("h", 5, 1), "/c/d/1": ("h", 5, 2)}
    assert plan(spark, linked, "oldest") == {("/c/b/", "skip", "hardlink", None), ("/c/d/", "quarantine", "exact-duplicate-dir", "/c/a/")}
    two = {"/c/a/1": ("h", 5, 1), "/c/b/1": ("h", 5, 2)}
    assert plan(spark, two, "oldest", protect=["/c/a/1"]) == {("/c/a/", "skip", "protected", None), ("/c/b/", "skip", "group-incomplete", None)}
    assert plan(spark, two, "path", prefix="/c/z") == {("/c/a/", "skip", "group-incomplete", None), ("/c/b/", "skip", "group-incomplete", None)}
    assert plan(spark, two, "oldest", min_bytes=11) == set()
    archived = {"/c/a/1": ("h", 5, 1), "/c/_Archiv/b/1": ("h", 5, 2)}
    assert plan(spark, archived) == set()
    named = {"/c/a - kopie/1": ("h", 1, 1), "/c/b/1": ("h", 5, 2)}
    assert plan(spark, named, "oldest") == {("/c/a - kopie/", "quarantine", "exact-duplicate-dir:copy-name", "/c/b/")}
    assert plan(spark, {"/c/a/" + "n" * 250: ("h", 1, 1), "/c/b/" + "n" * 250: ("h", 5, 2)}, "oldest") == {("/c/b/", "skip", "path-too-long", None)}
    assert plan(spark, {"/c/a/1": ("h", 5, 1)}) == set()


def test_projects_are_protected(spark):
    from stowage.plans import protect

    files, dirs = inventory(spark, {"/c/p/Package.json": ("h", 1, 1), "/c/p/sub/a.tmp": ("g", 1, 2), "/c/q/a.tmp": ("g", 2, 3), "/c/q/.git/x.tmp": ("g", 3, 4), "/c/r/my.csproj.txt": ("k", 1, 5), "/c/r/b.tmp": ("l", 1, 6)})
    guarded = protect.protection(files, "/c/", user=["/c/nothing"])
    assert {(r.name, r.protection) for r in guarded.collect()} == {("Package.json", "project-marker"), ("a.tmp", "project-marker"), ("a.tmp", None), ("x.tmp", "name"), ("my.csproj.txt", None), ("b.tmp", None)}
    got = {(r.path, r.reason) for r in planners.plan_junk(guarded, 10**15).collect()}
    assert got == {("/c/p/sub/a.tmp", "protected"), ("/c/q/a.tmp", "junk:temp"), ("/c/q/.git/x.tmp", "protected"), ("/c/r/b.tmp", "junk:temp")}
    assert {(r.path, r.reason) for r in planners.plan_dedupe(guarded).collect()} == {("/c/p/sub/a.tmp", "protected"), ("/c/q/a.tmp", "group-incomplete"), ("/c/q/.git/x.tmp", "protected")}


def test_health(spark):
    day = 864_000_000_000
    files, dirs = inventory(spark, {"/c/a/Bericht v1.doc": ("h", 0, 1), "/c/a/bericht v2.doc": ("g", 999 * day, 2), "/c/_Archiv/x v1.doc": ("k", 0, 3), "/c/_Archiv/x v2.doc": ("l", 0, 4), "/c/a/cloud.tmp": ("m", 999 * day, 5)})
    files = files.withColumn("cloud_only", F.col("name") == "cloud.tmp")
    got = {r.folder: r for r in health.metrics(files, dirs, "/c/", 1000 * day, []).collect()}
    assert got[""].files == 0 and got[""].dirs == 1 and got["/c/a/"].old_bytes == 10 and got["/c/_archiv/"].old_bytes == 0
    assert got["/c/a/"].version_excess == 1 and got["/c/_archiv/"].version_excess == 0
    assert got["/c/a/"].junk_files == 0 and got["/c/a/"].cloud_bytes == 10 and got["/c/a/"].problems_by_kind == {"temp_file": 1} and got["/c/a/"].template_checked is None
    columns = [*health.NUMBERS, *health.TEMPLATE]
    row = {c: 0 for c in columns} | {"folder": "f", "files": 1000, "size": 100, "junk_files": 25, "dirs": 10, "template_checked": 10, "template_deviations": 3}
    bare = row | {"folder": "g", "template_checked": None, "template_deviations": None}
    table = spark.createDataFrame([tuple(r[c] for c in ("folder", *columns)) for r in (row, bare)], "folder string, " + ", ".join(f"{c} long" for c in columns))
    f, g = health.scores(table).orderBy("folder").collect()
    assert (f.junk, f.template, f.score, f.junk_deduction, f.template_deduction) == (50.0, 0.0, 75, 8.3, 16.7)
    assert (g.template, g.score, g.junk_deduction, g.template_deduction) == (None, 90, 10.0, 0.0)
    off = health.scores(table, {"junk": 0, "dups": 0}).first()
    assert off.junk is None and off.problems is None and off.score == 100
    assert [(r.place, r.part) for r in health.top_deductions(health.scores(table)).where("folder = 'f'").orderBy("place").collect()] == [(1, "template"), (2, "junk")]


def test_places(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"))
    assert {(r.v, r.place) for r in order.numbered(rows, F.desc("v")).collect()} == {(v, 1000 - v) for v in range(1000)}
    assert order.numbered(rows.where("v < 0"), F.asc("v")).count() == 0


def test_history_is_appended(spark, tmp_path):
    for i in (1, 2):
        history.append(spark.createDataFrame([(i, "/c/")], "snapshot_id int, root_key string"), spark.createDataFrame([(i, "", i * 10)], "snapshot_id int, folder string, score int"), str(tmp_path))
    spark.createDataFrame([(3, "", 1)], "snapshot_id int, folder string, score int").write.mode("append").parquet(f"{tmp_path}/folders")
    snapshots, folders = history.read(spark, str(tmp_path))
    assert snapshots.count() == 2 and {r.score for r in folders.collect()} == {10, 20}


@pytest.mark.parametrize(("name", "score"), [("old alt", 2), ("Kopie von x (2)", 3), ("plan", 0)])
def test_words_of_copies(spark, name, score):
    assert spark.range(1).select(names.copy_name_score(F.lit(name)).alias("s")).first().s == score


def test_review_order(spark):
    from stowage.operators import review

    rows = spark.createDataFrame([("/c/b", "move", "/c/y", "r", 5, 3), ("/c/A", "quarantine", None, "s", 5, 1), ("/c/d/", "remove-dir", None, "a", 0, 2)], "path string, action string, target string, reason string, size long, mtime long")
    got = {c: [r.path for r in review.ordered(rows, c).collect()] for c in ("action", "source", "target", "size", "reason", "age")}
    assert got == {
        "action": ["/c/A", "/c/b", "/c/d/"], "source": ["/c/A", "/c/b", "/c/d/"], "target": ["/c/A", "/c/d/", "/c/b"],
        "size": ["/c/d/", "/c/A", "/c/b"], "reason": ["/c/d/", "/c/b", "/c/A"], "age": ["/c/A", "/c/d/", "/c/b"],
    }
    assert [r.path for r in review.ordered(rows, "age", ascending=False).collect()] == ["/c/b", "/c/d/", "/c/A"]
    assert [r.path for r in review.ordered(rows, "target", ascending=False).collect()] == ["/c/b", "/c/A", "/c/d/"]
