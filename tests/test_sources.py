"""Readers, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from stowage.sources import bindings, readers
from stowage.streaming import scans


def test_journal_lines(spark, tmp_path):
    good = '{"run":1,"action":2,"seq":%d,"bytes":3,"stamp":4,"kind":"done"}\n'
    (tmp_path / "a.jsonl").write_text(good % 1 + good % 2 + '{"run":1,"act')
    assert readers.read_journal(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text(good % 1 + "{broken\n" + good % 2)
    with pytest.raises(Exception, match="broken line"):
        readers.read_journal(spark, str(tmp_path / "b.jsonl")).collect()


def test_run_log_skips_broken_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"profile":1,"seq":1,"status":"ok","score":3}\nnope\n{"profile":1,"seq":2,"status":"ok","score":3}\n')
    assert readers.read_run_log(spark, str(tmp_path / "r.jsonl")).count() == 2


def test_sealed_plan(spark, tmp_path):
    plan = spark.createDataFrame([("/c/a", "move", "/c/b", "r"), ("/c/x", "skip", None, "link")], "path string, action string, target string, reason string")
    path = str(tmp_path / "plan")
    readers.write_plan(plan, path)
    assert sorted(readers.read_plan(spark, path).collect(), key=str) == sorted(plan.collect(), key=str)
    assert readers.seal(plan.repartition(3)) == readers.seal(plan)
    part = next(p for p in (tmp_path / "plan").glob("*.json") if "/c/a" in p.read_text())
    text = part.read_text().replace("/c/b", "/c/evil")
    (tmp_path / "plan" / f".{part.name}.crc").unlink()
    part.write_text(text)
    with pytest.raises(ValueError):
        readers.read_plan(spark, path)


def test_csv_guard(spark, tmp_path):
    readers.write_csv(spark.createDataFrame([("=1+1", 1), ("ok", 2)], "a string, b int"), str(tmp_path / "csv"))
    assert sorted(r.a for r in spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).collect()) == ["'=1+1", "ok"]


def test_merged_stream(spark, sf_dir, tmp_path):
    files = bindings.files(spark, sf_dir).select("path_key", "size", "generation")
    files.coalesce(1).write.parquet(str(tmp_path / "in"))
    files.where("size > 100").withColumn("size", F.lit(1).cast("long")).withColumn("generation", F.lit(9).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scans.merge_stream(events, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(120)
    got = {r.path_key: (r.size, r.generation) for r in spark.read.parquet(str(tmp_path / "table" / "v=1")).collect()}
    want = {r.path_key: (1, 9) if r.size > 100 else (r.size, r.generation) for r in files.collect()}
    assert got == want


def test_report_files(spark, sf_dir, tmp_path):
    from stowage.sources import reports

    made = reports.build(bindings.files(spark, sf_dir), bindings.dirs(spark, sf_dir), bindings.errors(spark, sf_dir), bindings.ROOT, bindings.NOW, ["laptop"])
    text = reports.write(made, str(tmp_path / "r"), "csv, JSON,html,terminal,csv", "A <b> report")
    page = (tmp_path / "r" / "report.html").read_text()
    assert "A &lt;b&gt; report" in page and page.count("<section") == len(made) and text.count("== ") == len(made)
    for name, rows in made.items():
        n = rows.count()
        parts = [p.read_bytes() for p in (tmp_path / "r" / "csv" / name).glob("*.csv")]
        assert all(p.startswith(b"\xef\xbb\xbf") for p in parts if p)
        assert spark.read.option("sep", ";").option("header", True).option("escape", '"').csv(str(tmp_path / "r" / "csv" / name)).count() == n
        assert spark.read.schema(rows.schema).json(str(tmp_path / "r" / "json" / name)).count() == n
    for bad in ("", "pdf", "csv,xml"):
        with pytest.raises(ValueError):
            reports.parse_formats(bad)


def test_config():
    from stowage.plans import config

    text = """
exclude = ["b", "a"]
junk_categories = ["temp", "mine"]
old_after = "2y"
[[junk_rules]]
name = "mine"
patterns = ["*.bak"]
min_age = "3d"
[health.weights]
junk = 0
[profiles.work]
root = "/c/"
exclude = ["a", "c"]
top = 5
"""
    base, work = config.parse(text), config.parse(text, "work")
    assert (base["exclude"], work["exclude"], base["top"], work["top"], work["root"]) == (["b", "a"], ["b", "a", "c"], 50, 5, "/c/")
    assert base["weights"]["junk"] == 0 and base["weights"]["versions"] == 15 and base["notify"]["score_drop"] == 5
    assert [(c.name, c.min_age) for c in config.junk_categories(base)] == [("temp", None), ("mine", 3)]
    assert config.parse("")["exclude"] == [] and config.DEFAULTS["exclude"] == []
    same = config.parse(text.replace('["b", "a"]', '["a", "b", "a"]'))
    assert config.fingerprint(base) == config.fingerprint(same) != config.fingerprint(work)
    assert config.fingerprint(base) != config.fingerprint(base, "t") and config.fingerprint(base) != config.fingerprint(config.parse(text.replace('"temp", "mine"', '"mine", "temp"')))
    for bad in ("x = 1", 'top = "5"', "top = true", 'old_after = "0d"', 'junk_categories = ["other"]', "[health.weights]\nnone = 1", "[profiles.work]\nfoo = 1"):
        with pytest.raises(ValueError):
            config.parse(bad, "work" if "profiles" in bad else None)
    with pytest.raises(ValueError):
        config.parse("", "missing")


def test_cache_store(spark):
    from stowage.operators import state

    schema = "path_key string, status string, classified_at long, extractor_version int"
    old, new = spark.createDataFrame([("a", "x", 1, 1), ("b", "x", 1, 1)], schema), spark.createDataFrame([("a", "y", 2, 1), ("c", None, 1, 1)], schema)
    assert {(r.path_key, r.status) for r in state.cache_store(old, new).collect()} == {("a", "y"), ("b", "x"), ("c", None)}
