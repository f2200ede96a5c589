"""The pipeline and the queries of the corpus operators over the driver's tables."""

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from stowage.llm import near_dup
from stowage.llm.queries import MODEL_PATH, queries


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, now = docs.columns, docs.withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in now.collect()}
        now = spark.createDataFrame(stage(spark, now, sf_dir).collect(), now.schema)
        assert now.columns == [*columns, "extra"], name
        after = {r.doc_id: r for r in now.collect()}
        assert set(after) <= set(before), name
        if name == "MinHash near-dedup":
            want = brute.near_duplicates([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(after) == {i for i, r in before.items() if not brute.contamination(r.text, items)[4]}
        if name == "line dedup":
            gone = brute.template_lines([(i, r.text) for i, r in before.items()], min_tokens=1)
            left = {i: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone.get(i, ())) for i, r in before.items()}
            assert {i: r.text for i, r in after.items()} == {i: t for i, t in left.items() if i not in gone or t.strip()}
            assert all(r.n_chars == len(r.text) for r in after.values())


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination_by_row(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr("stowage.llm.shared.BROADCAST_KEYS", broadcast)
    item = " ".join(f"w{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item}"), (None, "clean"), (1, item), (1, "a clean row of that id"), (2, None), (None, None), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, [r for r in rows if not r[1] or item not in r[1]]))


def test_stages_keep_odd_rows_and_columns(spark, sf_dir):
    """Null ids, texts and languages, repeated rows and ids, a very long text, columns named like the operators' own."""
    names = ("_language", "_places", "_id", "_digest", "_row_key", "id", "row", "component_id", "digest", "lines_dropped", "key", "ids")
    text = "the people of the town walk along the river and look at the water every day"
    long = " ".join(f"word{'abcdefghij'[i % 10]} and" for i in range(40_000))
    rows = [(1, text, "en"), (1, text, "en"), (2, None, "en"), (None, text + " again", None), (3, "", "de"), (4, "1 2 3", None), (5, long, "en"), (6, text + " now", "en"), (None, None, None)]
    rows += [(10 + i, f"ein haus steht {w} an dem fluss und niemand geht hinein", "de") for i, w in enumerate(("heute", "morgen", "immer", "nie"))]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, sf_dir)
        got = now.collect()
        if name != "SentencePiece":
            assert now.columns == docs.columns and all(r[n] == k for r in got for k, n in enumerate(names)), name
        assert {r.doc_id for r in got} >= {1, None, 5, 10}, name
        docs = spark.createDataFrame(got, now.schema)
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL_PATH)
    assert {tuple(r.ids) for r in got if r.doc_id == 5} == {tuple(library.encode(long))}


def test_run(spark, sf_dir):
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.count() > 0 and done.where("n_tokens <> size(ids)").count() == 0


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.mark.parametrize("name", [n for n in queries()])
def test_one_row_each(spark, sf_dir, name):
    frame = queries()[name](spark, sf_dir)
    table, key, more = ("pages", "page_id", 0) if "page_id" in frame.columns else ("conversations", "conv_id", 1) if "conv_id" in frame.columns else ("documents", "doc_id", 0)
    ids = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().count() + more
    assert frame.count() == ids == frame.select(key).distinct().count()


def test_near_duplicates_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = {tuple(r) for r in near_dup.near_duplicates(docs.repartition(7)).collect()}
    assert a == {tuple(r) for r in near_dup.near_duplicates(docs.coalesce(1)).collect()}
