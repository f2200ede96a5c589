"""A corpus pipeline of five stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which :func:`run` writes as Parquet in the shared folder
and reads again as the next one's ``docs``. All but the last return the columns
of ``documents``; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.llm import decontam, lang_id, line_dedup, near_dup, pieces
from stowage.llm.queries import MODEL_PATH
from stowage.llm.shared import free_name, materialize, without

#: A document goes if its language's share of the posterior is below this.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    told = free_name(docs, "_language")
    found = lang_id.identify(docs, out_col=told)
    known = (F.col(f"{told}.lang") != lang_id.UNKNOWN) & (F.col(f"{told}.score") >= MIN_LANGUAGE_SCORE)
    return found.where(known).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines, ``n_chars`` with them; a document that loses its last word goes."""
    count = free_name(docs, "_lines_dropped")
    done = line_dedup.drop_recurring_lines(docs, count_col=count, **line_dedup.WHOLE)
    done = done.where((F.col(count) == 0) | F.col(count).isNull() | F.col("text").rlike(r"\S"))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*((n_chars if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id; rows that repeat an id are one document."""
    gone = near_dup.near_duplicates(docs).where(~F.col("kept")).select(F.col("id").alias("doc_id"))
    return without(docs, gone, "doc_id").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; each row by its own text, ids may be null or repeated."""
    gone = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key = free_name(docs, "_row_key")
    return without(docs.withColumn(key, decontam.row_key()), gone.withColumnRenamed("_row_key", key), key).select(*(F.col(f"`{c}`") for c in docs.columns))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, lang, source, ids, n_tokens``."""
    done = pieces.encode_documents(docs.select("doc_id", "lang", "source", "text"), pieces.load_model(model_path))
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", tokenization),
]

#: No SQL can tell languages by the trained model or encode pieces; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
