"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to ``ORDERS`` code points of the lower-cased
text, letters and single spaces only) of labelled rows into 2**``BITS``
buckets for each language, on the executors, with a partial sum in each task;
only the counts, at most ``MAX_LANGUAGES`` * 2**``BITS``, reach the driver and
become a matrix of log probabilities that is broadcast (at most 32 MB, checked
by ``MAX_LANGUAGES``) with the classes' prior. Scoring gathers a batch's sparse
buckets in numpy; a text longer than a slice is counted window by window.

The training sample is bounded: at most about ``max_rows`` labelled rows, an
equal number for each language where there are more (a documented bound of the
fit; every row is scored). Whole texts are used in training and in scoring.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text if there is no labelled row to learn from. Ties go to the
language that sorts first. A repeated row gets the same answer each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .memory import give_back, in_arrow, small_batches

BITS, ORDERS, MAX_LANGUAGES = 15, 3, 250
SLICE_CHARS = 1 << 19
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHERS = regex.compile(r"[^\p{L}\p{M}]+")


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place; the last order - 1 places have none."""
    h = np.full(len(codes) - order + 1, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for i in range(order):
        h = (h ^ codes[i : len(codes) - order + 1 + i]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def _plain(text: str | None) -> str:
    """Letters in lower case, with one space around each run of them; nothing if there is no letter."""
    return " " + _OTHERS.sub(" ", text).strip().lower() + " " if text and _LETTER.search(text) else ""


def _prepared(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of texts: first row, row after the last, code points, each text's end. A longer text is a slice of its own."""
    low = 0
    while low < len(texts):
        plain, size = [], 0
        for t in islice(texts, low, None):
            if plain and size + len(t or "") > most:
                break
            plain.append(_plain(t))
            size += len(plain[-1])
        codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield low, low + len(plain), codes, np.cumsum([len(t) for t in plain])
        low += len(plain)


def _grams(codes: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): text i has buckets bounds[i] to bounds[i + 1]; no n-gram crosses texts."""
    if len(codes) < order:
        return np.zeros(0, np.int64), np.zeros(len(ends) + 1, np.int64)
    found = _buckets(codes, order)
    begins = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(ends - begins - order + 1, 0)
    keep = np.ones(len(found), dtype=bool)
    for back in range(1, order):
        at = ends - back
        keep[at[(at >= begins) & (at < len(found))]] = False
    return found[keep], np.concatenate([[0], np.cumsum(counts)])


def _counted(codes: np.ndarray, order: int) -> np.ndarray:
    """How often each bucket occurs in one text, window by window."""
    out = np.zeros(1 << BITS, dtype=np.int64)
    for low in range(0, len(codes) - order + 1, SLICE_CHARS):
        out += np.bincount(_buckets(codes[low : low + SLICE_CHARS + order - 1], order), minlength=1 << BITS)
    return out


@dataclass(frozen=True)
class Fit:
    """What was learnt: languages, ``[bucket, language]`` log probabilities and log priors."""

    langs: list[str]
    logs: np.ndarray
    prior: np.ndarray

    @property
    def slice_chars(self) -> int:
        """Characters scored at once: as many as keep the gathered rows of ``logs`` small."""
        return min(SLICE_CHARS, (1 << 22) // max(1, len(self.langs)))

    def scores(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log posteriors up to a constant, number of n-grams) of each text of a slice."""
        total, grams = np.tile(self.prior, (len(ends), 1)), np.zeros(len(ends))
        for order in range(1, ORDERS + 1):
            if len(ends) == 1 and len(codes) > self.slice_chars:
                counts = _counted(codes, order)
                total[0] += counts @ self.logs.astype(np.float64)
                grams += counts.sum()
                continue
            found, bounds = _grams(codes, ends, order)
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                total[some] += np.add.reduceat(self.logs[found], bounds[some], axis=0, dtype=np.float64)
                grams += np.diff(bounds)
        return total, grams


def train(docs: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = 20_000) -> Fit:
    """Fitted on rows with text and label.

    The prior is each language's share of all rows with a label. N-grams are
    counted in at most about ``max_rows`` rows, an equal number for each
    language as far as it has as many, taken by the hash of the id. A language
    without n-grams in them is not learnt.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null")
    rows_of = {r.label: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(rows_of) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs, size = sorted(rows_of), 1 << BITS
    if not langs:
        return Fit([], np.zeros((size, 0), np.float32), np.zeros(0))
    # rows of a language up to this many of a million are taken
    part = {x: min(1_000_000, 1_000_000 * max_rows // (len(langs) * rows_of[x]) + 1) for x in langs}
    table = F.create_map(*(F.lit(v) for i, x in enumerate(langs) for v in (x, i)))
    parts = F.array(*(F.lit(part[x]) for x in langs))
    rows = rows.where("text is not null").withColumn("at", table[F.col("label")])
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.get(parts, F.col("at")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high, codes, ends in _prepared(texts):
                begins = np.concatenate([[0], ends[:-1]])
                for i in range(high - low):
                    for order in range(1, ORDERS + 1):
                        if ends[i] - begins[i] >= order:
                            at = sums.setdefault(labels[low + i], np.zeros(size, np.int64))
                            at += _counted(codes[begins[i] : ends[i]], order)
        for label, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), label)), pa.array(some), pa.array(n[some])], names=["label", "bucket", "n"])

    counts = np.zeros((size, len(langs)))
    found = in_arrow(rows.select("text", "at"), count, "label long, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("bucket").to_numpy(), found.column("label").to_numpy()] = found.column("n").to_numpy()
    seen = np.flatnonzero(counts.any(axis=0))
    counts = counts[:, seen] + 0.5
    known = np.array([rows_of[langs[i]] for i in seen], dtype=np.float64)
    return Fit([langs[i] for i in seen], np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(known / known.sum()))


def predictor(fit: Fit, spark):
    """A pandas UDF text -> struct<lang string, score double>."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            out_lang, out_score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for low, _, codes, ends in _prepared(texts, known.slice_chars) if known.langs else ():
                total, grams = known.scores(codes, ends)
                total -= total.max(axis=1, keepdims=True)
                share = np.exp(total)
                share /= share.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                for i in np.flatnonzero(grams):
                    out_lang[low + i], out_score[low + i] = known.langs[best[i]], share[i, best[i]]
            yield pd.DataFrame({"lang": out_lang, "score": out_score}, index=batch.index)
        give_back()

    return predict


def held_out(id_col: str) -> Column:
    """Rows that are never learnt from: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows: int = 20_000, out_col: str = "_language") -> DataFrame:
    """``docs`` with a struct (lang, score) in ``out_col``, learnt from its own labelled rows that are not held out."""
    fit = train(docs.where(~held_out(id_col)), id_col, text_col, label_col, max_rows)
    return docs.withColumn(out_col, predictor(fit, docs.sparkSession)(F.col(f"`{text_col}`").cast("string")))
