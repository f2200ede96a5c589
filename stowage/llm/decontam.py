r"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words (all its words if it has
fewer). Containment needs every word of a window, so its rarest word is a
sufficient prefix: words are ordered by their frequency over all documents,
and a window is posted under its rarest word alone, with that word's place in
it. A document's words are joined to the postings; the place gives the only
start a window can have there, which must lie within the document, as must its
end (positional and length bounds); the window is then compared word by word.

Documents stay where they are: up to ``INDEX_TEXT_BYTES`` of items, checked
before they are sent out, are an index of arrays on each executor. For a larger
benchmark frequencies and postings are tables joined by Spark, and whatever its
size the documents are read twice: for the frequencies of words, which are
counted over all of them, and for the windows.

Words are runs of ASCII letters and digits and of all other than ASCII
characters, with A-Z lower-cased. They are compared by 64-bit hashes of their
bytes, a window by those of all its words.

Defined results: null texts have no words; items without words or with a null
id take no part; items that repeat an id are one item with the windows of all;
each row of the documents gets its own result, repeated or not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .memory import in_arrow
from .shared import materialize
from .words import ALNUM, Words, chain, words_of

WINDOW = 10
#: Bytes of items that one index holds (it takes 25 times as many at most), and prefixes that are sent out for a larger benchmark (16 bytes each).
INDEX_TEXT_BYTES, PREFIXES = 4 << 20, 2_000_000
_PAIRS = 1 << 20


def _window_hashes(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of all words of each window of ``flat``."""
    out = np.empty(len(starts), dtype=np.uint64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[at] = chain(*(flat[starts[at] + i] for i in range(n)))
    return out


def _windows(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the windows of texts whose words are bounds[i] to bounds[i + 1]."""
    words = np.diff(bounds)
    counts = np.where(words > 0, np.maximum(1, words - size + 1), 0)
    text = np.repeat(np.arange(len(words)), counts)
    start = bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, start, np.minimum(words, size)[text]


class Index:
    """Windows of some items, posted under their rarest word; at most about 50 bytes for each word of the items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], size: int = WINDOW):
        self.size = size
        self.flat = np.concatenate([*(w for _, w in items), np.zeros(0, np.uint64)])
        bounds = np.concatenate([[0], np.cumsum([len(w) for _, w in items])]).astype(np.int64)
        self.items, number = np.unique(np.array([i for i, _ in items], dtype=object).astype(str), return_inverse=True)
        text, starts, lengths = _windows(bounds, size)
        _, first, same = np.unique(_window_hashes(self.flat, starts, lengths), return_index=True, return_inverse=True)
        self.starts, self.lengths = starts[first].astype(np.int32), lengths[first].astype(np.int8)
        held = np.unique(same.astype(np.int64) * (len(self.items) + 1) + number[text] if len(text) else np.zeros(0, np.int64))
        self.holders = (held % (len(self.items) + 1)).astype(np.int32)
        self.held = np.searchsorted(held // (len(self.items) + 1), np.arange(len(first) + 1)).astype(np.int32)
        self.vocabulary = np.unique(self.flat)

    def words(self, window: np.ndarray, i: int) -> np.ndarray:
        """The i-th word of windows that have as many."""
        return self.flat[self.starts[window] + i]

    def post(self, frequency: np.ndarray) -> None:
        """Choose each window's prefix by the frequency of each word of ``vocabulary``."""
        n = len(self.starts)
        rank = np.argsort(np.argsort(frequency, kind="stable"), kind="stable")[np.searchsorted(self.vocabulary, self.flat)] if len(frequency) else frequency
        best, self.place = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int8)
        for i in range(self.size):
            some = np.flatnonzero(self.lengths > i)
            some = some[rank[self.starts[some] + i] < best[some]]
            best[some], self.place[some] = rank[self.starts[some] + i], i
        prefix = self.flat[self.starts + self.place] if n else np.zeros(0, np.uint64)
        self.posted = np.argsort(prefix, kind="stable").astype(np.int32)
        self.prefixes, self.first = np.unique(prefix[self.posted], return_index=True)
        self.count = np.diff(np.append(self.first, n))

    def occurrences(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, place of its first word) of every occurrence in some rows."""
        if not len(self.prefixes) or not len(words.hashes):
            return
        at = np.minimum(np.searchsorted(self.prefixes, words.hashes), len(self.prefixes) - 1)
        places = np.flatnonzero(self.prefixes[at] == words.hashes)
        if not len(places):
            return
        counts = self.count[at[places]]
        row = np.searchsorted(words.rows, places, side="right") - 1
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(counts) // _PAIRS)) + 1).tolist(), len(places)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            p, c = places[low:high], counts[low:high]
            posting = np.repeat(self.first[at[p]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            window = self.posted[posting]
            start = np.repeat(p, c) - self.place[window].astype(np.int64)
            doc = np.repeat(row[low:high], c)
            fits = (start >= words.rows[doc]) & (start + self.lengths[window] <= words.rows[doc + 1])
            window, start = window[fits], start[fits]
            for i in range(self.size):
                same = self.lengths[window] <= i
                longer = np.flatnonzero(~same)
                same[longer] = words.hashes[start[longer] + i] == self.words(window[longer], i)
                window, start = window[same], start[same]
            yield window, start


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` of the items that have an id."""
    return benchmark.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).where("id is not null")


def _index(items: DataFrame, size: int) -> Index | None:
    """The index of all items; None if they are larger than ``INDEX_TEXT_BYTES``."""
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    if total > INDEX_TEXT_BYTES:
        return None
    whole = items.toArrow()
    ids = whole.column("id").to_pylist()
    return Index([(ids[low + k], w.hashes[w.rows[k] : w.rows[k + 1]]) for low, w in words_of(whole.column("text"), ALNUM) for k in range(len(w))], size)


def _frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """Occurrences of each word of the vocabulary in all documents."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = vocabulary.value, np.zeros(len(vocabulary.value), dtype=np.int64)
        for batch in batches:
            for _, words in words_of(batch.column(0), ALNUM):
                at = np.minimum(np.searchsorted(known, words.hashes), max(0, len(known) - 1))
                sums += np.bincount(at[known[at] == words.hashes], minlength=len(known))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["word", "n"])

    out = np.zeros(len(index.vocabulary), dtype=np.int64)
    if len(out):
        found = in_arrow(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        out[found.word.to_numpy()] = found.n.to_numpy()
    return out


def _spans(docs: DataFrame, index: Index) -> DataFrame:
    """``id, digest, n_words, hits, items``: hits are [first word, word after the last] of merged occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for low, words in words_of(batch.column(2), ALNUM):
                n = len(words)
                hits: list[list[list[int]]] = [[] for _ in range(n)]
                items: list[set[int]] = [set() for _ in range(n)]
                found = list(known.occurrences(words))
                if found:
                    window, start = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.lexsort((start + known.lengths[window], start))
                    window, start = window[order], start[order]
                    doc = np.searchsorted(words.rows, start, side="right") - 1
                    for d, w, s in zip(doc.tolist(), window.tolist(), (start - words.rows[doc]).tolist(), strict=True):
                        items[d].update(known.holders[known.held[w] : known.held[w + 1]].tolist())
                        end = s + int(known.lengths[w])
                        if hits[d] and s <= hits[d][-1][1]:
                            hits[d][-1][1] = max(end, hits[d][-1][1])
                        else:
                            hits[d].append([s, end])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, n),
                        batch.column(1).slice(low, n),
                        pa.array(np.diff(words.rows)),
                        pa.array(hits, type=pa.list_(pa.list_(pa.int64()))),
                        pa.array([known.items[sorted(x)].tolist() for x in items], type=pa.list_(pa.string())),
                    ],
                    names=["id", "digest", "n_words", "hits", "items"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    docs = docs.select("id", F.xxhash64("text").alias("digest"), "text")
    return in_arrow(docs, run, f"id {kind}, digest long, n_words long, hits array<array<long>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_words, hits, items``.

    ``hits`` are the merged spans of words (end exclusive) that lie in an
    occurrence of a window, ``items`` the sorted ids (as strings) of the items
    with an occurring window.
    """
    return _contamination(docs, benchmark, id_col, text_col, item_col, item_text_col, window).drop("digest")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows of different results apart: id, which may be null, and a digest of the text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row_key``: the :func:`row_key` of each row of ``docs`` that holds a window."""
    found = _contamination(docs, benchmark, id_col, text_col, "item_id", "text", WINDOW)
    return found.where(F.size("hits") > 0).select(F.struct("id", "digest").alias("_row_key"))


def _contamination(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int) -> DataFrame:
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = _items(benchmark, item_col, item_text_col)
    index = _index(items, window)
    if index is None:
        return _joined(docs, items, window)
    index.post(_frequencies(docs, index))
    return _spans(docs, index)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n`` of the words of each slice."""
    for batch in batches:
        for _, words in words_of(batch.column(0), ALNUM):
            word, n = np.unique(words.hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([_long(word), _long(n)], names=["word", "n"])


def _item_windows(size: int):
    """``id, window, length, words`` of the windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words in words_of(batch.column(1), ALNUM):
                text, start, length = _windows(words.rows, size)
                spelt = [words.hashes[s : s + n].view(np.int64) for s, n in zip(start.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).take(_long(low + text)), _long(_window_hashes(words.hashes, start, length)), _long(length), pa.array(spelt, type=pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "window", "length", "words"])

    return run


def _bit(length, place):
    """Bit of a window's length and of its prefix's place in it."""
    return length * (length - 1) / 2 + place


def _candidates(kind: str, size: int, prefixes, every: int):
    """Each document with the hashes of the windows that a prefix in it makes possible; ``prefixes``: a broadcast (words, bits), or None where any word may be one of ``every`` kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = prefixes.value if prefixes else (None, None)
        for batch in batches:
            for low, words in words_of(batch.column(3), ALNUM):
                n = len(words)
                if known is None:
                    place_of, mask = np.arange(len(words.hashes)), np.full(len(words.hashes), every)
                elif len(known):
                    at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
                    place_of = np.flatnonzero(known[at] == words.hashes)
                    mask = bits[at[place_of]]
                else:
                    place_of, mask = np.zeros(0, np.int64), np.zeros(0, np.int64)
                row = np.searchsorted(words.rows, place_of, side="right") - 1
                found = []
                for length in range(1, size + 1):
                    for place in range(length):
                        some = np.flatnonzero(mask >> int(_bit(length, place)) & 1)
                        start = place_of[some] - place
                        fits = (start >= words.rows[row[some]]) & (start + length <= words.rows[row[some] + 1])
                        found.append((row[some][fits], start[fits], np.full(int(fits.sum()), length)))
                doc, start, length = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((length, start, doc))
                doc, start, length = doc[order], start[order], length[order]
                window = _window_hashes(words.hashes, start, length)
                start = start - words.rows[doc]
                spans = pa.StructArray.from_arrays([_long(start), _long(length), _long(window)], names=["start", "length", "window"])
                ends = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                columns = [*(batch.column(k).slice(low, n) for k in range(3)), _long(np.diff(words.rows)), pa.ListArray.from_arrays(ends, spans)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "other", "n_words", "spans"])

    return run


def _joined(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """The same for a benchmark of any size: frequencies and postings are tables, and the documents are read twice.

    Every step is a join or an aggregate. Only the prefixes with their places
    are sent to the executors, and only up to ``PREFIXES`` of them; beyond, any
    word of a document counts as one. Texts are known by two 64-bit hashes.
    """
    spark = docs.sparkSession
    held = in_arrow(items, _item_windows(size), "id string, window long, length long, words array<long>")
    held = materialize(held.groupBy("id", "window").agg(F.min("length").alias("length"), F.min("words").alias("words")), "windows")
    once = held.groupBy("window").agg(F.min("length").alias("length"), F.min("words").alias("words"))
    spelt = materialize(once.select("window", "length", F.posexplode("words").alias("place", "word")), "spelt")
    counts = in_arrow(docs.select("text"), _counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = spelt.select("word").distinct().join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    # the rarest word of each window, the first one of equally rare ones
    posted = spelt.join(counts, "word").groupBy("window").agg(F.min(F.struct("n", "word", "place", "length")).alias("p"))
    posted = materialize(posted.select("window", "p.word", "p.place", "p.length"), "postings")
    bit = F.expr("shiftleft(1L, cast(length * (length - 1) / 2 + place as int))")
    kinds = materialize(posted.groupBy("word").agg(F.bit_or(bit).alias("bits")), "prefixes")
    shared, every = None, 0
    if kinds.limit(PREFIXES + 1).count() <= PREFIXES:
        told = kinds.toArrow()
        known, bits = told.column("word").to_numpy().astype(np.int64).view(np.uint64), told.column("bits").to_numpy().astype(np.int64)
        order = np.argsort(known)
        shared = spark.sparkContext.broadcast((known[order], bits[order]))
    else:
        every = kinds.agg(F.bit_or("bits")).first()[0]
    kind = docs.schema["id"].dataType.simpleString()
    told = docs.select("id", F.xxhash64("text").alias("digest"), F.xxhash64(F.lit(1), "text").alias("other"), "text")
    found = in_arrow(told, _candidates(kind, size, shared, every), f"id {kind}, digest long, other long, n_words long, spans array<struct<start:long,length:long,window:long>>")
    found = materialize(found, "candidates")
    key = ["digest", "other"]
    spans = found.where(F.size("spans") > 0).select(*key, F.explode("spans").alias("s")).select(*key, "s.*")
    hits = spans.join(posted.select("window"), "window").groupBy(*key, "start", "length", "window").agg(F.lit(1).alias("x")).drop("x")
    hits = materialize(hits, "hits")
    where = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.array(F.col("start"), F.col("start") + F.col("length")))).alias("hits"))
    names = hits.select(*key, "window").distinct().join(held.select("window", F.col("id").alias("item")), "window").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    where = where.withColumn("hits", _united(F.col("hits")))
    both = where.join(names, key)
    none = F.array().cast("array<array<bigint>>")
    return found.drop("spans").join(both, key, "left").select("id", "digest", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _united(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap as one."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when((F.size(acc) > 0) & (s[0] <= F.try_element_at(acc, F.lit(-1))[1]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<array<bigint>>"), step)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
