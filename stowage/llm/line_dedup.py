r"""Line deduplication with a fixed-depth tree of line templates.

Every line (cut at ``\n``) walks a tree of fixed depth: first by its number of
tokens, then by its ``DEPTH`` leading tokens, where a token with a digit
counts as a variable field from the start. In a leaf, a token that fewer than
``min_docs`` of the leaf's documents have at its place is a variable field
too. A line's template is its tokens with the variable fields generalised;
templates that ``min_docs`` documents share are recurring, if no more than
``1 - fixed_share`` of their fields are variable. Of a recurring template the
first line (smallest id, then digest and place in the text) stays, all others go.
Lines of at least ``long_tokens`` tokens recur from two documents on. In
scripts without spaces a line is one token or few, so where lines are equal
two Chinese or Japanese characters, or four Thai, Lao, Burmese or Khmer ones,
are as long as a token.

Lines alike in all but their variable fields recur too, if at least
``alike_share`` of their tokens have no digit; lines with fewer such tokens
(rows of tables, lists of numbers) recur only where all tokens are equal. The
default of 0 takes all of them as alike, and lines of fewer than three tokens
stay by default; :data:`WHOLE` asks for the share of a template, counts all
lines with a token, and is what op5_line_dedup and the pipeline use. Lines of
up to ``DEPTH`` tokens are alone in their leaf, so they recur as they are.

Scale: the tree is two keys of 64 bits made on the executors, so that only
(id, place, keys) of each line are counted and joined; the tokens of lines
are looked at only in leaves that several documents share and that hold lines
which no other document has alike, and leaves are counted per distinct line,
so a line that a third of all documents hold is one row there. All counts are
partial aggregates over all documents.

Defined results: lines of fewer than ``min_tokens`` tokens and blank lines
always stay; a null text stays null and has no lines, an empty text has one.
Rows that repeat an id are one document: a line that only they share does not
recur. Each row loses the lines of its own text; rows of equal id and text
lose the same ones. Rows with a null id keep all their lines and do not count.
Other columns are kept as they are; one with the name of the count is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .memory import in_arrow
from .shared import free_name, light, materialize
from .words import NOT_SPACE, Words, chain, mix, slices, string_bytes

DEPTH = 3
#: Options of op5_line_dedup and the pipeline.
WHOLE = {"alike_share": 0.8, "min_tokens": 1}
_VARIABLE = np.uint64(0xA24BAED4963EE407)
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
#: Quarters of a token by the first byte of a character: U+3000 to U+9FFF; by the first two: Thai, Lao, Burmese, Khmer.
_WIDE = np.zeros(256, dtype=np.int64)
_WIDE[0xE3:0xEA] = 2
_PAIRS = [(0xE0, (0xB8, 0xB9, 0xBA, 0xBB)), (0xE1, (0x80, 0x81, 0x9E, 0x9F))]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


class Lines:
    """Lines of some texts and their tokens, with digits generalised."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        # a line starts at each text's start and after each line end
        self.begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.rows = np.searchsorted(breaks, offsets) + np.arange(len(offsets))  # lines of text i: rows[i] to rows[i + 1]
        # a line end at a text's end leaves an empty line that belongs to it, before the next text's first
        words = Words(data, offsets, NOT_SPACE)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        variable = digits[words.ends] > digits[words.starts]
        self.tokens = np.where(variable, _VARIABLE, words.hashes)
        self.raw = words.hashes
        self.variable = np.concatenate([[0], np.cumsum(variable)])
        self.data = data
        n = len(self.begins)
        if n:
            self.first = np.searchsorted(words.starts, self.begins)
            self.counts = np.diff(np.append(self.first, len(self.tokens)))
        else:
            self.first = self.counts = np.zeros(0, np.int64)

    def leaves(self) -> np.ndarray:
        columns = [self.counts.astype(np.uint64)]
        padded = np.append(self.tokens, np.zeros(DEPTH, np.uint64))
        for i in range(DEPTH):
            columns.append(np.where(self.counts > i, padded[np.minimum(self.first + i, len(padded) - 1)], np.uint64(0)))
        return chain(*columns)

    def fixed(self) -> np.ndarray:
        """Tokens without a digit of each line."""
        return self.counts - (self.variable[self.first + self.counts] - self.variable[self.first])

    def lengths(self) -> np.ndarray:
        """Tokens of each line, and what its characters of scripts without spaces are as long as."""
        wide = _WIDE[self.data]
        for lead, follow in _PAIRS:
            at = np.flatnonzero(self.data[:-1] == lead)
            wide[at] += np.isin(self.data[at + 1], follow)
        if not wide.any():
            return self.counts
        sums = np.concatenate([[0], np.cumsum(wide)])
        return self.counts + np.diff(sums[np.append(self.begins, len(self.data))]) // 4

    def lines(self, tokens: np.ndarray) -> np.ndarray:
        """Hash of each line's ``tokens`` in order."""
        place = np.arange(len(tokens)) - np.repeat(self.first, self.counts)
        each = mix(tokens ^ mix(place.astype(np.uint64) + np.uint64(1)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        return chain(sums[self.first + self.counts] - sums[self.first], self.counts.astype(np.uint64))


def _keys(min_tokens: int, long_tokens: int, alike_share: float):
    """A row for each line that can be dropped: id, digest of the text, place, tokens, leaf, line, whether it is long, and ``same``, the hash of its tokens as they are, if only equal lines are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for low, high in slices(offsets):
                found = Lines(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                row = np.repeat(np.arange(low, high), np.diff(found.rows))
                place = np.arange(len(row)) - np.repeat(found.rows[:-1], np.diff(found.rows))
                some = np.flatnonzero(found.counts >= min_tokens)
                alike = found.fixed()[some] >= found.counts[some] * alike_share
                same = pa.array(found.lines(found.raw)[some].view(np.int64), mask=alike)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(pa.array(row[some])) for k in (0, 2)), _long(place[some]), _long(found.counts[some]), _long(found.leaves()[some]), _long(found.lines(found.tokens)[some]), pa.array(found.lengths()[some] >= long_tokens), same],
                    names=["id", "digest", "place", "tokens", "leaf", "line", "long", "same"],
                )

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token hashes of the lines at ``places`` of each text."""
    for batch in batches:
        data, offsets = string_bytes(batch.column(1))
        places = batch.column(3).to_pylist()
        for low, high in slices(offsets):
            found = Lines(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            row = [i for i in range(low, high) for _ in places[i]]
            place = [p for i in range(low, high) for p in places[i]]
            at = [found.rows[i - low] + p for i in range(low, high) for p in places[i]]
            tokens = [found.tokens[found.first[k] : found.first[k] + found.counts[k]].view(np.int64) for k in at]
            ids = [batch.column(k).take(pa.array(row, type=pa.int64())) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(place, type=pa.int64()), pa.array(tokens, type=pa.list_(pa.int64()))], names=["id", "digest", "place", "words"])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_tokens: int = 3, long_tokens: int = 20, fixed_share: float = 0.8, alike_share: float = 0.0) -> DataFrame:
    """``id, digest, places``: the places (from 0) of the lines to drop, for texts (an id and the text's ``xxhash64``) that lose some."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and text is not null")
    docs = docs.withColumn("digest", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    lines = materialize(in_arrow(docs, _keys(min_tokens, long_tokens, alike_share), f"id {kind}, digest long, place long, tokens long, leaf long, line long, long boolean, same long"), "lines")
    needed = F.when(F.col("tokens") >= long_tokens, 2).otherwise(min_docs)
    needed_equal = F.when(F.col("long"), 2).otherwise(min_docs)

    # documents and the first line of each distinct line; a document's lines come together first
    each = lines.groupBy("line", "id").agg(F.min(F.struct("digest", "place")).alias("at"), F.max("tokens").alias("tokens"), F.max("leaf").alias("leaf"), F.bool_and(F.col("same").isNull()).alias("alike"), F.bool_or("long").alias("long"))
    alike = each.groupBy("line").agg(F.count("*").alias("docs"), F.min(F.struct("id", "at.digest", "at.place")).alias("first"), F.max("tokens").alias("tokens"), F.max("leaf").alias("leaf"), F.bool_and("alike").alias("alike"), F.bool_or("long").alias("long"))
    alike = materialize(alike, "alike")
    exact = alike.where(F.col("alike") & (F.col("docs") >= needed_equal)).select("line", "first")
    # of the others, those that are equal
    equal = lines.where("same is not null").groupBy("same", "id").agg(F.min(F.struct("digest", "place")).alias("at"), F.bool_or("long").alias("long"))
    equal = equal.groupBy("same").agg(F.count("*").alias("docs"), F.min(F.struct("id", "at.digest", "at.place")).alias("first"), F.bool_or("long").alias("long"))
    equal = equal.where(F.col("docs") >= needed_equal).select(F.col("same").alias("line"), "first")
    # leaves with several lines, some of which no other documents have: these may have variable fields
    leaves = alike.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs"), F.min("docs").alias("least"), F.max("tokens").alias("tokens"))
    leaves = leaves.where((F.col("lines") > 1) & (F.col("docs") >= needed) & (F.col("least") < needed)).select("leaf")
    heads = materialize(alike.join(leaves, "leaf", "left_semi"), "open")
    wanted = heads.groupBy(F.col("first.id").alias("id"), F.col("first.digest").alias("digest")).agg(F.collect_set("first.place").alias("places"))
    words = in_arrow(docs.join(wanted.hint("merge"), ["id", "digest"]).select("id", "text", "digest", "places"), _tokens, f"id {kind}, digest long, place long, words array<long>").dropDuplicates(["id", "digest", "place"])
    told = heads.select("first.*", "leaf", "line", "docs", "tokens").join(words, ["id", "digest", "place"])
    told = materialize(told, "told")
    fields = told.select("leaf", "line", "docs", "tokens", F.posexplode("words").alias("at", "word")).where(F.col("word") != F.lit(int(_VARIABLE.astype(np.int64))))
    fields = fields.select("line", "docs", "tokens", F.xxhash64("leaf", "at", "word").alias("field"))
    common = fields.groupBy("field").agg(F.sum("docs").alias("docs"), F.max("tokens").alias("tokens")).where(F.col("docs") >= needed).select("field")
    # a line's fixed fields together are its template
    fixed = fields.select("field", "line").join(common, "field").groupBy("line").agg(F.count("*").alias("fixed"), F.bit_xor("field").alias("x"), F.sum(F.col("field") % (1 << 40)).alias("y"))
    fixed = fixed.join(told.select("line", "leaf", "tokens"), "line").where(F.col("fixed") >= F.col("tokens") * fixed_share)
    fixed = materialize(fixed.select("line", "leaf", "x", "y"), "fixed")
    holders = lines.select("line", "id", "tokens").join(light(fixed), "line").select("leaf", "x", "y", "id", "tokens").distinct()
    templates = holders.groupBy("leaf", "x", "y").agg(F.count("*").alias("docs"), F.max("tokens").alias("tokens")).where(F.col("docs") >= needed).select("leaf", "x", "y")
    generalised = fixed.join(templates, ["leaf", "x", "y"]).select("line", "leaf", "x", "y")
    # lines alike in fixed fields share the first line of their template
    first = told.select("line", F.struct("id", "digest", "place").alias("first")).join(generalised, "line").groupBy("leaf", "x", "y").agg(F.min("first").alias("first"))
    general = generalised.join(first, ["leaf", "x", "y"]).select("line", "first")
    recurring = light(materialize(exact.union(equal).union(general).groupBy("line").agg(F.min("first").alias("first")), "recurring"))
    gone = lines.select("id", "digest", "place", F.coalesce("same", "line").alias("line")).join(recurring, "line").where(F.struct("id", "digest", "place") != F.col("first"))
    return gone.groupBy("id", "digest").agg(F.collect_set("place").alias("places"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "lines_dropped", **options) -> DataFrame:
    """``docs`` with ``text_col`` without recurring lines and their number in ``count_col`` (long, null for a null text)."""
    text = F.col(f"`{text_col}`").cast("string")
    id_, digest, places = (free_name(docs, x) for x in ("_id", "_digest", "_places"))
    gone = dropped_lines(docs, id_col, text_col, **options).select(F.col("id").alias(id_), F.col("digest").alias(digest), F.col("places").alias(places))
    names = [c for c in docs.columns if c != count_col]
    joined = docs.select(*(F.col(f"`{c}`") for c in names)).join(gone.hint("merge"), (F.col(f"`{id_col}`") == F.col(id_)) & (F.xxhash64(text) == F.col(digest)), "left")
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(F.split(text, "\n")).cast("long") - 1), places)
    kept = F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i.cast("int"))), "\n"))[0]
    out = F.when(F.col(places).isNull(), F.col(f"`{text_col}`")).otherwise(kept)
    n = F.when(text.isNotNull(), F.coalesce(F.size(places), F.lit(0)).cast("long"))
    return joined.select(*(out.alias(c) if c == text_col else F.col(f"`{c}`") for c in names), n.alias(count_col))
