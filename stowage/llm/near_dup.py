r"""MinHash near-duplicates by fast similarity sketching.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round ``i`` every shingle is
thrown into one of ``t`` bins with the value (round, random); a bin keeps its
smallest value. The first ``t`` rounds choose bins at random, the next ``t``
use bin ``i - t``, so every bin is filled, and the share of equal bins of two
sketches estimates the Jaccard similarity with concentration bounds like those
of independent draws. Runs of bins make band keys; documents with a key in
common are candidates; every link is confirmed on the full shingle sets.

Scale: documents with equal sets collapse into a class first, then only
classes are compared, and a bucket never emits all its pairs. A class's private
shingles (held by no other class that has a bucket in common with any) bound
its similarity with every other class exactly. Each class is first compared
with the hub of its buckets that has the smallest share of private shingles:
where copies differ from one original by edits of their own, whatever links
them to each other links them to that hub. Links are contracted to components;
then members outside a bucket's largest component are compared with the rest
of it, as far as exact bounds leave a link possible: two members have no more
in common than their shingles that are not private, and, if they have the same
hub, no more than the smaller of their intersections with it and the smaller
of their other shingles that are not private. The first bound is part of the
join, as a range of sizes in steps, so that pairs it rules out are not made. So
no link between components is lost. Those pairs pass a filter on the sketches
before texts are read: a pair at the threshold fails it with probability below
1e-7. All steps are joins and partial aggregates; nothing of the corpus reaches
the driver, and a text that many are compared with is dealt out in copies.

Defined results: a null, empty or blank text has an empty set (0 shingles), is
linked with nothing and is its own component. A text of fewer than ``words``
words is one shingle of all of them. Rows that repeat an id are one document;
if their texts differ, the one with the smallest (n_shingles, digest) counts.
Rows with a null id take no part and are not returned. Other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .memory import in_arrow
from .shared import among, materialize
from .words import NOT_SPACE, chain, mix, shingles, words_of

#: Bins of a sketch: BANDS keys of ROWS bins each. A pair of similarity 0.85
#: shares no key with probability (1 - 0.85**6)**36 < 4e-8, of 0.8 with 1.7e-5.
ROWS, BANDS = 6, 36
#: Pairs of texts that are verified at once, and pairs of one text before it is dealt out in copies.
PAIRS, HUB_PAIRS = 64, 256
#: Sizes of sets are told apart in steps of this ratio where pairs are joined.
SIZE_STEP = 1.05


def sketch(values: np.ndarray, rows: np.ndarray, count: int, bins: int = ROWS * BANDS) -> np.ndarray:
    """``count`` x ``bins`` sketch; ``values[j]`` is an element of set ``rows[j]``.

    A set without elements keeps the largest value in every bin.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(count * bins, top, dtype=np.uint64)
    base = rows.astype(np.int64) * bins
    for i in range(2 * bins):
        if not len(values):
            break
        h = mix(values + np.uint64((0xD6E8FEB86659FD93 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = base + ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64) if i < bins else base + (i - bins)
        np.minimum.at(out, at, (np.uint64(i) << np.uint64(48)) | (h & np.uint64(0xFFFFFFFFFFFF)))
        open_sets = (out.reshape(count, bins) == top).any(axis=1)
        keep = open_sets[rows]
        if not keep.all():
            values, rows, base = values[keep], rows[keep], base[keep]
    return out.reshape(count, bins)


def band_keys(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, bins = sketches.shape
    bands = sketches.reshape(n, bins // rows, rows)
    number = np.arange(bins // rows, dtype=np.uint64)[None, :].repeat(n, axis=0)
    return chain(number.ravel(), *(bands[:, :, i].ravel() for i in range(rows))).reshape(n, -1)


def least_bins(percent: int, bins: int = ROWS * BANDS) -> int:
    """Bins in which sketches of a pair at the threshold agree, but for a probability below 1e-7 (5.5 standard deviations)."""
    share = percent / 100
    return max(0, int(bins * share - 5.5 * (bins * share * (1 - share)) ** 0.5))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found in words_of(batch.column(1), NOT_SPACE):
                sets = [shingles(found, i, words) for i in range(len(found))]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                out = sketch(flat, np.repeat(np.arange(len(sets)), sizes), len(sets))
                keys = band_keys(out)

                def total(x: np.ndarray) -> np.ndarray:
                    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                    return s[ends[1:]] - s[ends[:-1]]

                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(low, len(sets)) for k in (0, 2)),
                        pa.array(sizes),
                        _long(total(mix(flat + np.uint64(1)))),
                        _long(total(mix(flat ^ np.uint64(0x5851F42D4C957F2D)))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), _long(keys.ravel())),
                        pa.array([x.tobytes() for x in (out & np.uint64(0xFF)).astype(np.uint8)], type=pa.binary()),
                    ],
                    names=["id", "row", "n", "d1", "d2", "bands", "sig"],
                )

    return run


def _exploded(words: int):
    """A row for each shingle of each text: id, h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found in words_of(batch.column(1), NOT_SPACE):
                sets = [shingles(found, i, words) for i in range(len(found))]
                rows = np.repeat(np.arange(low, low + len(sets)), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _long(np.concatenate([*sets, np.zeros(0, np.uint64)]))], names=["id", "h"])

    return run


def _agree(least: int):
    """Pairs whose sketches agree in at least ``least`` bins (by one byte of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            keep = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _verify(words: int):
    """Pairs of texts with the sizes of their full sets and of the intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(low, PAIRS)
                x, y = ([shingles(found, i, words) for _, found in words_of(batch.column(c), NOT_SPACE) for i in range(len(found))] for c in ("text_a", "text_b"))
                both = [len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y, strict=True)]
                sizes = [[len(u) for u in x], [len(v) for v in y], both]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(k, type=pa.int64()) for k in sizes)], names=["a", "b", "n_a", "n_b", "both"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per id: ``id, n_shingles, component_id, kept``.

    ``words`` words make a shingle; documents are linked if 100 * intersection
    >= percent * union. ``component_id`` is the smallest id reachable. The
    bands are made for 80 percent and more; less raises ValueError.
    """
    if percent < 80:
        raise ValueError("the bands are made for a similarity of 80 percent and more")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("id").isNotNull())
    # what tells the texts of an id apart
    docs = docs.withColumn("row", F.xxhash64("id", F.xxhash64("text")))
    sketched = materialize(in_arrow(docs, _sketches(words), "id long, row long, n long, d1 long, d2 long, bands array<long>, sig binary"), "sketches")
    # one class for each set; its smallest id stands for it
    ids = sketched.groupBy("id").agg(F.min(F.struct("n", "d1", "d2", "row")).alias("s")).select("id", "s.*")
    filled = ids.where("n > 0")
    classes = filled.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    classed = materialize(filled.join(classes, ["n", "d1", "d2"]).select("id", "n", "row", "rep"), "classes")
    reps = classed.where("id = rep").select("id", "row")
    first = sketched.join(reps, ["id", "row"]).dropDuplicates(["id"])
    keyed = first.select("id", "row", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = materialize(keyed.join(shared, "key"), "buckets")
    # texts, sketches and private shingles of the classes that share a bucket
    texts = materialize(among(docs, buckets, "row").dropDuplicates(["id"]).drop("row"), "texts")
    holders = in_arrow(texts, _exploded(words), "id long, h long").groupBy("h").agg(F.count("*").alias("holders"), F.min("id").alias("id"))
    private = holders.where("holders = 1").groupBy("id").agg(F.count("*").alias("own"))
    sizes = buckets.groupBy("id").agg(F.max("n").alias("n"), F.max("row").alias("row")).join(private, "id", "left").select("id", "row", "n", F.coalesce("own", F.lit(0)).alias("own"))
    sizes = materialize(sizes, "sizes")
    signed = sketched.join(sizes, ["id", "row"]).select("id", "sig").dropDuplicates(["id"])

    least = least_bins(percent)

    def possible(both: Column) -> Column:
        """Whether sets of n_a and n_b elements are a link if they have ``both`` in common."""
        return both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with n_a, n_b and both, of full sets; a text b that many others meet is dealt out in copies."""
        copies = F.ceil(F.count("*") / HUB_PAIRS).cast("long")
        several = pairs.groupBy("b").agg(copies.alias("copies")).where("copies > 1")
        salted = pairs.join(several, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), "copies"), F.lit(0).cast("long")).alias("salt"))
        a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        b = pairs.select("b").distinct().join(several, "b", "left").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        b = b.select("b", "text_b", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("copies") - 1, F.lit(0).cast("long")))).alias("salt"))
        return materialize(in_arrow(salted.join(a, "a").join(b, ["b", "salt"]).select("a", "b", "text_a", "text_b"), _verify(words), "a long, b long, n_a long, n_b long, both long"), "compared")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links."""
        a, b = (signed.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        likely = in_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b"), _agree(least), "a long, b long")
        return compared(materialize(likely, "likely")).where(possible(F.col("both"))).select("a", "b")

    # a class with more private shingles than any link leaves takes no part
    members = buckets.select("key", "id").join(sizes.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent).drop("row"), "id")
    members = materialize(members, "members")
    hubs = members.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("part"), F.col("id").alias("id"))).alias("hub"))
    star = members.join(hubs, "key").where("id <> hub.id").groupBy(F.col("id").alias("a")).agg(F.min("hub").alias("hub")).select("a", F.col("hub.id").alias("b"))
    star = materialize(star, "star")
    starred = compared(star)
    joined = components(starred.where(possible(F.col("both"))).select("a", "b"))
    named = joined.select(F.col("node").alias("id"), "component")
    # members outside a bucket's largest component with all of another component in it
    # what a member has in common with its hub, and outside the hub with any other member at most
    outside = F.greatest(F.lit(0), F.col("n") - F.col("both") - F.col("own"))
    hubs = starred.select(F.col("a").alias("id"), F.col("b").alias("hub"), "both")
    labelled = members.join(named, "id", "left").join(hubs, "id", "left").select("key", "id", "n", "own", "hub", F.col("both").alias("in"), outside.alias("out"), F.coalesce("component", "id").alias("comp"))
    labelled = materialize(labelled, "labelled")
    parts = labelled.groupBy("key", "comp").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "comp")).alias("top")).where("parts > 1").select("key", F.col("top.comp").alias("top"))
    rest = labelled.join(mixed, "key")
    rest = materialize(rest.join(rest.groupBy("id").agg(F.collect_set("key").alias("keys")), "id"), "rest")
    # Private shingles are in no intersection, so it is no larger than the smaller rest of both sets; a set with the smaller
    # rest links only with sets whose size is between that rest and what the rest allows: pairs are joined by steps of size.
    left = F.col("n") - F.col("own")
    most = F.floor(left * (100 + percent) / percent) - F.col("n")
    step = lambda n: F.floor(F.log(n) / np.log(SIZE_STEP))
    lesser, other = (rest.select("key", "top", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "own", "hub", "in", "out", "comp", "keys")), left.alias(f"left_{x}"), more) for x, more in (("a", most.alias("most")), ("b", step(F.col("n")).alias("step"))))
    lesser = lesser.where("most >= left_a").withColumn("step", F.explode(F.sequence(step(F.col("left_a")), step(F.col("most")))))
    by_hub = F.when(F.col("hub_a") == F.col("hub_b"), F.least("in_a", "in_b") + F.least("out_a", "out_b"))
    near = possible(F.least("left_a", by_hub)) & F.col("n_b").between(F.col("left_a"), F.col("most"))
    ordered = F.struct("left_a", "id_a") < F.struct(F.col("left_b").alias("left_a"), F.col("id_b").alias("id_a"))
    # pairs come from their smallest bucket; members of a bucket's largest component never meet each other
    smallest = F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b"))

    def met(some: DataFrame, others: DataFrame) -> DataFrame:
        found = some.join(others.drop("top"), ["key", "step"]).where((F.col("comp_a") != F.col("comp_b")) & ordered & near & smallest)
        return found.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"))

    cross = met(lesser.where("comp_a <> top"), other).union(met(lesser.where("comp_a = top"), other.where("comp_b <> top"))).distinct()
    tested = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = linked(cross.join(tested, ["a", "b"], "left_anti"))
    for x in "ab":
        more = more.join(named.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(x, F.coalesce(f"c{x}", x)).drop(f"c{x}")
    again = components(more).select(F.col("node").alias("comp"), F.col("component").alias("last"))
    reached = named.select(F.col("id").alias("rep"), F.col("component").alias("comp"))
    whole = classed.join(reached, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(again, "comp", "left")
    whole = whole.select("id", F.coalesce("last", "comp").alias("component_id"))
    out = ids.select("id", F.col("n").alias("n_shingles")).join(whole, "id", "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id") == F.col("component_id"))
