r"""Personal data: patterns for entities, and terms that give entities away.

Base entities are found by one pattern for each kind, leftmost and without
overlap; a match that fails its kind's test (parts of an address, Luhn's sum,
number of digits) is dropped and not tried again. Matches and the text between
them (``regexp_extract_all`` and ``split`` with one pattern) give the offsets
in code points.

Sanitisation is information-theoretic: an entity kind ``c`` has the
information ``IC(c) = -log2 p(c)`` over all documents, and a term ``t``
reveals ``PMI(t; c) = log2 p(t, c) / (p(t) p(c))`` of it. A term whose
``PMI >= alpha * IC`` that ``min_support`` documents with the kind hold
exceeds the disclosure threshold: its occurrences in documents with that kind
become spans of the kind ``term``. Counts cover all documents. ``redact``
generalises base spans to ``[KIND]`` and removes terms (``[TERM]``).

Everything is DataFrame expressions. The patterns are possessive, so that
they need no stack for long matches, and start only where a run of their
characters starts, so that they take linear time; both leave the matches as
they are. Terms are counted by 64-bit hashes after a partial aggregate; only
rows of documents with an entity are joined to the terms found.

Defined results: a null text is empty. Rows are independent of each other's
ids: a repeated row counts as often as it occurs and each row gets its spans.
Other columns are not returned; name the ids with ``id_col``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import light, materialize

KINDS = ["email", "ip", "card", "phone"]
_PATTERN = {
    # \G: a match may start where the last one ended, inside a run of its characters
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What a text must contain before the pattern is tried.
_HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
_TERM = r"\p{L}[\p{L}\p{M}]{2,}"


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _positions(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, found>> of a pattern's matches, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(between.alias("gap"), found.alias("found"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,found:string>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["found"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), p["found"].alias("found")))
        return F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans"))

    # the last gap has no match after it
    return F.aggregate(F.filter(pairs, lambda p: p["found"].isNotNull()), begin, step, lambda acc: acc["spans"])


def find_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end>> of the valid spans of one kind."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    spans = F.when(_HINT[kind](text), _positions(text, _PATTERN[kind])).otherwise(none)
    return F.transform(F.filter(spans, lambda s: _valid(kind, s["found"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def with_base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with an array of spans in ``_email``, ``_ip``, ``_card``, ``_phone``; null texts become empty."""
    docs = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumns({f"_{k}": find_spans(F.col(text_col), k) for k in KINDS})


def join_spans(kind: str, spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))), ",")


def joined(*parts: Column) -> Column:
    """Non-empty lists of spans, comma-joined."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ",")


def _masked(text: Column) -> Column:
    """The text without anything that looks like an address, so that its parts are no terms."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, _PATTERN["email"], " ")).otherwise(text)


def _terms(text: Column) -> Column:
    """Distinct lower-case terms."""
    words = F.split(F.lower(text), r"[^\p{L}\p{M}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def analyse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.8, min_support: int = 5) -> DataFrame:
    """``id, text, email, ip, card, phone, term``: each row's text and spans (arrays of structs start, end)."""
    spark = docs.sparkSession
    based = with_base_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    flags = [F.when(F.size(f"_{k}") > 0, 1).otherwise(0).alias(k) for k in KINDS]
    # the text stays only where terms can be looked for
    some = F.greatest(*(F.size(f"_{k}") for k in KINDS)) > 0
    found = materialize(based.select(F.expr("uuid()").alias("row"), "id", F.when(some, F.col("text")).alias("held"), *(F.col(f"_{k}").alias(k) for k in KINDS)), "entities")
    sizes = found.agg(F.count("*").alias("n"), *(F.count_if(F.size(k) > 0).alias(k) for k in KINDS)).first()
    total = sizes["n"]
    with_entity = found.where("held is not null")
    held = with_entity.select("row", *(F.when(F.size(k) > 0, 1).otherwise(0).alias(k) for k in KINDS), F.explode(_terms(_masked(F.col("held")))).alias("term"))
    joint = held.groupBy(F.xxhash64("term").alias("h")).agg(*(F.sum(k).alias(k) for k in KINDS))
    joint = materialize(joint.where(F.greatest(*KINDS) >= min_support), "joint")
    everywhere = docs.select(F.explode(_terms(_masked(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))).alias("term"))
    # only terms of documents with entities are counted
    counts = everywhere.select(F.xxhash64("term").alias("h")).join(light(joint.select("h")), "h", "left_semi").groupBy("h").agg(F.count("*").alias("df"))

    def discloses(k: str) -> Column:
        """p(t, c) / (p(t) p(c)) >= p(c) ** -alpha"""
        if not sizes[k] or sizes[k] == total:
            return F.lit(False)
        least = (sizes[k] / total) ** -alpha
        return (F.col(k) >= min_support) & (F.col(k).cast("double") * total >= F.lit(least) * F.col("df") * sizes[k])

    risky = joint.join(counts, "h").select("h", *(discloses(k).alias(f"r_{k}") for k in KINDS))
    risky = materialize(risky.where(" or ".join(f"r_{k}" for k in KINDS)), "terms")
    mine = held.withColumn("h", F.xxhash64("term")).join(risky, "h").where(" or ".join(f"({k} = 1 and r_{k})" for k in KINDS))
    mine = mine.groupBy("row").agg(F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}])(?:"), F.array_join(F.sort_array(F.collect_set("term")), "|"), F.lit(r")(?![\p{L}\p{M}])")).alias("pattern"))
    # a term that overlaps a base span stays part of it
    texts = with_entity.select("row", "held", *KINDS).join(mine, "row")
    every = F.flatten(F.array(*KINDS))
    clear = F.filter(_positions(F.col("held"), F.col("pattern")), lambda t: ~F.exists(every, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    terms = materialize(texts.select("row", F.transform(clear, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("term")), "term-spans")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return found.join(terms, "row", "left").select("id", F.col("held").alias("text"), *KINDS, F.coalesce("term", none).alias("term"))


def redact(text: Column, *kinds: tuple[str, Column]) -> Column:
    """The text with each (kind, spans) replaced by ``[KIND]``; of overlapping spans the first (then the longest) counts."""

    def marked(kind: str, spans: Column) -> Column:
        mark = F.lit(f"[{kind.upper()}]").alias("mark")
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), mark))

    spans = F.sort_array(F.flatten(F.array(*(marked(k, s) for k, s in kinds))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["neg"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], gap, s["mark"]).alias("out")))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
