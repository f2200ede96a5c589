"""Rules in TOML, compiled to columns (FL01-FL09, JN12, SF14-SF16, WN09, PL07).

A rule is ``name``, conditions, a ``target`` template and ``normalize``. The
first rule whose conditions hold wins; a rule that needs a classification
which is missing or too uncertain makes a near miss. No physical join: all
rules are one expression over each file.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import names
from ..functions.text import parse_days, parse_size
from ..scratch import settle

#: Most captures that a name's pattern may export.
MAX_CAPTURES = 9


@dataclass(frozen=True)
class Rule:
    name: str
    target: str
    glob: str | None = None
    ext: tuple[str, ...] = ()
    name_regex: str | None = None
    min_age: int | None = None
    max_age: int | None = None
    min_size: int | None = None
    max_size: int | None = None
    category: tuple[str, ...] = ()
    category_source: str = "any"
    min_confidence: float = 0.8
    normalize: bool = False
    fields: dict[str, str] = field(default_factory=dict)
    fields_regex: dict[str, str] = field(default_factory=dict)
    text_regex: str | None = None
    min_dwell: int | None = None
    exif_fallback: str = "mtime"


#: Columns that only some rules look at; null where the files have none.
OPTIONAL = {"classified": "boolean", "source": "string", "text": "string", "ctime": "long", "first_seen": "long", "taken": "timestamp"}
#: Parts of a date's format and Spark's letters for them.
DATE_PARTS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def date_format(pattern: str) -> str:
    """Spark's pattern for a ``strftime`` one; ValueError for a part it lacks."""
    out = ""
    for part, text in re.findall(r"(%.?)|([^%]+)", pattern):
        if part and part not in DATE_PARTS:
            raise ValueError(f"{part}: unknown part of a date")
        out += DATE_PARTS[part] if part else "'" + text.replace("'", "''") + "'"
    return out


def parse(text: str) -> list[Rule]:
    """Rules of a TOML file (``[[rule]]``); ValueError names the rule and the key."""
    out: list[Rule] = []
    keys = set(Rule.__dataclass_fields__)
    for i, raw in enumerate((held := tomllib.loads(text)).get("rule", []) + held.get("rules", [])):
        name = raw.get("name") or f"rule {i + 1}"
        if unknown := set(raw) - keys:
            raise ValueError(f"{name}: unknown key {sorted(unknown)[0]}")
        if not raw.get("target"):
            raise ValueError(f"{name}: no target")
        if any(r.name == name for r in out):
            raise ValueError(f"{name}: the name is used twice")
        made = dict(raw) | {"name": name}
        for key in ("min_age", "max_age", "min_dwell"):
            if isinstance(made.get(key), str):
                made[key] = parse_days(made[key])
        for key in ("min_size", "max_size"):
            if isinstance(made.get(key), str):
                made[key] = parse_size(made[key])
        for key in ("ext", "category"):
            values = made.get(key, ())
            made[key] = tuple(x.lower() for x in ([values] if isinstance(values, str) else values))
        for key, known in (("category_source", ("any", "rules")), ("exif_fallback", ("mtime", "skip"))):
            if made.get(key, known[0]) not in known:
                raise ValueError(f"{name}: {key} is {' or '.join(known)}")
        for pattern in (*made.get("fields_regex", {}).values(), *filter(None, [made.get("text_regex")])):
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"{name}: {e}") from None
        groups = re.compile(made["name_regex"]).groups if made.get("name_regex") else 0
        if groups > MAX_CAPTURES:
            raise ValueError(f"{name}: more than {MAX_CAPTURES} groups")
        tokens(made["target"], groups)
        out.append(Rule(**made))
    return out


def glob_regex(pattern: str) -> str:
    """``*`` stays in one level, ``**`` crosses levels, ``?`` is a character; case doesn't matter."""
    out, i = "", 0
    pattern = pattern.replace("\\", "/")
    while i < len(pattern):
        if pattern[i : i + 3] == "**/":
            out, i = out + "(.*/)?", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
    return f"(?i)^{out}$"


def tokens(template: str, groups: int = 0) -> list[tuple[str, str, str | None]]:
    """(kind, value, fallback) of a target: text, field or capture. ``{{`` and ``}}`` are braces."""
    out: list[tuple[str, str, str | None]] = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{([^{}]+)\}", template):
        if literal:
            out.append(("text", literal.replace("{{", "{").replace("}}", "}"), None))
            continue
        name, _, fallback = name.partition("|")
        if name.isdigit():
            if not 1 <= int(name) <= groups:
                raise ValueError(f"{{{name}}}: no such group")
            out.append(("capture", name, fallback or None))
        elif name == "exif.date" or name.startswith("exif.date:"):
            out.append(("taken", date_format(name[10:] or "%Y-%m-%d"), fallback or None))
        elif name in ("name", "stem", "ext", "parent", "year", "month", "day", "category") or name.startswith("doc."):
            out.append(("field", name, fallback or None))
        else:
            raise ValueError(f"{{{name}}}: unknown")
    return out


def condition(rule: Rule, now: int, root: str) -> Column:
    """The conditions that need no content."""
    out = ~F.col("is_link")
    if rule.glob:
        out = out & F.substr("path", F.lit(len(root) + 1)).rlike(glob_regex(rule.glob))
    if rule.ext:
        out = out & F.coalesce(F.col("ext"), F.lit("")).isin(*rule.ext)
    if rule.name_regex:
        out = out & F.col("name").rlike(rule.name_regex)
    days = names.age_days(F.col("mtime"), now)
    for limit, test in ((rule.min_age, days >= F.lit(rule.min_age)), (rule.max_age, days <= F.lit(rule.max_age)), (rule.min_size, F.col("size") >= F.lit(rule.min_size)), (rule.max_size, F.col("size") <= F.lit(rule.max_size))):
        if limit is not None:
            out = out & test
    return out


def content_condition(rule: Rule, now: int) -> tuple[Column, Column]:
    """(holds, reason): whether the conditions on content and stay hold, and what makes it a near miss only.

    A file that was not classified (``classified``; where that is null, one
    without a category) is a near miss of any rule that looks at its content; a
    text that was not read fits none.
    """
    holds, reason = F.lit(True), F.lit(None).cast("string")
    about = bool(rule.category or rule.fields or rule.fields_regex)
    unknown = ~F.coalesce("classified", F.col("category").isNotNull()) if about else F.lit(False)
    if rule.min_dwell is not None:
        arrived = F.greatest(F.coalesce("ctime", "mtime"), "first_seen")
        reason = F.when(names.age_days(arrived, now) < rule.min_dwell, "too-recent-arrival")
    if rule.category:
        holds = F.coalesce(F.lower("category").isin(*rule.category), F.lit(False))
        if rule.category_source == "rules":
            holds = holds & ~F.coalesce(F.col("source") == "llm", F.lit(False))
        reason = F.when(F.col("confidence") < rule.min_confidence, "low-confidence").otherwise(reason)
    for key, value in rule.fields.items():
        holds = holds & F.coalesce(F.lower(F.try_element_at("fields", F.lit(key))) == value.lower(), F.lit(False))
    for key, pattern in rule.fields_regex.items():
        holds = holds & F.coalesce(F.try_element_at("fields", F.lit(key)).rlike(pattern), F.lit(False))
    if rule.text_regex:
        holds = holds & F.coalesce(F.col("text").rlike(rule.text_regex), F.lit(False))
    return unknown | holds, F.when(unknown, "not-classified").otherwise(reason)


def expand(rule: Rule) -> Column:
    """The target of a file; null if a field is missing and has no fallback."""
    when = F.timestamp_seconds((F.col("mtime") / 10_000_000).cast("long"))
    stem, ext = names.split_stem(F.col("name"))
    values = {
        "name": names.tidy_name(F.col("name")) if rule.normalize else F.col("name"),
        "stem": stem,
        "ext": F.nullif(ext, F.lit("")),
        "parent": F.regexp_extract("dir_key", "([^/]+)/$", 1),
        "year": F.date_format(when, "yyyy"),
        "month": F.date_format(when, "MM"),
        "day": F.date_format(when, "dd"),
        "category": F.col("category"),
    }
    parts = []
    for kind, value, fallback in tokens(rule.target, MAX_CAPTURES):
        if kind == "text":
            parts.append(F.lit(value))
            continue
        if kind == "taken":
            taken = F.coalesce("taken", when) if rule.exif_fallback == "mtime" else F.col("taken")
            parts.append(F.coalesce(F.date_format(taken, value), F.lit(fallback)))
            continue
        found = F.nullif(F.regexp_extract("name", rule.name_regex, int(value)), F.lit("")) if kind == "capture" else values[value] if value in values else F.try_element_at("fields", F.lit(value[4:]))
        parts.append(F.coalesce(found, F.lit(fallback)) if fallback is not None else found)
    made = F.concat(*parts)
    # a target that ends in a separator keeps the file's name
    return F.when(made.endswith("/"), F.concat(made, values["name"])).otherwise(made)


def match(files: DataFrame, rules: list[Rule], now: int, root: str) -> DataFrame:
    """``files`` with ``rule``, ``status`` (match, near-miss, none) and ``near`` (why it is a near miss) of the first rule that fits.

    ``files`` needs ``category``, ``confidence`` and ``fields`` (null where a
    file was not classified); columns of ``OPTIONAL`` that it lacks are null.
    """
    files = files.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in files.columns})
    found = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("near"))
    for rule in reversed(rules):
        holds, reason = content_condition(rule, now)
        found = F.when(condition(rule, now, root) & holds, F.struct(F.lit(rule.name).alias("rule"), reason.alias("near"))).otherwise(found)
    status = F.when(F.col("_m.rule").isNull(), "none").when(F.col("_m.near").isNull(), "match").otherwise("near-miss")
    return files.withColumn("_m", found).withColumns({"rule": F.col("_m.rule"), "near": F.col("_m.near"), "status": status}).drop("_m")


#: The last number a name gets, and the longest path.
MAX_NUMBER, MAX_PATH = 1000, 260
_NUMBERED = r"^(.*/[^/]+) \(([1-9][0-9]{0,3})\)(\.[^./]*)?$"


def numbered(path: Column, n: Column) -> Column:
    """``path`` with `` (n)`` before its ending, itself for 1."""
    parts = [F.regexp_extract(path, r"^(.*/[^/]+?)(\.[^./]*)?$", k) for k in (1, 2)]
    return F.when(n == 1, path).otherwise(F.concat(parts[0], F.lit(" ("), n.cast("string"), F.lit(")"), parts[1]))


def _occupied(files: DataFrame, dirs: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """``base, n, key, size, full_hash, folder``: what has the name ``base`` or that with `` (n)``, for the keys in ``wanted``."""
    every = files.select(F.col("path_key").alias("key"), F.when(~F.col("cloud_only") & ~F.col("is_link"), F.col("size")).alias("size"), "full_hash", F.lit(False).alias("folder"))
    if dirs is not None:
        none = (F.lit(None).cast(every.schema[c].dataType).alias(c) for c in ("size", "full_hash"))
        every = every.union(dirs.select(F.regexp_replace("dir_key", "/$", "").alias("key"), *none, F.lit(True)))
    number = F.regexp_extract("key", _NUMBERED, 2)
    names = F.array(F.struct(F.col("key").alias("base"), F.lit(1).alias("n")), F.struct(F.concat(F.regexp_extract("key", _NUMBERED, 1), F.regexp_extract("key", _NUMBERED, 3)).alias("base"), F.nullif(number, F.lit("")).cast("int").alias("n")))
    rows = every.select("*", F.explode(names).alias("b")).select("b.base", "b.n", "key", "size", "full_hash", "folder")
    return rows.where(F.col("n").between(1, MAX_NUMBER)).where("n > 1 or base = key").join(wanted.select("base").distinct(), "base", "left_semi")


def _free(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` with ``n``: in the order of their keys, the numbers of their base that nothing has."""
    place = Window.partitionBy("base").orderBy("path_key", "row")
    # the k-th free number is k and as many as are taken below it: those with less than k free ones before them
    told = taken.select("base", "n").distinct().select("base", (F.col("n") - F.row_number().over(Window.partitionBy("base").orderBy("n")) + 1).alias("v"))
    marks = rows.withColumn("v", F.row_number().over(place)).withColumn("mover", F.lit(1)).unionByName(told.withColumn("mover", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy("base").orderBy("v", "mover").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("n", F.col("v") + F.sum(1 - F.col("mover")).over(so_far)).where("mover = 1").drop("v", "mover")


def plan_rules(files: DataFrame, rules: list[Rule], now: int, root: str, dirs: DataFrame | None = None) -> DataFrame:
    """``path, rule, action, target, reason``.

    Several files with one target are numbered `` (2)``, `` (3)`` ... in order of
    their keys, past names that exist, up to ``MAX_NUMBER``. A file that comes
    upon itself stays; one that comes upon a file of equal size and content, or
    a folder, is skipped. (Where such a name has free numbers before it, whether
    a file gets that far is told as if all files before it moved.) The windows
    cover the files to move and the names taken of one target only, of which no
    more than ``MAX_NUMBER`` can move.
    """
    found = match(files, rules, now, root).where("status <> 'none'")
    target = F.lit(None).cast("string")
    for rule in rules:
        target = F.when(F.col("rule") == rule.name, F.concat(F.lit(root), expand(rule))).otherwise(target)
    found = found.withColumn("_wanted", target)
    reason = (
        F.when(F.col("status") == "near-miss", F.col("near"))
        .when(F.col("cloud_only"), "cloud-only")
        .when(F.col("_wanted").isNull(), "missing-field")
        .when(F.length("_wanted") > MAX_PATH, "path-too-long")
    )
    # several files may have one path: ``row`` tells them apart
    found = settle(found.select("path", "path_key", "rule", "size", "full_hash", F.col("_wanted").alias("wanted"), F.lower("_wanted").alias("base"), reason.alias("reason"), F.monotonically_increasing_id().alias("row")))
    taken = settle(_occupied(files, dirs, found.where("reason is null")))
    rows = found.where("reason is null")
    # the first number at which a file stops: its own, one of an equal file, one of a folder
    own = taken.where("not folder").groupBy("base", F.col("key").alias("path_key")).agg(F.min("n").alias("n_own"))
    equal = taken.where("size is not null and full_hash is not null").groupBy("base", "size", "full_hash").agg(F.min("n").alias("n_equal"))
    folder = taken.where("folder").groupBy("base").agg(F.min("n").alias("n_folder"))
    ranked = Window.partitionBy("base").orderBy("n")
    numbers = taken.select("base", "n").distinct().withColumn("i", F.row_number().over(ranked))
    first_free = numbers.groupBy("base").agg((F.count_if(F.col("n") == F.col("i")) + 1).alias("first_free"))
    rows = rows.join(own, ["base", "path_key"], "left").join(equal, ["base", "size", "full_hash"], "left").join(folder, "base", "left").join(first_free, "base", "left")
    rows = rows.withColumn("stop", F.least("n_own", "n_equal", "n_folder")).withColumn("surely", F.col("stop") < F.coalesce("first_free", F.lit(1)))
    rows = settle(rows.withColumn("surely", F.coalesce("surely", F.lit(False))))
    able = _free(rows.where("not surely"), taken).select("row", (F.coalesce(F.col("n") < F.col("stop"), F.lit(True))).alias("moves"))
    rows = settle(rows.join(able, "row", "left").withColumn("moves", F.coalesce("moves", F.lit(False))))
    moved = _free(rows.where("moves"), taken)
    final = numbered(F.col("wanted"), F.col("n"))
    why = F.when(F.col("n") > MAX_NUMBER, "invalid-target").when(F.length(final) > MAX_PATH, "path-too-long")
    moved = moved.select("path", "rule", F.when(why.isNull(), final).alias("target"), why.alias("reason"))
    # a file at its own place that is spelt otherwise is renamed
    itself = F.col("n_own") == F.col("stop")
    renamed = itself & (numbered(F.col("wanted"), F.col("stop")) != F.col("path"))
    why = F.when(renamed, F.lit(None)).when(itself, "already-there").when(F.col("n_equal") == F.col("stop"), "duplicate-at-target").otherwise("invalid-target")
    stay = rows.where("not moves").select("path", "rule", F.when(renamed, numbered(F.col("wanted"), F.col("stop"))).alias("target"), why.alias("reason"))
    others = found.where("reason is not null").select("path", "rule", F.lit(None).cast("string").alias("target"), "reason")
    plan = moved.union(stay).union(others)
    return plan.select("path", "rule", F.when(F.col("reason").isNull(), "move").otherwise("skip").alias("action"), "target", F.coalesce("reason", F.concat(F.lit("rule:"), "rule")).alias("reason"))


def stats(plan: DataFrame) -> DataFrame:
    """Of each rule: moves, skips and its first three examples."""
    acts = plan.where("action = 'move'")
    ranked = acts.withColumn("_n", F.row_number().over(Window.partitionBy("rule").orderBy("path"))).where("_n <= 3")
    firsts = ranked.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("path")), "|").alias("examples"))
    return plan.groupBy("rule").agg(F.count_if(F.col("action") == "move").alias("moves"), F.count_if(F.col("action") == "skip").alias("skips")).join(firsts, "rule", "left")
