"""Folder structures against a template of levels (SRC17, AG31, JN18, ST05)."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths

#: The templates that can be named.
BUILTIN = {
    "para": 'name = "PARA"\n[[levels]]\nrequired = ["1 Projekte", "2 Bereiche", "3 Ressourcen", "4 Archiv"]\n',
    "johnny-decimal": "name = \"Johnny.Decimal\"\n[[levels]]\npatterns = ['^\\d0-\\d9 ']\n[[levels]]\npatterns = ['^\\d\\d ']\n[[levels]]\npatterns = ['^\\d\\d\\.\\d\\d ']\n",
}
#: Kinds of deviations in their order.
KINDS = ["missing_required", "unexpected_dir", "bad_name", "file_not_allowed", "too_deep"]


@dataclass(frozen=True)
class Level:
    required: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    allow_other: bool = False
    files: bool = False


@dataclass(frozen=True)
class Template:
    name: str
    levels: tuple[Level, ...]
    max_depth: int | None = None


def parse(text: str) -> Template:
    """A template's TOML, or the name of one of ``BUILTIN``; ValueError says what is wrong."""
    raw = tomllib.loads(BUILTIN.get(text.lower(), text))
    if unknown := set(raw) - {"name", "max_depth", "levels"}:
        raise ValueError(f"unknown key {sorted(unknown)[0]}")
    levels = []
    for i, held in enumerate(raw.get("levels", []), 1):
        if unknown := set(held) - set(Level.__dataclass_fields__):
            raise ValueError(f"level {i}: unknown key {sorted(unknown)[0]}")
        lists = {k: tuple(held.get(k, ())) for k in ("required", "allowed", "patterns")}
        if bad := [n for n in (*lists["required"], *lists["allowed"]) if not n.strip() or "/" in n or "\\" in n]:
            raise ValueError(f"level {i}: {bad[0]!r} is no folder's name")
        for pattern in lists["patterns"]:
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"level {i}: {e}") from None
        # a level that says nothing about folders allows all
        levels.append(Level(**lists, allow_other=held.get("allow_other", not any(lists.values())), files=held.get("files", False)))
    depth = raw.get("max_depth")
    if depth is not None and depth < max(1, len(levels)):
        raise ValueError(f"max_depth {depth} is less than the number of levels")
    if depth is None and not levels:
        raise ValueError("the template says nothing")
    return Template(raw.get("name", "template"), tuple(levels), depth)


def _odd(level: Level, name: Column) -> Column:
    """The deviation of a folder's name at a level, or null."""
    if level.allow_other:
        return F.lit(None).cast("string")
    fits = F.lower(name).isin([n.lower() for n in (*level.required, *level.allowed)])
    for pattern in level.patterns:
        fits = fits | name.rlike(f"(?i){pattern}")
    return F.when(~fits, "bad_name" if level.patterns else "unexpected_dir")


def checked(files: DataFrame, dirs: DataFrame, root: str, template: Template, tool_dir: str = ".stowage") -> DataFrame:
    """``kind, path, level, bucket`` of everything the template speaks of; ``kind`` is null where it fits.

    Links, ``_archiv`` and the tool's folder, with all in them, are not
    checked. Of a branch that is too deep only its first folder counts. A
    required folder that is there is no row of its own; summed folders need
    none inside.
    """
    base = root.count("/")

    def placed(rows: DataFrame) -> DataFrame:
        level = (paths.depth(F.col("dir_key")) - base).alias("level")
        inside = F.concat(F.lit("/"), F.expr(f"substr(dir_key, {len(root) + 1})"))
        away = F.lit(False)
        for name in ("_archiv", tool_dir):
            away = away | F.contains(F.lower(inside), F.lit(f"/{name.lower()}/"))
        return rows.where(~F.col("is_link") & ~away).select("*", level, paths.bucket_of(F.col("dir_key"), root).alias("bucket"))

    deepest = template.max_depth if template.max_depth is not None else 1 << 30
    folders = placed(dirs).where("level > 0")
    name, kind = paths.name_of(F.col("dir_key")), F.when(F.col("level") > deepest, "too_deep")
    for i, level in enumerate(template.levels, 1):
        kind = kind.when(F.col("level") == i, _odd(level, name))
    named = folders.where((F.col("level") <= len(template.levels)) | (F.col("level") == deepest + 1))
    out = named.select(kind.alias("kind"), F.col("dir_key").alias("path"), "level", "bucket")

    closed = [i for i, level in enumerate(template.levels, 1) if not level.files]
    loose = placed(files).where((F.col("level") <= deepest) & (F.col("level") < len(template.levels)))
    own = F.col("level") + 1
    out = out.unionByName(loose.select(F.when(own.isin(closed), "file_not_allowed").alias("kind"), "path", own.alias("level"), "bucket"))

    for i, level in enumerate(template.levels, 1):
        if level.required:
            spark = dirs.sparkSession
            above = spark.createDataFrame([(root, "")], "dir_key string, bucket string") if i == 1 else folders.where((F.col("level") == i - 1) & (F.col("mode") != "summary")).select("dir_key", "bucket")
            wanted = above.select("bucket", "dir_key", F.explode(F.array(*map(F.lit, level.required))).alias("name"))
            wanted = wanted.select("bucket", F.concat("dir_key", "name", F.lit("/")).alias("path")).withColumn("key", F.lower("path"))
            missing = wanted.join(dirs.select(F.lower("dir_key").alias("key")), "key", "left_anti")
            out = out.unionByName(missing.select(F.lit("missing_required").alias("kind"), "path", F.lit(i).cast("long").alias("level"), "bucket"))
    return out


def deviations(found: DataFrame) -> DataFrame:
    return found.where("kind is not null")


def by_bucket(found: DataFrame) -> DataFrame:
    """Of each folder below the root (empty: the root itself): what was checked and how much of it deviates."""
    return found.groupBy("bucket").agg(F.count("*").alias("checked"), F.count("kind").alias("deviations"))
