"""Trees of files: listing, folder modes, summaries and roots (SRC01-SRC11).

A tree is listed level by level: the folders of a level are dealt to the
executors, which list them, and each level is written before the next starts,
so a lost executor repeats a part of one level. Links are never followed.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import dir_key, is_under, path_key
from ..operators.tree import to_ancestors
from ..scratch import settle

EXCLUDE, SUMMARY, FULL = "exclude", "summary", "full"
#: Names that are never listed, or only summed.
EXCLUDED_NAMES = ["$recycle.bin", "system volume information"]
EXCLUDED_FILES = ["pagefile.sys", "hiberfil.sys", "swapfile.sys"]
SUMMARY_NAMES = [".git", "node_modules", "target", ".venv", "venv", "__pycache__", ".gradle"]
PROJECT_FILES = r"(?i)\.(csproj|sln)$"
_ROW = [("kind", pa.string()), ("dir", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("is_link", pa.bool_()), ("error", pa.string())]
#: Folders that one task lists.
FOLDERS_PER_TASK = 2_000


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_ROW)

    def entries(folder: str) -> Iterator[tuple]:
        try:
            with os.scandir(folder) as found:
                for e in found:
                    name = os.fsencode(e.name).decode("utf-8", "replace")
                    try:
                        s = e.stat(follow_symlinks=False)
                    except OSError as x:
                        yield "error", folder, name, None, None, None, type(x).__name__
                        continue
                    link = stat.S_ISLNK(s.st_mode)
                    inner = stat.S_ISDIR(s.st_mode)
                    yield "dir" if inner else "file", folder, name, 0 if link or inner else s.st_size, s.st_mtime_ns // 100, link, None
        except OSError as x:
            yield "error", folder, None, None, None, None, type(x).__name__

    rows: list[tuple] = []
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            for row in entries(folder):
                rows.append(row)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=schema)
                    rows.clear()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=schema)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """``kind, path, path_key, dir_key, name, ext, size, mtime, is_link, error`` of everything below a folder that all executors see.

    ``kind`` is file, dir or error; times are ticks of 100 ns. A folder that
    can't be listed gives an error row, the walk goes on. Files come with
    their extension in lower case (null without one); links have size 0.
    """
    kinds = "kind string, dir string, name string, size long, mtime long, is_link boolean, error string"
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    whole = None
    while True:
        found = settle(level.mapInArrow(_listed, kinds))
        whole = found if whole is None else whole.unionByName(found)
        level = found.where("kind = 'dir'").select(F.concat(F.regexp_replace("dir", "/$", ""), F.lit("/"), "name").alias("path"))
        count = level.count()
        if not count:
            break
        level = level.repartition(1 + count // FOLDERS_PER_TASK)
    path = F.when(F.col("name").isNull(), F.col("dir")).otherwise(F.concat(F.regexp_replace("dir", "/$", ""), F.lit("/"), "name"))
    ext = F.when(F.col("kind") == "file", F.lower(F.nullif(F.regexp_extract("name", r"^.+\.([^.]*)$", 1), F.lit(""))))
    return whole.select("kind", path.alias("path"), path_key(path).alias("path_key"), dir_key(F.col("dir")).alias("dir_key"), "name", ext.alias("ext"), "size", "mtime", "is_link", "error")


def _any_glob(patterns: list[str], path: Column, name: Column) -> Column:
    """Whether the name or the whole path fits one; ``*`` crosses levels here."""

    def regex(pattern: str) -> str:
        signs = {"*": ".*", "?": "."}
        return "".join(signs.get(c) or re.escape(c) for c in re.sub(r"\*+", "*", pattern.replace("\\", "/")))

    if not patterns:
        return F.lit(False)
    one = f"(?is)^(?:{'|'.join(map(regex, patterns))})$"
    return name.rlike(one) | path.rlike(one)


def dir_mode(
    path: Column, name: Column, root: str, exclude: list[str] = (), summary: list[str] = (), tool_dir: str | None = None, areas: dict[str, list[str]] | None = None,
    defaults: bool = True, beside_project: Column | None = None,
) -> Column:
    """exclude, summary or full of a folder by its path and name; the root itself is always full.

    ``areas`` are folders (keys) excluded or summed with all below them, unless
    the root lies in one. ``beside_project``: a project file lies next to it.
    """
    key, low = path_key(path), F.lower(name)

    def inside(kind: str) -> Column:
        hit = F.lit(False)
        for area in (areas or {}).get(kind, []):
            bare = area.rstrip("/")
            if not f"{root.rstrip('/')}/".startswith(f"{bare}/"):
                hit = hit | is_under(key, F.lit(bare))
        return hit

    standard = F.lit(defaults)
    project = low.isin("bin", "obj") & F.coalesce(beside_project, F.lit(False)) if beside_project is not None else F.lit(False)
    return (
        F.when(key == path_key(F.lit(root)), FULL)
        .when((low == (tool_dir or "")) | _any_glob(exclude, path, name) | (standard & (low.isin(EXCLUDED_NAMES) | inside(EXCLUDE))), EXCLUDE)
        .when(_any_glob(summary, path, name) | (standard & (low.isin(SUMMARY_NAMES) | project | inside(SUMMARY))), SUMMARY)
        .otherwise(FULL)
    )


def excluded_file(path: Column, name: Column, exclude: list[str] = (), defaults: bool = True) -> Column:
    return _any_glob(exclude, path, name) | (F.lit(defaults) & F.lower(name).isin(EXCLUDED_FILES))


def summaries(files: DataFrame, modes: DataFrame, root: str) -> DataFrame:
    """``dir_key, summary_size, summary_files`` of summed folders; ``modes`` has ``dir_key, mode``.

    The topmost folder that is not full decides for all below it: what lies
    below an excluded folder counts nowhere. Links count as files without size.
    """
    sums = files.groupBy("dir_key").agg(F.sum(F.when(F.col("is_link"), 0).otherwise(F.col("size"))).alias("size"), F.count("*").alias("files"))
    closed = modes.where(F.col("mode") != FULL).select(F.col("dir_key").alias("ancestor"), "mode")
    above = to_ancestors(sums, root).join(closed, "ancestor")
    top = above.groupBy("dir_key").agg(F.min(F.struct(F.length("ancestor"), "ancestor", "mode")).alias("top"), F.first("size").alias("size"), F.first("files").alias("files"))
    found = top.where(F.col("top.mode") == SUMMARY).groupBy(F.col("top.ancestor").alias("dir_key")).agg(F.sum("size").alias("size"), F.sum("files").alias("files"))
    empty = modes.where(F.col("mode") == SUMMARY).select("dir_key")
    nested = to_ancestors(empty, root).where("ancestor <> dir_key").join(closed, "ancestor", "left_semi").select("dir_key")
    outer = empty.join(nested.distinct(), "dir_key", "left_anti")
    return outer.join(found, "dir_key", "left").select("dir_key", F.coalesce("size", F.lit(0)).alias("summary_size"), F.coalesce("files", F.lit(0)).alias("summary_files"))


def under(rows: DataFrame, folder: str, key: str = "path_key") -> DataFrame:
    """Rows whose key lies in the folder (its key ends in ``/``); the prefix reaches the Parquet scan."""
    return rows.where(F.startswith(F.col(key), F.lit(folder)))


def select_root(requests: DataFrame, roots: DataFrame, key: str = "dir_key") -> DataFrame:
    """``requests`` with the longest ``root_key`` that holds each of them, null if none does.

    A request's ancestors are looked up by key, so there is no join on prefixes.
    """
    parts = F.split(F.col(key), "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    held = requests.select(key).distinct().select(key, F.explode(heads).alias("root_key")).join(roots.select("root_key").distinct(), "root_key")
    best = held.groupBy(key).agg(F.max(F.struct(F.length("root_key"), "root_key")).alias("best")).select(key, F.col("best.root_key").alias("root_key"))
    return requests.join(best, key, "left")
