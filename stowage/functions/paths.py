"""Path keys: lower-case, ``/`` between levels, folders end in ``/`` (PR01-PR07)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def path_key(path: Column) -> Column:
    """Separators unified, the long-path prefix and trailing separators stripped (not a drive root's), lower-case, drive letter upper-case."""
    key = F.regexp_replace(F.lower(F.regexp_replace(path, r"^\\\\\?\\", "")), r"[\\/]+", "/")
    key = F.when(key.rlike("^[a-z]:/?$"), F.concat(F.substring(key, 1, 2), F.lit("/"))).when(key == "/", key).otherwise(F.regexp_replace(key, "/+$", ""))
    return F.when(key.rlike("^[a-z]:"), F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 1 << 20))).otherwise(key)


def dir_key(path: Column) -> Column:
    key = path_key(path)
    return F.when(key.endswith("/"), key).otherwise(F.concat(key, F.lit("/")))


def is_under(key: Column, prefix: Column) -> Column:
    """Equal to the folder or strictly below it; ``/c/a`` does not hold ``/c/ab``."""
    bare = F.regexp_replace(prefix, "/+$", "")
    return (key == bare) | (key == prefix) | F.startswith(key, F.concat(bare, F.lit("/")))


def relative_to(path: Column, root: Column) -> Column:
    """The path below a root (both folder keys end in ``/``), null outside it."""
    return F.when(F.startswith(F.lower(path), F.lower(root)), F.substr(path, F.length(root) + 1))


def name_of(path: Column) -> Column:
    """Last segment that is not empty."""
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def depth(key: Column) -> Column:
    return (F.length(key) - F.length(F.replace(key, F.lit("/"), F.lit("")))).cast("long")


def bucket_of(key: Column, root: str) -> Column:
    """The level-1 folder below the root; empty for what lies in the root itself."""
    rest = F.substr(key, F.lit(len(root) + 1))
    return F.when(F.contains(rest, F.lit("/")), F.concat(F.lit(root), F.substring_index(rest, "/", 1), F.lit("/"))).otherwise("")


def ancestors(folder: Column, root: str) -> Column:
    """Keys of the folder and everything above it up to the root, from the materialised path."""
    parts = F.split(F.substr(folder, F.lit(len(root) + 1)), "/")
    below = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.lit(root), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i > 0, F.lit("/")).otherwise("")))
    return F.when(F.startswith(folder, F.lit(root)), below)
