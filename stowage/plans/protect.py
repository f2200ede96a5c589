"""What no plan may touch (FL11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths

#: Folders that stay whole, and files that mark a project.
NAMES = [".git", "node_modules"]
MARKERS = r"(?i)^(cargo\.toml|package\.json|.*\.(sln|csproj))$"
TOOL_DIR = ".stowage"


def _below(key: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | paths.is_under(key, F.lit(p.lower()))
    return out


def projects(files: DataFrame) -> DataFrame:
    """``dir_key`` of the folders that hold a project's marker."""
    return files.where(F.col("name").rlike(MARKERS) & ~F.col("is_link")).select("dir_key").distinct()


def protection(files: DataFrame, root: str, user: list[str] = (), system: list[str] = (), appdata: list[str] = (), tool_dir: str = TOOL_DIR) -> DataFrame:
    """``files`` with ``protection``: why a file may not be touched, null if it may.

    In this order: system, tool-dir, user-path, appdata, name (``NAMES`` below the root), project-marker (a folder of
    the path, up to the root, holds one). Folders are told apart once each, not file by file.
    """
    key = F.col("path_key")
    below = F.split(F.substr(key, F.lit(len(root) + 1)), "/")
    named = F.arrays_overlap(below, F.array(*(F.lit(n) for n in NAMES)))
    # as many rows as folders have ancestors
    up = files.select("dir_key").distinct().select("dir_key", F.explode(paths.ancestors(F.col("dir_key"), root)).alias("_a"))
    inside = up.join(projects(files).withColumnRenamed("dir_key", "_a"), "_a", "left_semi").select("dir_key").distinct().withColumn("_project", F.lit(True))
    reason = (
        F.when(_below(key, system), "system").when(F.array_contains(F.split(key, "/"), tool_dir), "tool-dir").when(_below(key, user), "user-path")
        .when(_below(key, appdata), "appdata").when(named, "name").when(F.col("_project"), "project-marker")
    )
    return files.join(inside, "dir_key", "left").withColumn("protection", reason).drop("_project")
