"""Places in a total order and fixed orders of lists (WN05, WN08, TK03, TK05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..scratch import settle


def numbered(rows: DataFrame, *by: Column, name: str = "place") -> DataFrame:
    """``rows`` with their places 1, 2, ... in the order ``by``: places within sorted partitions plus the sizes of those
    before, so no task sees all rows. The order must be total."""
    spark = rows.sparkSession
    # written: a lost block must not be made again by another dealing of the rows
    parts = settle(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = [(r["_p"], r["n"], r["f"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("f")).orderBy("_p").collect()]
    starts, total = [], 0
    for p, n, first in sizes:
        starts.append((p, total - first + 1))
        total += n
    offsets = spark.createDataFrame(starts, "_p int, _o long")
    # one row a partition
    return parts.join(F.broadcast(offsets), "_p").select(*rows.columns, (F.col("_i") + F.col("_o")).alias(name))


def duplicate_groups(groups: DataFrame) -> DataFrame:
    """Groups of equal files with ``group_no``: most wasted bytes first, then the first path."""
    return numbered(groups, F.desc("wasted"), F.asc("first_path"), name="group_no")


def structure_order(issues: DataFrame) -> DataFrame:
    """Findings with ``place``: by kind of finding, then path."""
    return numbered(issues, F.asc("issue"), F.asc("dir_key"))


def problem_order(problems: DataFrame) -> DataFrame:
    """Entries with problems and their ``place``: by path, a folder before a file of the same path."""
    return numbered(problems, F.asc("path"), F.desc("is_dir"))


def folder_group_order(groups: DataFrame) -> DataFrame:
    """``first_folder, height, top, bytes, group_no`` of groups of equal folders (rows: ``dir_key, fingerprint, bytes``).

    Higher trees first, so that a group comes before those inside its members; then the one with the shallowest member,
    more bytes, and the first member's path. Folders of a group are equal, so one's height is that of all.
    """
    each = groups.groupBy("fingerprint").agg(F.max("height").alias("height"), F.min(paths.depth(F.col("dir_key"))).alias("top"), F.max("bytes").alias("bytes"), F.min("dir_key").alias("first_folder"))
    return numbered(each, F.desc("height"), F.asc("top"), F.desc("bytes"), F.asc("first_folder"), name="group_no")


def heights(folders: DataFrame, root: str) -> DataFrame:
    """``dir_key, height`` of the folders in ``folders`` (those whose content counts): levels below each of them."""
    up = folders.select(paths.depth(F.col("dir_key")).alias("d"), F.explode(paths.ancestors(F.col("dir_key"), root)).alias("dir_key"))
    return up.groupBy("dir_key").agg((F.max("d") - F.min(paths.depth(F.col("dir_key")))).alias("height"))
