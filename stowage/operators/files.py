"""Totals and lists over the files of an inventory (AG01-AG11, TK01, WN01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names
from ..scratch import settle


def counted(files: DataFrame) -> DataFrame:
    """``files`` with ``counted``: the first path of each identity; files without an identity always count.

    The first path is a partial aggregate, not a window: an identity with very
    many names is one row of it.
    """
    real = F.col("volume_serial").isNotNull() & F.col("file_index").isNotNull()
    first = files.where(real).groupBy("volume_serial", "file_index").agg(F.min("path_key").alias("_first"))
    return files.join(first, ["volume_serial", "file_index"], "left").select(
        *files.columns, (F.col("_first").isNull() | (F.col("_first") == F.col("path_key"))).alias("counted")
    )


def real_size() -> Column:
    """The size of a file that counts, else 0."""
    return F.when(F.col("counted") & ~F.col("is_link"), F.greatest(F.col("size"), F.lit(0))).otherwise(0).cast("long")


def overview(files: DataFrame, dirs: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of totals."""
    plain = ~F.col("is_link")
    f = counted(files).agg(
        F.count_if(plain).alias("real_files"),
        F.sum(real_size()).alias("real_size"),
        F.count_if(plain & F.col("cloud_only")).alias("cloud_files"),
        F.sum(F.when(F.col("cloud_only"), real_size()).otherwise(0)).alias("cloud_bytes"),
        F.count_if(plain & F.col("hidden")).alias("hidden"),
        F.count_if(plain & F.col("system")).alias("system"),
        F.count_if(F.col("is_link")).alias("link_files"),
    )
    d = dirs.agg(F.count_if(plain).alias("dirs"), F.count_if(F.col("is_link")).alias("link_dirs"), F.sum("summary_size").alias("summary_size"), F.sum("summary_files").alias("summary_files"))
    e = errors.agg(F.count("*").alias("errors"))
    total = F.col("real_size") + F.col("summary_size")
    # one row each
    return f.join(d).join(e).select(
        (F.col("real_files") + F.col("summary_files")).alias("files"), "dirs", total.alias("total_size"), "summary_size",
        F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col("summary_size") / total, 6)).alias("summary_share"),
        "cloud_files", "cloud_bytes", "hidden", "system", (F.col("link_files") + F.col("link_dirs")).alias("links"), "errors",
    )


def by_extension(files: DataFrame) -> DataFrame:
    some = counted(files).where(F.col("counted") & ~F.col("is_link"))
    key = F.coalesce(F.nullif(F.col("ext"), F.lit("")), F.lit("(keine)"))
    return some.groupBy(key.alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def _with_all(keys: list[str], name: str, grouped: DataFrame) -> DataFrame:
    """``grouped`` with a row of zeros for each key that it lacks."""
    every = grouped.sparkSession.createDataFrame([(k,) for k in keys], f"{name} string")
    return every.join(grouped, name, "left").select(name, F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def by_category(files: DataFrame) -> DataFrame:
    some = counted(files).where(F.col("counted") & ~F.col("is_link"))
    grouped = some.groupBy(names.file_category(F.col("ext")).alias("category")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))
    return _with_all(names.ALL_CATEGORIES, "category", grouped)


def age_classes(files: DataFrame, now: int) -> DataFrame:
    some = counted(files).where(F.col("counted") & ~F.col("is_link"))
    grouped = some.groupBy(names.age_class(names.age_days(F.col("mtime"), now)).alias("age")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))
    return _with_all(names.AGE_CLASSES, "age", grouped)


def file_items(files: DataFrame, now: int) -> DataFrame:
    """Projection of a file for lists (PR08)."""
    return files.where(~F.col("is_link")).select(
        "path", "size", F.floor(F.col("mtime") / 10_000_000).cast("long").alias("mtime_s"), names.age_days(F.col("mtime"), now).alias("age_days"), "hidden", "system", "cloud_only"
    )


def old_files(files: DataFrame, now: int, days: int = 365) -> DataFrame:
    """All real files older than ``days``, with whether their size counts towards the total."""
    some = counted(files).where(~F.col("is_link") & (names.age_days(F.col("mtime"), now) > days))
    return some.select("path", "size", names.age_days(F.col("mtime"), now).alias("age_days"), "counted")


def top_files(files: DataFrame, n: int = 50) -> DataFrame:
    return files.where(~F.col("is_link")).select("path", "size").orderBy(F.desc("size"), "path").limit(n)


def local(files: DataFrame) -> DataFrame:
    """Files whose content is on this machine (FL10)."""
    return files.where(~F.col("cloud_only") & ~F.col("is_link") & (F.col("size") > 0))


def problems(files: DataFrame, dirs: DataFrame, hosts: list[str]) -> DataFrame:
    """``path, is_dir, problems`` of all files and folders with a problem."""
    from ..functions.paths import name_of

    f = files.where(~F.col("is_link")).select("path", F.lit(False).alias("is_dir"), names.file_problems(F.col("name"), F.col("path"), F.col("size"), hosts).alias("problems"))
    name = name_of(F.col("dir_key"))
    d = dirs.select(F.col("dir_key").alias("path"), F.lit(True).alias("is_dir"), names.dir_problems(name, F.col("dir_key")).alias("problems"))
    return f.unionByName(d).where(F.size("problems") > 0)


def similar_groups(files: DataFrame) -> DataFrame:
    """Members of groups of two and more files of one folder whose names have one normal form.

    ``exact_duplicate``: another member has the same content. ``row`` tells files apart, also those with one path.
    """
    stem, ext = names.split_stem(F.col("name"))
    some = files.where(~F.col("is_link")).select("path_key", "dir_key", "size", "mtime", "full_hash", "cloud_only", "is_link", "path", ext.alias("group_ext"), names.normalize_name(stem).alias("normal"), F.monotonically_increasing_id().alias("row"))
    # three uses: the normal forms are worked out once
    some = settle(some)
    groups = some.groupBy("dir_key", "normal", "group_ext").agg(F.count("*").alias("members")).where("members > 1")
    same = some.where("full_hash is not null").groupBy("dir_key", "normal", "group_ext", "full_hash", "size").agg(F.count("*").alias("_same"))
    keys = ["dir_key", "normal", "group_ext"]
    out = some.join(groups, keys).join(same, [*keys, "full_hash", "size"], "left")
    return out.select(*some.columns, "members", (F.coalesce("_same", F.lit(0)) > 1).alias("exact_duplicate"))
