"""Operators on folder trees without recursion: rows go to all ancestors of their key, then aggregate (AG02, AG18-AG23, AG31, AG37)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names, paths
from ..scratch import settle
from .files import counted, real_size


def to_ancestors(df: DataFrame, root: str, key: str = "dir_key") -> DataFrame:
    """A row for each ancestor folder, itself included, in ``ancestor``."""
    return df.withColumn("ancestor", F.explode(paths.ancestors(F.col(key), root)))


def size_tree(files: DataFrame, dirs: DataFrame, root: str) -> DataFrame:
    """Own and cumulative size and number of files of each folder; sums of summary folders count there."""
    own = counted(files).where(~F.col("is_link")).groupBy("dir_key").agg(F.sum(real_size()).alias("size"), F.count("*").alias("files"))
    own = own.unionByName(dirs.where("mode = 'summary' and not is_link").select("dir_key", F.col("summary_size").alias("size"), F.col("summary_files").alias("files")))
    own = own.groupBy("dir_key").agg(F.sum("size").alias("size"), F.sum("files").alias("files"))
    # folders were summed before they fan out to their ancestors
    total = to_ancestors(own, root).groupBy(F.col("ancestor").alias("dir_key")).agg(F.sum("size").alias("total_size"), F.sum("files").alias("total_files"))
    out = dirs.select("dir_key", "parent_key", "is_link").join(own, "dir_key", "left").join(total, "dir_key", "left")
    return out.select("dir_key", "parent_key", "is_link", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "files", "total_size", "total_files")))


def top_dirs(tree: DataFrame, root: str, n: int = 50) -> DataFrame:
    some = tree.where((F.col("dir_key") != root) & ~F.col("is_link"))
    return some.select("dir_key", "total_size", "total_files").orderBy(F.desc("total_size"), "dir_key").limit(n)


def locally_complete(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """``dirs`` with ``known`` entries and ``local``: fully listed, no link, no error, all entries known."""
    known = files.select("dir_key").unionAll(dirs.where("parent_key is not null").select("parent_key")).groupBy("dir_key").agg(F.count("*").alias("known"))
    out = dirs.join(known, "dir_key", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    return out.withColumn("local", (F.col("mode") == "full") & ~F.col("is_link") & ~F.col("read_error") & (F.col("direct_entries") == F.col("known")))


def subtree_stats(files: DataFrame, dirs: DataFrame, root: str, **flags: Column) -> DataFrame:
    """Of each folder's subtree: files, bytes, newest time, cloud, link, complete (all folders are), empty (no files, complete).

    ``flags`` are conditions on a folder's row of ``dirs``; each becomes a column that says whether any folder of the subtree meets it.
    """
    f = files.groupBy("dir_key").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("newest"), F.bool_or("cloud_only").alias("cloud"), F.bool_or("is_link").alias("link")
    )
    d = locally_complete(files, dirs).select("dir_key", "is_link", "local", *(c.alias(k) for k, c in flags.items())).join(f, "dir_key", "left")
    each = d.select(
        "dir_key", "local", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "newest",
        F.coalesce("cloud", F.lit(False)).alias("cloud"), (F.col("is_link") | F.coalesce("link", F.lit(False))).alias("link"), *flags,
    )
    out = to_ancestors(each, root).groupBy(F.col("ancestor").alias("dir_key")).agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.max("newest").alias("newest"), F.bool_or("cloud").alias("cloud"),
        F.bool_or("link").alias("link"), F.bool_and("local").alias("complete"), *(F.bool_or(k).alias(k) for k in flags),
    )
    return out.withColumn("empty", F.col("complete") & (F.col("files") == 0)).join(dirs.select("dir_key"), "dir_key", "left_semi")


def structure_issues(files: DataFrame, dirs: DataFrame, root: str, max_depth: int = 8, huge: int = 1000) -> DataFrame:
    """``dir_key, issue``: empty, single_file, too_deep, huge; nothing for links, summary folders and folders with an error."""
    f = files.groupBy("dir_key").agg(F.count("*").alias("_files"))
    c = dirs.where("parent_key is not null").groupBy(F.col("parent_key").alias("dir_key")).agg(F.count("*").alias("_dirs"))
    facts = dirs.where("mode = 'full' and not is_link and not read_error").join(f, "dir_key", "left").join(c, "dir_key", "left")
    n, e = F.coalesce("_files", F.lit(0)), F.coalesce("_files", F.lit(0)) + F.coalesce("_dirs", F.lit(0))
    level = paths.depth(F.col("dir_key")) - root.count("/")
    found = [("empty", e == 0), ("single_file", (e == 1) & (n == 1)), ("too_deep", level > max_depth), ("huge", e > huge)]
    issues = F.filter(F.array(*(F.when(k, name) for name, k in found)), lambda x: x.isNotNull())
    return facts.select("dir_key", F.explode(issues).alias("issue"))


def content(files: DataFrame) -> DataFrame:
    """Files that count for comparing folders."""
    return files.where(~F.col("name").rlike(names.JUNK_NAMES) & (F.lower("name") != "desktop.ini"))


def fingerprints(files: DataFrame, dirs: DataFrame, root: str) -> DataFrame:
    """``dir_key, fingerprint, files, bytes`` of folders below the root that can be compared and hold data.

    A folder's print covers (relative path, size, hash) of all files below it:
    128 bits that don't depend on order (two sums of keyed hashes), so that it
    is a partial aggregate over ancestors and no list is collected. Folders that
    are not complete, or hold cloud files, links or files without a hash, have
    none.
    """
    some = content(files)
    bad = F.col("cloud_only") | F.col("is_link") | ((F.col("size") > 0) & F.col("full_hash").isNull())
    rows = to_ancestors(some.select("dir_key", "path_key", "size", "full_hash", bad.alias("bad")), root)
    line = F.concat_ws("|", F.expr("substr(path_key, length(ancestor) + 1)"), F.col("size").cast("string"), F.when(F.col("size") == 0, "0").otherwise(F.col("full_hash")))
    key = F.md5(line)
    part = lambda at: F.conv(F.substring(key, at, 14), 16, 10).cast("decimal(38,0)")
    found = rows.groupBy(F.col("ancestor").alias("dir_key")).agg(
        F.sum(part(1)).alias("_a"), F.sum(part(15)).alias("_b"), F.count("*").alias("files"), F.sum("size").alias("bytes"), F.bool_or("bad").alias("_bad")
    )
    whole = subtree_stats(files, dirs, root).where("complete").select("dir_key")
    return found.join(whole, "dir_key", "left_semi").where(~F.col("_bad") & (F.col("bytes") > 0) & (F.col("dir_key") != root)).select(
        "dir_key", F.md5(F.concat_ws(":", F.col("_a").cast("string"), F.col("_b").cast("string"), F.col("files").cast("string"))).alias("fingerprint"), "files", "bytes"
    )


def folder_groups(prints: DataFrame) -> DataFrame:
    """Folders with an equal one."""
    groups = prints.groupBy("fingerprint").agg(F.count("*").alias("folders")).where("folders > 1")
    return prints.join(groups, "fingerprint")


def top_level_groups(groups: DataFrame, root: str) -> DataFrame:
    """Groups but those whose members all lie in a larger equal folder: a folder counts if its parent has no equal."""
    inner = groups.select(F.col("dir_key").alias("p"))
    parent = F.regexp_extract("dir_key", "^(.*/)[^/]+/$", 1)
    tops = groups.join(inner, parent == F.col("p"), "left_anti").groupBy("fingerprint").agg(F.count("*").alias("tops"))
    return groups.join(tops, "fingerprint")


def folder_dups(groups: DataFrame) -> DataFrame:
    """``fingerprint, folders, files, bytes, reclaimable, first_folder`` of each group."""
    return groups.groupBy("fingerprint").agg(
        F.count("*").alias("folders"), F.max("files").alias("files"), F.max("bytes").alias("bytes"),
        (F.max("bytes") * (F.count("*") - 1)).alias("reclaimable"), F.min("dir_key").alias("first_folder"),
    )


def partial_pairs(files: DataFrame, exact: DataFrame, least: float = 0.8, most: int = 32) -> DataFrame:
    """Pairs of folders (direct contents) that share at least ``least`` of the smaller one's bytes and are not equal.

    For each content the smaller of its two counts is shared. Contents that more
    than ``most`` folders hold say nothing about a pair and make none (part of
    the operator's definition).
    """
    some = content(files).where("size > 0 and full_hash is not null and not is_link and not cloud_only")
    held = some.groupBy("dir_key", "size", "full_hash").agg(F.count("*").alias("n"))
    few = held.groupBy("size", "full_hash").agg(F.count("*").alias("folders")).where((F.col("folders") > 1) & (F.col("folders") <= most)).select("size", "full_hash")
    bytes_ = held.groupBy("dir_key").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"))
    held = held.join(few, ["size", "full_hash"], "left_semi")
    a = held.select("size", "full_hash", F.col("dir_key").alias("a"), F.col("n").alias("na"))
    b = held.select("size", "full_hash", F.col("dir_key").alias("b"), F.col("n").alias("nb"))
    shared = a.join(b, ["size", "full_hash"]).where("a < b").groupBy("a", "b").agg(F.sum(F.least("na", "nb") * F.col("size")).alias("shared"))
    out = shared.join(bytes_.select(F.col("dir_key").alias("a"), F.col("bytes").alias("bytes_a")), "a").join(bytes_.select(F.col("dir_key").alias("b"), F.col("bytes").alias("bytes_b")), "b")
    out = out.withColumn("ratio", F.round(F.col("shared") / F.least("bytes_a", "bytes_b"), 6)).where(F.col("ratio") >= least)
    x, y = exact.select(F.col("dir_key").alias("a"), F.col("fingerprint").alias("fa")), exact.select(F.col("dir_key").alias("b"), F.col("fingerprint").alias("fb"))
    return out.join(x, "a", "left").join(y, "b", "left").where("fa is null or fb is null or fa <> fb").select("a", "b", "shared", "bytes_a", "bytes_b", "ratio")


def partial_tree_pairs(files: DataFrame, exact: DataFrame, root: str, least: float = 0.8, most: int = 32, tool_dir: str = ".quarantine") -> DataFrame:
    """Topmost pairs of folders that share at least ``least`` of the smaller one's bytes, all below them counted, and are not equal.

    Two folders that hold a content are a pair, and so are their parents, level
    by level, until one is the root or holds the other; folders in ``tool_dir``
    make none. For each content the smaller of the two counts below is shared.
    A pair whose parents are such a pair too is left out. Contents of more than
    ``most`` files say nothing about a pair.
    """
    some = content(files).where("size > 0")
    key = ["size", "full_hash"]
    up = F.filter(F.reverse(paths.ancestors(F.col("dir_key"), root)), lambda x: x != root)
    own = some.groupBy("dir_key").agg(F.sum("size").alias("size"))
    bytes_ = settle(to_ancestors(own, root).groupBy("ancestor").agg(F.sum("size").alias("bytes")))
    held = some.where("full_hash is not null and not is_link and not cloud_only").groupBy("dir_key", *key).agg(F.count("*").alias("n"))
    few = held.groupBy(*key).agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most)).select(*key)
    held = settle(held.join(few, key, "left_semi").withColumn("up", up))
    below = held.select(*key, "n", F.explode("up").alias("dir_key")).groupBy(*key, "dir_key").agg(F.sum("n").alias("n"))
    sides = held.where(~F.contains("dir_key", F.lit(f"/{tool_dir}/")))
    a, b = sides.select(*key, F.col("dir_key").alias("a"), F.col("up").alias("ua")), sides.select(*key, F.col("dir_key").alias("b"), F.col("up").alias("ub"))
    level = F.explode(F.filter(F.arrays_zip("ua", "ub"), lambda x: x["ua"].isNotNull() & x["ub"].isNotNull() & ~F.startswith(x["ua"], x["ub"]) & ~F.startswith(x["ub"], x["ua"])))
    pairs = a.join(b, key).where("a < b").select(*key, level.alias("x")).select(*key, F.least("x.ua", "x.ub").alias("a"), F.greatest("x.ua", "x.ub").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(below.select(*key, F.col("dir_key").alias(side), F.col("n").alias(f"n{side}")), [*key, side])
    out = pairs.groupBy("a", "b").agg(F.sum(F.least("na", "nb") * F.col("size")).alias("shared"))
    for side in ("a", "b"):
        out = out.join(bytes_.select(F.col("ancestor").alias(side), F.col("bytes").alias(f"bytes_{side}")), side)
        out = out.join(exact.select(F.col("dir_key").alias(side), F.col("fingerprint").alias(f"f{side}")), side, "left")
    out = out.where((F.col("shared") / F.least("bytes_a", "bytes_b") >= least) & F.expr("fa is null or fb is null or fa <> fb"))
    out = settle(out.select("a", "b", "shared", "bytes_a", "bytes_b", F.round(F.col("shared") / F.least("bytes_a", "bytes_b"), 6).alias("ratio")))
    # two folders of one parent have the pair (parent, parent) above them, which is none
    pa, pb = (F.regexp_extract(x, "^(.*/)[^/]+/$", 1) for x in ("a", "b"))
    above = out.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return out.join(above, (F.least(pa, pb) == F.col("_a")) & (F.greatest(pa, pb) == F.col("_b")), "left_anti")


def template_check(dirs: DataFrame, files: DataFrame, root: str, level1: str, required: list[str]) -> DataFrame:
    """Deviations from a target structure: ``path, kind``.

    ``level1`` is the pattern that folders below the root must have,
    ``required`` are the folders that must be in each of them.
    """
    first = dirs.where((F.col("parent_key") == root) & ~F.col("is_link"))
    name = paths.name_of(F.col("dir_key"))
    odd = first.where(~name.rlike(level1)).select(F.col("dir_key").alias("path"), F.lit("unexpected_folder").alias("kind"))
    loose = files.where(F.col("dir_key") == root).select("path", F.lit("file_in_root").alias("kind"))
    want = first.where(name.rlike(level1)).select(F.explode(F.array(*(F.concat("dir_key", F.lit(f"{r}/")) for r in required))).alias("path"))
    missing = want.join(dirs.select(F.col("dir_key").alias("path")), "path", "left_anti").select("path", F.lit("missing_folder").alias("kind"))
    return odd.unionAll(loose).unionAll(missing)


def meta_fingerprints(files: DataFrame, root: str) -> DataFrame:
    """``dir_key, meta``: a print of (relative path, size, time) of all files below, without reading contents."""
    rows = to_ancestors(files.select("dir_key", "path_key", "size", "mtime"), root)
    key = F.md5(F.concat_ws("|", F.expr("substr(path_key, length(ancestor) + 1)"), F.col("size").cast("string"), F.col("mtime").cast("string")))
    part = F.conv(F.substring(key, 1, 14), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(F.col("ancestor").alias("dir_key")).agg(F.sum(part).cast("string").alias("meta"), F.count("*").alias("files"))
