"""Health metrics of folders, scores and deductions (AG12-AG17, SF17, TK02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import junk, names, paths
from .dups import attribution
from .files import counted, real_size
from .tree import structure_issues

#: Weights of the parts of the score.
WEIGHTS = {"junk": 20, "dups": 25, "problems": 20, "structure": 20, "versions": 15, "template": 20}
TOP_FOLDERS = 200
ARCHIVE = "_archiv/"
NUMBERS = [
    "size", "local_bytes", "files", "dirs", "cloud_files", "cloud_bytes", "junk_files", "junk_bytes", "dup_groups", "dup_wasted", "problem_files",
    "empty_dirs", "structure_issues", "version_excess", "old_bytes",
]
TEMPLATE = ["template_checked", "template_deviations"]


def metrics(
    files: DataFrame, dirs: DataFrame, root: str, now: int, hosts: list[str], old_days: int = 365,
    active: list[junk.Category] | None = None, template: DataFrame | None = None,
) -> DataFrame:
    """Metrics of each level-1 folder (``''``: the root itself and the files in it).

    Sums of summary folders count as files and bytes; files of the archive are neither old nor versions; files that
    are only in the cloud are no junk. ``problems_by_kind`` is a map. ``template`` is ``template.by_bucket``: with it,
    folders without anything checked have 0, without it both columns are null.

    Every measure is a partial sum by folder, and all of them meet in one aggregate: no join on the folder.
    """
    active = junk.categories() if active is None else active
    folder = paths.bucket_of(F.col("dir_key"), root).alias("folder")
    archived = paths.is_under(F.col("dir_key"), F.lit(root + ARCHIVE))
    size, cloud, zero = real_size(), F.col("cloud_only"), F.lit(0)
    kind = junk.match(F.col("name"), F.col("dir_key"), active)
    is_junk = ~cloud & F.coalesce(kind.isNotNull() & ~junk.too_recent(kind, F.col("mtime"), now, active), F.lit(False))
    old = names.age_days(F.col("mtime"), now) > old_days
    facts = counted(files).where(~F.col("is_link")).select(
        folder, size.alias("size"), "cloud_only", is_junk.alias("_junk"), names.file_problems(F.col("name"), F.col("path"), F.col("size"), hosts).alias("_bad"), (old & ~archived).alias("_old")
    )
    by = lambda cond: F.sum(F.when(cond, F.col("size")).otherwise(zero))
    main = facts.groupBy("folder").agg(
        F.sum("size").alias("size"), by(~cloud).alias("local_bytes"), F.count("*").alias("files"), F.count_if(cloud).alias("cloud_files"), by(cloud).alias("cloud_bytes"),
        F.count_if("_junk").alias("junk_files"), by(F.col("_junk")).alias("junk_bytes"), F.count_if(F.size("_bad") > 0).alias("problem_files"), by(F.col("_old")).alias("old_bytes"),
        *(F.count_if(F.array_contains("_bad", k)).alias(f"_{k}") for k in names.FILE_PROBLEMS),
    )
    summary = F.col("mode") == "summary"
    tree = dirs.groupBy(folder).agg(
        F.count("*").alias("dirs"), *(F.sum(F.when(summary, F.col(c)).otherwise(zero)).alias(n) for c, n in (("summary_files", "files"), ("summary_size", "size"), ("summary_size", "local_bytes")))
    )
    issues = structure_issues(files, dirs, root).groupBy(folder).agg(F.count("*").alias("structure_issues"), F.count_if(F.col("issue") == "empty").alias("empty_dirs"))
    versions = version_excess(files, root)
    dup = attribution(files, paths.bucket_of(F.col("path"), root)).withColumnRenamed("bucket", "folder")
    parts = [main, tree, issues, versions, dup]
    if template is not None:
        parts.append(template.select(F.col("bucket").alias("folder"), F.col("checked").alias("template_checked"), F.col("deviations").alias("template_deviations")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    kinds = [f"_{k}" for k in names.FILE_PROBLEMS]
    wide = every.groupBy("folder").agg(*(F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in every.columns if c != "folder"))
    found = F.map_filter(F.map_from_arrays(F.array(*(F.lit(k[1:]) for k in kinds)), F.array(*kinds)), lambda _, n: n > 0)
    checks = [F.col(c) if template is not None else F.lit(None).cast("long").alias(c) for c in TEMPLATE]
    return wide.select("folder", *NUMBERS, *checks, found.alias("problems_by_kind"))


def version_excess(files: DataFrame, root: str) -> DataFrame:
    """Of each level-1 folder: files beyond the first of each group of similar names of one folder, the archive left out (AG17)."""
    stem, ext = names.split_stem(F.col("name"))
    some = files.where(~F.col("is_link") & ~paths.is_under(F.col("dir_key"), F.lit(root + ARCHIVE)))
    alike = some.groupBy("dir_key", names.normalize_name(stem).alias("normal"), ext.alias("ext")).agg(F.count("*").alias("n"))
    return alike.groupBy(paths.bucket_of(F.col("dir_key"), root).alias("folder")).agg(F.sum(F.col("n") - 1).alias("version_excess"))


def problems_by_kind(files: DataFrame, root: str, hosts: list[str]) -> DataFrame:
    some = files.where(~F.col("is_link")).select(paths.bucket_of(F.col("path"), root).alias("folder"), F.explode(names.file_problems(F.col("name"), F.col("path"), F.col("size"), hosts)).alias("kind"))
    return some.groupBy("folder", "kind").agg(F.count("*").alias("files"))


def _numbers(folders: DataFrame) -> list[str]:
    return [f.name for f in folders.schema.fields if f.name != "folder" and f.dataType.simpleString() == "bigint"]


def _sum(name: str) -> Column:
    """Nulls stay null only where no template was checked at all."""
    return F.sum(name).cast("long").alias(name) if name in TEMPLATE else F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)


def totals(folders: DataFrame, dup_groups: DataFrame) -> DataFrame:
    """The root's row: the sum of all folders; groups of duplicates count once however many folders they touch."""
    numbers = [c for c in _numbers(folders) if c != "dup_groups"]
    return folders.agg(*(_sum(c) for c in numbers)).join(dup_groups.select(F.col("group_count").alias("dup_groups")))


def largest_and_rest(folders: DataFrame, n: int = TOP_FOLDERS) -> DataFrame:
    """The ``n`` largest folders and one row ``*`` for the others (AG15); what lies in the root itself is no folder."""
    some = folders.where("folder <> ''")
    top = some.select("folder", F.col("size").alias("_s")).orderBy(F.desc("_s"), "folder").limit(n).select("folder", F.lit(True).alias("_top"))
    named = some.join(top, "folder", "left").withColumn("folder", F.when(F.col("_top"), F.col("folder")).otherwise("*")).drop("_top")
    return named.groupBy("folder").agg(*(_sum(c) for c in _numbers(folders)))


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def scores(folders: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """``folder``, the parts' values, the score and each part's deduction.

    A part without weight is null, and so is the template's where none was checked; the score is the weighted mean
    of the others, 100 if there are none. A folder without files has full value in each part. Deductions of half a
    point and more are given, rounded to a tenth; smaller ones are 0.
    """
    c = F.col
    bad = {
        "junk": F.greatest(_ratio(c("junk_files") * 1000, c("files")) / 50, _ratio(c("junk_bytes"), c("size")) / 0.10),
        "dups": _ratio(c("dup_wasted"), c("local_bytes")) / 0.25,
        "problems": _ratio(c("problem_files") * 1000, c("files")) / 50,
        "structure": _ratio(c("structure_issues") * 100, c("dirs")) / 30,
        "versions": _ratio(c("version_excess") * 1000, c("files")) / 50,
        "template": _ratio(F.coalesce("template_deviations", F.lit(0)), c("template_checked")) / 0.30,
    }
    value, weight = {}, {}
    for k, b in bad.items():
        applies = c("template_checked").isNotNull() if k == "template" else F.lit(True)
        full = F.when(c("files") == 0, 100.0).otherwise(100 * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), b))))
        value[k] = F.when(applies, full) if weights.get(k, 0) else F.lit(None).cast("double")
        weight[k] = F.when(applies, F.lit(weights.get(k, 0))).otherwise(0)
    parts = folders.select("folder", *(value[k].alias(k) for k in bad), *(weight[k].alias(f"_{k}") for k in bad))
    whole, total = F.lit(0), F.lit(0.0)
    for k in bad:
        whole, total = whole + c(f"_{k}"), total + F.coalesce(c(k), F.lit(0.0)) * c(f"_{k}")
    lost = {k: F.coalesce(c(f"_{k}") / whole * (100 - c(k)), F.lit(0.0)) for k in bad}
    return parts.select(
        "folder", *(F.round(c(k), 4).alias(k) for k in bad), F.when(whole > 0, F.round(total / whole, 0)).otherwise(100).cast("int").alias("score"),
        *(F.when(lost[k] >= 0.5, F.round(lost[k], 1)).otherwise(0.0).alias(f"{k}_deduction") for k in bad),
    )


def top_deductions(scored: DataFrame, n: int = 3) -> DataFrame:
    """``folder, place, part, points``: the ``n`` largest deductions of each folder (TK02), in the parts' order where they are equal."""
    parts = [p for p in WEIGHTS if f"{p}_deduction" in scored.columns]
    # at most six entries a folder: sorted within its row
    each = F.array(*(F.struct((-F.col(f"{p}_deduction")).alias("points"), F.lit(i).alias("i"), F.lit(p).alias("part")) for i, p in enumerate(parts)))
    best = F.slice(F.array_sort(F.filter(each, lambda x: x["points"] < 0)), 1, n)
    return scored.select("folder", F.posexplode(best).alias("place", "_d")).select("folder", (F.col("place") + 1).alias("place"), F.col("_d.part").alias("part"), (-F.col("_d.points")).alias("points"))
