"""A plan as a list to look through: filter, order, sums, selection (FL13, TK04, AG28, AG34, ST04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths

#: Order of the kinds of actions in a sorted list.
RANK = {"quarantine": 0, "move": 1, "remove-dir": 2}


def rows(plan: DataFrame, files: DataFrame) -> DataFrame:
    """``plan`` with ``size`` and ``mtime`` of its files, and ``rule`` (null where the plan has none); skips have size 0 and no time."""
    out = plan if "rule" in plan.columns else plan.withColumn("rule", F.lit(None).cast("string"))
    acts = F.col("action") != "skip"
    out = out.join(files.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m")), "path", "left")
    return out.withColumns({"size": F.when(acts, F.coalesce("_s", F.lit(0))).otherwise(0), "mtime": F.when(acts, F.coalesce("_m", F.lit(0))).otherwise(0)}).drop("_s", "_m")


def matching(
    rows: DataFrame, skipped: bool = False, action: str | None = None, rule: str | None = None, folder: str | None = None,
    min_size: int | None = None, max_size: int | None = None, text: str = "",
) -> DataFrame:
    """Actions (or skips) of one kind, rule, folder and range of sizes, with ``text`` in path, target, reason or rule, whatever its case."""
    keep: Column = (F.col("action") == "skip") == F.lit(skipped)
    for column, value in (("action", action), ("rule", rule)):
        if value is not None:
            keep = keep & F.coalesce(F.col(column) == value, F.lit(False))
    if folder is not None:
        keep = keep & paths.is_under(F.lower("path"), F.lit(folder.lower()))
    if min_size is not None:
        keep = keep & (F.col("size") >= min_size)
    if max_size is not None:
        keep = keep & (F.col("size") <= max_size)
    if text.strip():
        hay = F.lower(F.concat_ws("\n", "path", "target", "reason", "rule"))
        keep = keep & F.contains(hay, F.lit(text.strip().lower()))
    return rows.where(keep)


def ordered(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """By action, source, target, size, reason or age; equal rows in order of their paths. No value comes first."""
    key = {
        "action": F.coalesce(*(F.when(F.col("action") == k, F.lit(i)) for k, i in RANK.items())), "source": F.lower("path"), "target": F.col("target"),
        "size": F.col("size"), "reason": F.col("reason"), "age": F.col("mtime"),
    }[column]
    return rows.orderBy(key.asc_nulls_first() if ascending else key.desc_nulls_last(), "path")


def summary(rows: DataFrame, selected: Column) -> DataFrame:
    """One row: actions and bytes in all and selected, and how many of each kind are selected."""
    acts = rows.where("action <> 'skip'").withColumn("_on", F.coalesce(selected, F.lit(False)))
    on = F.col("_on")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return acts.agg(
        F.count_if(on).alias("selected"), total(F.when(on, F.col("size"))).alias("selected_bytes"), F.count("*").alias("total"), total("size").alias("total_bytes"),
        *(F.count_if(on & (F.col("action") == k)).alias(name) for k, name in (("quarantine", "quarantine"), ("move", "moves"), ("remove-dir", "remove_dirs"))),
    )


def deselect(rows: DataFrame, off: Column, root: str) -> DataFrame:
    """``rows`` with ``selected``: actions that meet ``off`` are not, nor are folders that move or go and hold one of them."""
    acts = rows.where("action <> 'skip'").withColumn("_off", F.coalesce(off, F.lit(False)))
    folder = F.regexp_extract(F.lower("path"), "^(.*/)[^/]+/?$", 1)
    holders = acts.where("_off").select(F.explode(paths.ancestors(folder, root)).alias("_k")).distinct()
    key = F.when(F.endswith("path", F.lit("/")), F.lower("path"))
    out = acts.withColumn("_key", key).join(holders.withColumn("_held", F.lit(True)), F.col("_key") == F.col("_k"), "left")
    return out.withColumn("selected", ~F.col("_off") & F.col("_held").isNull()).drop("_off", "_key", "_k", "_held")


def skips_by_reason(rows: DataFrame) -> DataFrame:
    """Skipped entries by reason."""
    return rows.where("action = 'skip'").groupBy("reason").agg(F.count("*").alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    """Actions and their bytes by kind of action and reason (AG28)."""
    return rows.where("action <> 'skip'").groupBy("action", "reason").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))
