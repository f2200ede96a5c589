"""Folding journals of runs into state (AG26, AG33, SM04-SM06, FL14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Kinds of entries that open, close, fail or undo an operation.
OPEN, DONE, FAIL, UNDONE = ["intent", "intent_remove_dir"], ["done"], ["fail", "skip"], ["undo_done"]


def operations(journal: DataFrame) -> DataFrame:
    """State of each (run, action): marks count only with an intent at or before them; a later intent starts anew."""
    opened = journal.where(F.col("kind").isin(OPEN)).groupBy("run", "action").agg(F.max("seq").alias("opened"), F.max_by("bytes", "seq").alias("bytes"))
    marks = journal.where(F.col("kind").isin(DONE + FAIL + UNDONE)).select("run", "action", "seq", "kind")
    after = opened.join(marks, ["run", "action"], "left").where("seq is null or seq > opened")
    state = after.groupBy("run", "action").agg(
        F.max("bytes").alias("bytes"),
        F.coalesce(F.bool_or(F.col("kind").isin(DONE)), F.lit(False)).alias("done"),
        F.coalesce(F.bool_or(F.col("kind").isin(FAIL)), F.lit(False)).alias("failed"),
        F.coalesce(F.bool_or(F.col("kind").isin(UNDONE)), F.lit(False)).alias("undone"),
    )
    rest = opened.select("run", "action", "bytes").join(state.select("run", "action"), ["run", "action"], "left_anti")
    no = F.lit(False)
    return state.unionByName(rest.select("run", "action", "bytes", no.alias("done"), no.alias("failed"), no.alias("undone")))


def run_summary(journal: DataFrame, keep_days: int = 30) -> DataFrame:
    """One row for each run: counts, bytes still in quarantine, status, expiry (seconds)."""
    ops = operations(journal)
    executed = F.col("done") & ~F.col("failed")
    folded = ops.groupBy("run").agg(
        F.count_if(executed).alias("executed"), F.count_if(F.col("failed")).alias("failed"), F.count_if(executed & F.col("undone")).alias("undone"),
        F.coalesce(F.sum(F.when(executed & ~F.col("undone"), F.col("bytes"))), F.lit(0)).cast("long").alias("held_bytes"),
    )
    runs = journal.groupBy("run").agg(
        F.min("stamp").alias("started"), F.bool_or(F.col("kind") == "purged").alias("_purged"), F.max(F.when(F.col("kind") == "undo_end", F.col("seq"))).alias("_ue"),
        F.max(F.when(F.col("kind") == "undo_start", F.col("seq"))).alias("_us"), F.bool_or(F.col("kind") == "run_end").alias("_end"),
    )
    status = (
        F.when(F.col("_purged"), "purged")
        .when(F.col("_ue").isNotNull() & (F.col("_us").isNull() | (F.col("_ue") > F.col("_us"))), "undone")
        .when(F.col("_us").isNotNull(), "partially_undone")
        .when(F.col("_end") & (F.coalesce(F.col("failed"), F.lit(0)) == 0), "complete")
        .when(F.col("_end"), "partial")
        .otherwise("incomplete")
    )
    out = runs.join(folded, "run", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("executed", "failed", "undone", "held_bytes")]
    return out.select("run", status.alias("status"), *numbers, "started", (F.col("started") + keep_days * 86_400).alias("expires"))


def expired(summary: DataFrame, now: int) -> DataFrame:
    """Runs whose quarantine may go."""
    return summary.where((F.col("expires") <= now) & (F.col("status") != "purged") & (F.col("held_bytes") > 0))


def quarantine(journal: DataFrame) -> DataFrame:
    """Items still in quarantine: executed, not failed, not undone, of runs that were not purged."""
    live = run_summary(journal).where("status <> 'purged'").select("run", "expires")
    return operations(journal).where("done and not failed and not undone").join(live, "run").select("run", "action", "bytes", "expires")


def quarantine_totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.min("expires").alias("first_expiry"))


def visible(items: DataFrame, run: int | None = None, text: str = "") -> DataFrame:
    """Items of one run, or whose action's text holds ``text``."""
    out = items if run is None else items.where(F.col("run") == run)
    return out.where(F.contains(F.lower(F.col("action").cast("string")), F.lit(text.lower()))) if text else out
