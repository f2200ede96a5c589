"""Snapshots over time (JN06-JN08, WN06-WN07, AG32, AG35, PL11, SNK06, SM07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def series(snapshots: DataFrame, folder_metrics: DataFrame, root_key: str, folder: str = "", n: int = 52) -> DataFrame:
    """The newest ``n`` points of a folder in order of time."""
    some = snapshots.where(F.col("root_key") == root_key).join(folder_metrics.where(F.col("folder") == folder), "snapshot_id")
    return some.select("snapshot_id", "taken_at", "score").orderBy(F.desc("snapshot_id")).limit(n).orderBy("snapshot_id")


def folders(snapshots: DataFrame, folder_metrics: DataFrame, root_key: str) -> DataFrame:
    return snapshots.where(F.col("root_key") == root_key).join(folder_metrics, "snapshot_id").select("folder").distinct()


def comparable(snapshots: DataFrame) -> DataFrame:
    """For each snapshot the latest one before it with equal configuration (``full``), else the latest of the root (``limited``)."""
    by_root = Window.partitionBy("root_key").orderBy("snapshot_id")
    by_config = Window.partitionBy("root_key", "config_fp", "metrics_version").orderBy("snapshot_id")
    full, any_ = F.lag("snapshot_id").over(by_config), F.lag("snapshot_id").over(by_root)
    out = snapshots.select("snapshot_id", "root_key", full.alias("_f"), any_.alias("_a"))
    return out.select("snapshot_id", "root_key", F.coalesce("_f", "_a").alias("previous_id"), F.when(F.col("_f").isNotNull(), "full").when(F.col("_a").isNotNull(), "limited").alias("comparison"))


def deltas(snapshots: DataFrame, folder_metrics: DataFrame) -> DataFrame:
    """Each folder's score and size against the snapshot it is compared with; folders are matched by name."""
    now = folder_metrics.join(comparable(snapshots), "snapshot_id")
    before = folder_metrics.select(F.col("snapshot_id").alias("previous_id"), "folder", F.col("score").alias("score_before"), F.col("size").alias("size_before"))
    out = now.join(before, ["previous_id", "folder"], "left")
    return out.select("snapshot_id", "folder", "comparison", "score", (F.col("score") - F.col("score_before")).alias("score_delta"), (F.col("size") - F.col("size_before")).alias("size_delta"))


def roots(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("root_key").agg(F.max("root_path").alias("root_path"), F.count("*").alias("snapshots"))


def trailing_failures(runs: DataFrame) -> DataFrame:
    """Runs of each profile after its last one that did not fail."""
    good = runs.where("status <> 'failed'").groupBy("profile").agg(F.max("seq").alias("_last"))
    out = runs.join(good, "profile", "left").where("_last is null or seq > _last")
    return out.select("profile", "seq", "status")


def notifications(runs: DataFrame, drop: int = 5, below: int = 60) -> DataFrame:
    """``profile, seq, reasons`` (comma-joined keys) of the runs that call for a message (PL11).

    A failed run or one without its root always does, a skipped one only right after another of its profile. A run that
    ended tells of a score that fell by ``drop`` (0: never) or is below ``below``, plans that are ready, plans that
    failed, and more files to review than in the profile's run before.
    """
    order = Window.partitionBy("profile").orderBy("seq")
    out = runs.withColumn("_status", F.lag("status").over(order)).withColumn("_review", F.lag("review").over(order))
    c, no = F.col, F.lit(False)
    ended = c("status").isin("ok", "partial")
    found = [
        ("root_missing", c("status") == "root_missing"),
        ("failed", c("status") == "failed"),
        ("skipped_again", (c("status") == "skipped_locked") & (c("_status") == "skipped_locked")),
        ("score_drop", ended & F.lit(drop > 0) & (c("score_delta") <= -drop)),
        ("score_low", ended & (c("score") < below)),
        ("plans_ready", ended & (c("plans") > 0)),
        ("plans_failed", ended & (c("failed_plans") > 0)),
        ("new_review", ended & (F.coalesce("review", F.lit(0)) > F.coalesce("_review", F.lit(0)))),
    ]
    reasons = F.concat_ws(",", *(F.when(F.coalesce(holds, no), key) for key, holds in found))
    return out.select("profile", "seq", reasons.alias("reasons")).where("reasons <> ''")


def append(snapshots: DataFrame, folder_metrics: DataFrame, path: str) -> None:
    """Adds snapshots and their folders' metrics to the history at ``path`` (SNK06, SM07).

    Folders are written first and count only once their snapshot is there: a reader never sees half a snapshot, and
    what a broken run left has no snapshot.
    """
    folder_metrics.write.mode("append").parquet(f"{path}/folders")
    snapshots.write.mode("append").parquet(f"{path}/snapshots")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(snapshots, folder metrics) of a history; metrics without a snapshot are left out."""
    snapshots = spark.read.parquet(f"{path}/snapshots")
    return snapshots, spark.read.parquet(f"{path}/folders").join(snapshots.select("snapshot_id"), "snapshot_id", "left_semi")
