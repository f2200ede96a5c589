"""State that outlives a scan: merges, prunes, caches (SNK01-SNK03, JN03-JN05, SF23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import is_under


def merge_latest(*parts: DataFrame, first: str | None = None) -> DataFrame:
    """The row of the greatest generation of each path key; later parts win ties, within a part the smallest ``first`` (a number, such as an id)."""
    every = parts[0].withColumn("_part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("_part", F.lit(i)))
    names = [c for c in parts[0].columns if c != "path_key"]
    row = F.struct("generation", "_part", *([(-F.col(first)).alias("_first")] if first else []), *(c for c in names if c != "generation"))
    return every.groupBy("path_key").agg(F.max(row).alias("r")).select("path_key", *(F.col(f"r.{c}").alias(c) for c in names))


def prune(files: DataFrame, root: str, generation: int, complete: bool = True) -> DataFrame:
    """Rows below ``root`` of older generations go, if the scan was complete."""
    return files.where(~(is_under(F.col("path_key"), F.lit(root)) & (F.col("generation") < generation))) if complete else files


def remove_root(files: DataFrame, root: str, others: list[str]) -> DataFrame:
    """Rows below ``root`` go, but those below another root."""
    kept = F.lit(False)
    for other in others:
        kept = kept | is_under(F.col("path_key"), F.lit(other))
    return files.where(~is_under(F.col("path_key"), F.lit(root)) | kept)


def cache_prune(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows whose file is still there."""
    return cache.join(files.select("path_key"), "path_key", "left_semi")


def carry_over(now: DataFrame, before: DataFrame) -> DataFrame:
    """``now`` with the hash of ``before`` where size and time are unchanged and the hash was sound."""
    sound = before.where("hash_status is null or hash_status = 'ok'").select("path_key", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("full_hash").alias("_hash"))
    out = now.drop("full_hash").join(sound, "path_key", "left")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    return out.withColumn("full_hash", F.when(same, F.col("_hash"))).drop("_size", "_mtime", "_hash")


def cache_state(files: DataFrame, cache: DataFrame, fingerprint: str, version: int) -> DataFrame:
    """``path_key, state``: valid, reassign (definitions changed), reextract (file or extractor changed), new."""
    c = cache.select("path_key", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "extractor_version", "defs_fingerprint")
    out = files.select("path_key", "size", "mtime").join(c, "path_key", "left")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")) & (F.col("extractor_version") == version)
    state = F.when(F.col("_size").isNull(), "new").when(~same, "reextract").when(F.col("defs_fingerprint") != fingerprint, "reassign").otherwise("valid")
    return out.select("path_key", state.alias("state"))


def cache_store(cache: DataFrame, records: DataFrame) -> DataFrame:
    """The content cache after a block of records (SNK07): of each ``path_key`` the record that was classified last, in full."""
    both = cache.unionByName(records)
    last = F.max_by(F.struct(*both.columns), F.struct("classified_at", "extractor_version"))
    return both.groupBy("path_key").agg(last.alias("r")).select("r.*")
