"""What classification found, over an inventory and its content cache (AG24, AG25, TK02).

The cache has ``path_key, size, mtime, status, why, category, confidence, category2, confidence2, source, text_source,
fields, field_sources``; ``status`` is ok, unsupported, too_large or unreadable, ``why`` the reason of the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Category of pictures with places and cameras.
PHOTO = "foto"


def records(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that are no links, with their record and ``state``: cloud, new (none, or one of another size or time) or known."""
    known = cache.withColumnRenamed("size", "_size").withColumnRenamed("mtime", "_mtime").withColumn("_hit", F.lit(True))
    same = F.coalesce(F.col("_hit") & (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), F.lit(False))
    out = files.where(~F.col("is_link")).select("path", "path_key", "size", "mtime", "cloud_only").join(known, "path_key", "left")
    return out.withColumn("state", F.when(F.col("cloud_only"), "cloud").when(same, "known").otherwise("new")).drop("_size", "_mtime", "_hit")


def _known() -> Column:
    return F.col("state") == "known"


def needs_review(least: float) -> Column:
    return (F.col("status") == "ok") & F.col("category").isNotNull() & (F.col("confidence") < least)


def _by_model() -> Column:
    return (F.col("source") == "llm") | F.coalesce(F.exists(F.map_values("field_sources"), lambda v: v == "llm"), F.lit(False))


def _from_media() -> Column:
    return (F.col("text_source") == "none") & F.coalesce(F.exists(F.map_keys("fields"), lambda k: F.startswith(k, F.lit("exif.")) | F.startswith(k, F.lit("video."))), F.lit(False))


def totals(found: DataFrame, least: float = 0.8) -> DataFrame:
    """One row of counts: files by state, known ones by status, where their text came from, without a category, to review."""
    on = lambda cond: F.count_if(_known() & F.coalesce(cond, F.lit(False)))
    status = lambda x: on(F.col("status") == x)
    return found.agg(
        F.count("*").alias("files"), F.count_if(_known()).alias("classified"), F.count_if(F.col("state") == "cloud").alias("cloud_only"), F.count_if(F.col("state") == "new").alias("not_classified"),
        status("unsupported").alias("unsupported"), status("too_large").alias("too_large"), status("unreadable").alias("unreadable"), on(F.col("category").isNull()).alias("uncategorized"),
        on(F.col("text_source").isin("layer", "office")).alias("text"), on(F.col("text_source") == "ocr").alias("ocr"), on(_from_media()).alias("meta"), on(_by_model()).alias("llm"),
        on(needs_review(least)).alias("review"),
    )


def by_category(found: DataFrame) -> DataFrame:
    """``category, files, size, share, llm``: the share is of all classified files."""
    known = found.where(_known())
    whole = known.agg(F.greatest(F.count("*"), F.lit(1)).alias("_all"))
    grouped = known.where("category is not null").groupBy("category").agg(F.count("*").alias("files"), F.sum(F.greatest("size", F.lit(0))).cast("long").alias("size"), F.count_if(F.col("source") == "llm").alias("llm"))
    # one row
    return grouped.join(whole).select("category", "files", "size", F.round(F.col("files") / F.col("_all"), 6).alias("share"), "llm")


def unreadable(found: DataFrame) -> DataFrame:
    """Reasons why files could not be read."""
    return found.where(_known() & (F.col("status") == "unreadable")).groupBy("why").agg(F.count("*").alias("files"))


def places_and_cameras(found: DataFrame, n: int = 10) -> DataFrame:
    """``kind, label, files``: the ``n`` most frequent places (country and city) and cameras of photos."""
    photos = found.where(_known() & (F.col("category") == PHOTO))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    parts = []
    for kind, label in (("place", F.when(field("exif.country").isNotNull(), F.concat_ws(" ", field("exif.country"), field("exif.city")))), ("camera", field("exif.camera"))):
        counted = photos.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("files"))
        parts.append(counted.orderBy(F.desc("files"), "label").limit(n).select(F.lit(kind).alias("kind"), "label", "files"))
    return parts[0].unionAll(parts[1])


def review_list(found: DataFrame, least: float = 0.8) -> DataFrame:
    """Files whose category is too uncertain."""
    return found.where(_known() & needs_review(least)).select("path", "category", "confidence", "category2", "confidence2")


def of_records(cache: DataFrame) -> DataFrame:
    """Records alone as if their files were there: the summary of a run of classification (AG25) is ``totals`` of it."""
    return cache.withColumn("state", F.lit("known"))
