"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a local session that names none (tests on one machine) gets a folder
    of its own, which goes when the process ends; on a cluster that is an error.
    """
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        path = tempfile.mkdtemp(prefix="stowage-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own = f"file://{path}"
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/stowage/{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it none of the columns (upper or lower case) of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a later read needs no executor that took part in the
    write.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a few longs that :func:`light` sends to every executor (4 MB a long).
BROADCAST_KEYS = 500_000


def light(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, counted: up to ``BROADCAST_KEYS`` rows with a hint to broadcast them."""
    return F.broadcast(table) if table.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else table


def _keys(keys: DataFrame, col: str) -> DataFrame:
    """The distinct keys, :func:`light`."""
    return light(materialize(keys.select(col).distinct(), "keys"))


def among(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` is in ``keys``; ``df`` is shuffled only if there are many keys."""
    return df.join(_keys(keys, col), col, "left_semi")


def without(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` is not in ``keys`` (null stays); ``df`` is shuffled only if there are many keys."""
    return df.join(_keys(keys, col), col, "left_anti")
