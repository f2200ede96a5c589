"""Tables that several steps read, written once in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this process only where a local session names none, an error on a cluster."""
    global _own
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        path = tempfile.mkdtemp(prefix="stowage-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own = f"file://{path}"
    return _own


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage and needs no executor that made it."""
    path = f"{shared_dir(df.sparkSession)}/stowage/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
