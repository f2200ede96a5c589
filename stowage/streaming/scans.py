"""Scan events and journals as streams (SM01, SM04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import merge_latest


def merge_stream(events: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merge batches of file rows into versions of an inventory below ``table``.

    A batch makes the folder ``v=<batch>`` from the one before it, so a batch
    that is run again writes the same folder again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parts = [batch]
        if number:
            parts.insert(0, spark.read.schema(batch.schema).parquet(f"{table}/v={number - 1}"))
        merge_latest(*parts).select(*batch.columns).write.mode("overwrite").parquet(f"{table}/v={number}")

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def journal_stream(journal: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Running counts of a journal's kinds by run and hour; ``journal`` needs a timestamp ``ts``."""
    from pyspark.sql import functions as F

    return journal.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "run", "kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
