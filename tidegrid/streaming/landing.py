"""Continuous form of the re-runnable merge: late or corrected rows replace
stored ones as new files land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidegrid.operators.align import dedup
from tidegrid.sources.store import SERIES_KEYS, merge_into


def landed_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Stream of landed parquet rows, a bounded number of files per batch."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(path)
    )


def hourly_means(events: DataFrame, value: str, lateness: str = "6 hours") -> DataFrame:
    """Hourly mean per zone of a timestamped stream; an hour is emitted once
    the watermark (longer than the tolerated lateness) has passed it.

    ``events`` has ``zone``, ``ts`` (TIMESTAMP) and the value column.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy("zone", F.window("ts", "1 hour").alias("w"))
        .agg(F.avg(value).alias(value))
        .select("zone", F.col("w.start").alias("ts"), value)
    )


def merge_stream(
    rows: DataFrame, root: str, datatype: str, order: str, checkpoint: str
) -> StreamingQuery:
    """Upsert every micro-batch into the stored series and stop when caught up.

    Within a batch the last row by ``order`` wins. The merge is idempotent, so
    a batch replayed after a failure leaves the same table.
    """

    def upsert(batch: DataFrame, _batch_id: int) -> None:
        latest = dedup(batch, order, "last", SERIES_KEYS).drop(order)
        merge_into(latest, root, datatype)

    return (
        rows.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
