"""Logs as a stream: rejected rows aside, activity by day with late logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caselens.functions import times
from caselens.operators import ingest as batch


def ingest(source: DataFrame, path: str, checkpoint: str, formats: tuple[str, ...] = times.LOG_FORMATS) -> StreamingQuery:
    """Read what has arrived, and append good rows under path/good and rejected ones under path/rejected, each micro-batch once.

    Row numbers count from the start of a micro-batch, with gaps between partitions.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        checked = batch.logs_from(rows, formats).withColumn("batch_id", F.lit(batch_id))
        # A repeated micro-batch overwrites its own partition, so a restart leaves no row twice.
        for part, name in ((batch.good(checked), "good"), (batch.quarantined(checked), "rejected")):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/{name}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_activity(logs: DataFrame, delay: str = "7 days") -> DataFrame:
    """Logs by day and step, and about how many cases, up to `delay` late."""
    windowed = logs.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "step_name")
    return windowed.agg(F.count(F.lit(1)).alias("logs"), F.approx_count_distinct("case_id").alias("cases")).select(F.col("window.start").alias("day"), "step_name", "logs", "cases")
