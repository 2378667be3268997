"""Sliding usage per key over a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarium.session import scratch_path


def sliding_usage(log: DataFrame, length: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Requests and tokens per key and sliding window; rows later than the watermark are dropped.

    Works on a stream and on a batch. State holds one row per key and open window.
    """
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", length, slide).alias("w"), "api_key")
        .agg(F.count("*").alias("n_requests"), F.sum("tokens").alias("tokens"))
        .select(F.col("w.start").alias("window_start"), "api_key", "n_requests", "tokens")
    )


def run_usage(spark: SparkSession, stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Drain the stream and return the latest state of every window."""
    out = scratch_path(spark, "usage")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        sliding_usage(stream)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "usage-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    w = Window.partitionBy("window_start", "api_key").orderBy(F.desc("batch_id"))
    updates = spark.read.parquet(out)
    return updates.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "batch_id")
