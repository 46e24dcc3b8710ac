"""Block sums over a stream: sums and counts add up, so each batch is folded into a table of totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ["cell", "block_id"]


def batch_totals(rows: DataFrame) -> DataFrame:
    """cell, block_id, s, m of rows with an error column e."""
    return rows.where("e IS NOT NULL").groupBy(*KEYS).agg(F.sum(F.abs("e")).alias("s"), F.count("*").alias("m"))


def start_totals(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's totals as a partition of its own (batch=...), replaced if the batch is run again: exactly once."""

    def fold(batch: DataFrame, number: int) -> None:
        batch_totals(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(*KEYS).agg(F.sum("s").alias("s"), F.sum("m").alias("m"))


def windowed_errors(stream: DataFrame, time: str, keys: list[str], value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean of value by event-time window and keys; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")
