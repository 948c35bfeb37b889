"""Streaming record and streaming daily counts.

Checkpoints and outputs live under the shared ``spark.checkpoint.dir``; a
restarted query (lost driver or executors) resumes from its checkpoint with
exactly-once file output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import shared_path
from sitelens.sources.statistics import outcomes_to_statistics


def record_stream(outcomes: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """Analysis outcomes (a stream) appended to the usage table (Parquet, by date)."""
    rows = outcomes_to_statistics(outcomes).withColumn("created_date", F.to_date("created_at"))
    w = rows.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).partitionBy("created_date")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def daily_counts_stream(stats: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Per-day row counts of a usage stream; rows later than the watermark are dropped."""
    return (
        stats.withColumn("created_at", F.col("created_at").cast("timestamp"))
        .withWatermark("created_at", watermark)
        .groupBy(F.window("created_at", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("date"), "count")
    )


def batch_writer(path: str, *partition_by: str):
    """A ``foreachBatch`` function that keeps each micro-batch in a folder of its own.

    A batch that is run again (lost driver) replaces its own folder and nothing else,
    so a replay changes nothing, and no file that a reader may hold is removed by a
    later batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch={batch_id}")

    return write


def write_daily_counts(counts: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Days whose count changed in a micro-batch are written under the batch's id.

    Update mode: a day's state goes when the watermark passes it, so the state holds
    the open days only, and a batch writes the days it has changed, not all."""
    w = counts.writeStream.outputMode("update").foreachBatch(batch_writer(path)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts as of the last batch that changed each day."""
    rows = spark.read.schema("date string, count bigint, batch bigint").option("basePath", path).parquet(path)
    return rows.groupBy("date").agg(F.max_by("count", "batch").alias("count"))


def run_to_parquet(df: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame to completion (availableNow) into a shared folder and read the result back."""
    import uuid

    run = f"{name}-{uuid.uuid4().hex[:8]}"
    out, ck = shared_path(spark, "streams", run, "out"), shared_path(spark, "streams", run, "checkpoint")
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
