"""Streaming ingestion: watermarked duplicates, upserts by batch, windowed counters. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators.upsert import latest, upsert_listings
from hearthline.schema import LISTING, conform


def raw_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrivals of each listing key within the watermark."""
    return stream.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["source_platform", "source_id"])


def upsert_batches(stream: DataFrame, path: str, checkpoint: str):
    """Merge each micro-batch into a table of versions ``v=<batch>``; a repeated batch writes the same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _version(spark, path, number)
        new = latest(conform(batch, keep_extra=False), ["source_platform", "source_id"], "scraped_at")
        merged = upsert_listings(old, new).drop("merge_action") if old is not None else new
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _version(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The newest version older than ``before``."""
    last = _last_version(spark, path, before)
    return None if last is None else conform(spark.read.parquet(f"{path}/v={last}"), keep_extra=False)


def _last_version(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    numbers = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")]
    return max((n for n in numbers if before is None or n < before), default=None)


def windowed_counts(stream: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key; late rows beyond ``delay`` are left out."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, delay).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_complete(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregate over all that is there now; its last state is written to ``path`` by tasks, not gathered on the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={number}")

    query = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = counts.sparkSession
    last = _last_version(spark, path)
    return spark.createDataFrame([], counts.schema) if last is None else spark.read.parquet(f"{path}/v={last}")
