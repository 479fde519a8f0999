"""Streams over stored files."""

from datetime import datetime

from pyspark.sql import functions as F

from hearthline.schema import LISTING, conform
from hearthline.streaming import ingest


def _file(spark, path, number, rows):
    df = spark.createDataFrame([("p", i, price, at) for i, price, at in rows], "source_platform string, source_id string, price_mad double, scraped_at timestamp")
    conform(df, LISTING, keep_extra=False).coalesce(1).write.mode("append").parquet(f"{path}/{number}")


def test_batches_are_merged_and_repeat_safely(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    _file(spark, source, 1, [("1", 10.0, datetime(2024, 1, 1)), ("2", 20.0, datetime(2024, 1, 1)), ("1", 11.0, datetime(2024, 1, 2))])

    def run():
        stream = ingest.raw_stream(spark, f"{source}/*")
        ingest.upsert_batches(stream, table, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run()
    _file(spark, source, 2, [("2", 25.0, datetime(2024, 1, 3)), ("3", 30.0, datetime(2024, 1, 3))])
    run()
    last = ingest._last_version(spark, table)
    got = {r["source_id"]: r["price_mad"] for r in spark.read.parquet(f"{table}/v={last}").collect()}
    assert got == {"1": 11.0, "2": 25.0, "3": 30.0}


def test_repeated_keys_and_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    _file(spark, source, 1, [("1", 10.0, datetime(2024, 1, 1, h)) for h in range(3)] + [("2", 5.0, datetime(2024, 1, 1, 1))])
    unique = ingest.deduplicated(ingest.raw_stream(spark, f"{source}/*"))
    query = unique.writeStream.format("memory").queryName("unique_listings").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["source_id"] for r in spark.table("unique_listings").collect()) == ["1", "2"]
    events = ingest.raw_stream(spark, f"{source}/*").select(F.col("scraped_at").alias("ts"), F.col("source_id").alias("event_type"), F.col("price_mad").alias("value"))
    counts = ingest.run_complete(ingest.windowed_counts(events, window="1 day"), str(tmp_path / "rows"), str(tmp_path / "b"))
    assert sorted((r["event_type"], r["n"], r["total"]) for r in counts.collect()) == [("1", 3, 30.0), ("2", 1, 5.0)]
