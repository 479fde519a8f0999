"""Readers and writers of listing data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import html as H
from hearthline.schema import conform
from hearthline.sources import dom

#: Connectors by platform: a function of a page's url that gives its HTML, or None.
CONNECTORS: dict[str, Callable[[str], str | None]] = {}


def register_connector(platform: str, fetch: Callable[[str], str | None]) -> None:
    CONNECTORS[platform] = fetch


def connector(platform: str) -> Callable[[str], str | None]:
    if platform not in CONNECTORS:
        raise ValueError(f"unsupported platform: {platform}")
    return CONNECTORS[platform]


def active_listings(spark: SparkSession, path: str) -> DataFrame:
    """Stored listings that are active; the filter reaches the scan."""
    return conform(spark.read.parquet(path).where("is_active"))


def jdbc_listings(spark: SparkSession, url: str, table: str = "listings", partitions: int = 16) -> DataFrame:
    """The same from a database, in ranges between the smallest and largest id that it has."""
    source = spark.read.format("jdbc").option("url", url)
    low, high = source.option("query", f"SELECT MIN(id) AS low, MAX(id) AS high FROM {table}").load().first()
    if low is None:
        return conform(source.option("dbtable", table).load().where("is_active"))
    ranges = {"dbtable": table, "partitionColumn": "id", "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(partitions), "fetchsize": "10000"}
    return conform(source.options(**ranges).load().where("is_active"))


def lookup(listings: DataFrame, platform: str, source_id: str) -> DataFrame:
    """The listing of a platform's id, if it is stored; the filter reaches the scan."""
    return listings.where((F.col("source_platform") == platform) & (F.col("source_id") == source_id))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; one in fewer pieces than there are cores is dealt over them, as costly columns would else run in few tasks."""
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def csv_split(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def json_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def city_split(spark: SparkSession, path: str, city: str, split: str | None = None) -> DataFrame:
    """One city of a table written by ``write_splits``; partitions are pruned."""
    rows = spark.read.parquet(path).where(F.col("city_cleaned") == city)
    return rows.where(F.col("split") == split) if split else rows


def available_cities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("split = 'train'").select("city_cleaned").distinct()


def write_splits(df: DataFrame, path: str) -> None:
    """Partitioned by city and set; rows are gathered by partition first, so each has few files."""
    df.repartition("city_cleaned", "split").write.mode("overwrite").partitionBy("city_cleaned", "split").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fetch_pages(urls: DataFrame, platform: str) -> DataFrame:
    """``url, html, error`` through the platform's connector; errors stay with their row."""
    fetch = connector(platform)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch["url"]:
                try:
                    out.append((url, fetch(url), None))
                except Exception as e:  # noqa: BLE001  kept as data
                    out.append((url, None, str(e)))
            yield pd.DataFrame(out, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")


def listing_urls(pages: DataFrame, pattern: str = r"/(fr/)?p?a/[0-9]+") -> DataFrame:
    """Distinct links to listings on stored index pages."""
    return pages.select(F.explode(H.links(F.col("html"))).alias("url")).where(F.col("url").rlike(pattern)).distinct()


def parse_pages(pages: DataFrame, platform: str = "web", base: str = "") -> DataFrame:
    """Listing records of stored pages (``url, html``); pages without a title give none."""
    return conform(dom.listings(pages, base).withColumn("source_platform", F.lit(platform)))


def image_name(id_: str, url: str, position: str):
    """The stored name of an image: id, two-digit position, start of the url's MD5."""
    return F.concat_ws("_", F.col(id_), F.lpad(F.col(position).cast("string"), 2, "0"), F.substring(F.md5(F.col(url)), 1, 8))


def listing_images(listings: DataFrame) -> DataFrame:
    """``listing_id, position, original_url, name`` of every image url, in order."""
    rows = listings.select(F.col("id").alias("listing_id"), F.posexplode("image_urls").alias("position", "original_url"))
    return rows.withColumn("name", image_name("listing_id", "original_url", "position"))


def fetch_images(images: DataFrame, fetch: Callable[[str], bytes], most_bytes: int = 5 << 20) -> DataFrame:
    """``listing_id, original_url, name, content, download_error``: bytes through a connector; errors stay with their row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents, errors = [], []
            for url in batch["original_url"]:
                try:
                    raw = fetch(url)
                    if len(raw) > most_bytes:
                        raise ValueError(f"more than {most_bytes} bytes")
                    contents.append(raw)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  kept as data
                    contents.append(None)
                    errors.append(f"Failed to download image: {e}")
            yield batch.assign(content=contents, download_error=errors)

    return images.select("listing_id", "original_url", "name").mapInPandas(run, "listing_id long, original_url string, name string, content binary, download_error string")


def store_images(images: DataFrame, put: Callable[[str, bytes], str]) -> DataFrame:
    """The images with ``storage_path``, where ``put`` (an object store's client) stored them; its errors become ``download_error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths, errors = [], []
            for name, content, error in zip(batch["name"], batch["content"], batch["download_error"], strict=True):
                path = None
                if content is not None:
                    try:
                        path = put(name, content)
                    except Exception as e:  # noqa: BLE001  kept as data
                        error = f"Upload failed: {e}"
                paths.append(path)
                errors.append(error)
            yield batch.assign(storage_path=paths, download_error=errors)

    return images.select("listing_id", "original_url", "name", "content", "download_error").mapInPandas(run, "listing_id long, original_url string, name string, content binary, download_error string, storage_path string")
