"""Merging new records into stored ones, and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERWRITTEN = ["title", "description", "address", "price_mad", "surface_m2", "rooms", "bathrooms", "amenities", "image_urls", "agent_phone"]


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key; equal times are decided by content."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*[f"`{c}`" for c in df.columns]))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str] | None = None, fill: list[str] | None = None) -> DataFrame:
    """Full outer merge with ``merge_action`` (``new``, ``updated``, ``kept``).

    For a key on both sides, ``overwrite`` columns take the new value, NULL too;
    ``fill`` columns take it where the old one is NULL; the others stay.
    """
    overwrite, fill = overwrite or [], fill or []
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = a.withColumn("_old", F.lit(True)).alias("a").join(b, on, "full_outer")
    is_new, is_old = F.col("b._new").isNotNull(), F.col("a._old").isNotNull()
    out = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        o = F.col(f"a.`{c}`") if c in old.columns else F.lit(None)
        n = F.col(f"b.`{c}`") if c in new.columns else F.lit(None)
        if c in overwrite and c in new.columns:
            value = F.when(is_new, n).otherwise(o)
        elif c in fill:
            value = F.when(is_old, F.coalesce(o, n)).otherwise(n)
        else:
            value = F.when(is_old, o).otherwise(n)
        out.append(value.alias(c))
    action = F.when(~is_old, "new").when(is_new, "updated").otherwise("kept")
    return joined.select(*out, action.alias("merge_action"))


def upsert_listings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Listings by platform and source id; coordinates are only filled, and flags follow the merged values."""
    new = new.withColumns({
        "has_geolocation": F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        "has_images": F.size(F.coalesce("image_urls", F.array().cast("array<string>"))) > 0,
        "price_per_m2": F.when((F.col("surface_m2") > 0) & (F.col("price_mad") > 0), F.col("price_mad") / F.col("surface_m2")),
    })
    return merge(old, new, ["source_platform", "source_id"], overwrite=OVERWRITTEN, fill=["latitude", "longitude"])


IMAGE_VALUES = ["storage_path", "width", "height", "file_size_bytes", "format", "room_type", "is_exterior", "quality_score", "download_error", "downloaded_at"]


def upsert_images(old: DataFrame, new: DataFrame) -> DataFrame:
    """Images by listing and url; ``downloaded`` tells those without an error."""
    merged = merge(old, new, ["listing_id", "original_url"], overwrite=IMAGE_VALUES)
    return merged.withColumn("downloaded", F.coalesce(F.col("download_error"), F.lit("")) == "")


def mark_downloaded(listings: DataFrame, images: DataFrame) -> DataFrame:
    """``images_downloaded`` becomes true for listings whose images were processed."""
    done = images.select(F.col("listing_id").alias("_done")).distinct()
    marked = F.when(F.col("_done").isNotNull(), True).otherwise(F.col("images_downloaded"))
    return listings.join(done, F.col("id") == F.col("_done"), "left").withColumn("images_downloaded", marked).drop("_done")


def coalesce_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values win where they are not NULL."""
    joined = old.alias("a").join(new.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    cols = dict.fromkeys([*old.columns, *new.columns])
    pick = lambda c: F.coalesce(*([F.col(f"b.`{c}`")] if c in new.columns else []), *([F.col(f"a.`{c}`")] if c in old.columns else []))
    return joined.select(*[pick(c).alias(c) for c in cols])


def soft_delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``is_active`` becomes false for the given ids."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return df.join(gone, F.col("id") == F.col("_gone"), "left").withColumn("is_active", F.when(F.col("_gone").isNotNull(), False).otherwise(F.col("is_active"))).drop("_gone")


def run_state(log: DataFrame) -> DataFrame:
    """The last entry of every session, with its duration."""
    return log.groupBy("session_id").agg(F.max_by("status", "at").alias("status"), F.min("at").alias("started_at"), F.max("at").alias("finished_at"), (F.max(F.unix_seconds(F.col("at").cast("timestamp"))) - F.min(F.unix_seconds(F.col("at").cast("timestamp")))).alias("duration_seconds"))


def rollup(log: DataFrame) -> DataFrame:
    """Counters by city, by platform, and in all."""
    return log.rollup("platform", "city").agg(*[F.sum(c).alias(c) for c in ("listings_found", "listings_new", "listings_updated", "errors_count")])
