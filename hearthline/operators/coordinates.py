"""Coordinate validation, geocoding through cache tables, and geographic columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions import geo as G
from hearthline.functions.text import full_address


def validate_coordinates(df: DataFrame) -> DataFrame:
    """Adds ``coordinate_check``, a struct of validity, confidence and errors."""
    city = F.col("city") if "city" in df.columns else F.lit(None).cast("string")
    return df.withColumn("coordinate_check", G.coordinate_check(F.col("latitude"), F.col("longitude"), city))


def geocode_missing(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Fill missing or zero coordinates from ``cache`` (``address, lat, lon``), one entry per address.

    Found rows get confidence 0.8 and source ``cache``; the others stay as they are.
    """
    address = full_address(F.col("neighborhood"), F.col("city"))
    entries = cache.groupBy(F.col("address").alias("_a")).agg(F.min(F.struct("lat", "lon")).alias("_p"))
    joined = df.withColumn("_need", F.when(G.needs_geocoding(F.col("latitude"), F.col("longitude")), F.nullif(address, F.lit("")))).join(entries, F.col("_need") == F.col("_a"), "left")
    hit = F.col("_p").isNotNull()
    return joined.withColumns({
        "latitude": F.when(hit, F.col("_p.lat")).otherwise(F.col("latitude")),
        "longitude": F.when(hit, F.col("_p.lon")).otherwise(F.col("longitude")),
        "geocoding_confidence": F.when(hit, 0.8),
        "geocoding_source": F.when(hit, "cache"),
    }).drop("_need", "_a", "_p")


def uncached_addresses(df: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct addresses that a geocoding service would have to be asked for."""
    address = full_address(F.col("neighborhood"), F.col("city")).alias("address")
    need = df.where(G.needs_geocoding(F.col("latitude"), F.col("longitude"))).select(address).where("address <> ''").distinct()
    return need.join(cache.select("address"), "address", "left_anti")


def geocode_address(cache: DataFrame, address: str, city: str, country: str = "Morocco") -> DataFrame:
    """``latitude, longitude`` of one address, if the cache has it; the filter reaches the scan."""
    return cache.where(F.col("address") == f"{address}, {city}, {country}").select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).limit(1)


def reverse_geocode(df: DataFrame, cache: DataFrame, digits: int = 4) -> DataFrame:
    """Address parts from ``cache`` (``lat, lon, suburb, city, town, village, postcode, full_address``) at rounded coordinates."""
    key = lambda c: F.round(c, digits)
    entries = cache.select(key(F.col("lat")).alias("_la"), key(F.col("lon")).alias("_lo"), F.col("suburb").alias("reverse_geocoded_neighborhood"), F.coalesce("city", "town", "village").alias("reverse_geocoded_city"), F.col("postcode").alias("reverse_geocoded_postal_code"), F.col("full_address").alias("reverse_geocoded_full_address")).dropDuplicates(["_la", "_lo"])
    return df.join(entries, (key(F.col("latitude")) == F.col("_la")) & (key(F.col("longitude")) == F.col("_lo")), "left").drop("_la", "_lo")


def fallback_to_centre(df: DataFrame) -> DataFrame:
    """City centres, moved a little and alike on every run, where coordinates are missing."""
    need, city = G.needs_geocoding(F.col("latitude"), F.col("longitude")), F.lower(F.trim("city"))
    lat, lon = (G.jittered_centre(F.col("id"), city, k) for k in (0, 1))
    filled = need & lat.isNotNull()
    had = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return df.withColumns({
        "latitude": F.when(filled, lat).otherwise(F.col("latitude")),
        "longitude": F.when(filled, lon).otherwise(F.col("longitude")),
        "geocoding_confidence": F.when(filled, 0.3).otherwise(had("geocoding_confidence")),
        "geocoding_source": F.when(filled, "city_centre").otherwise(had("geocoding_source")),
    })


def geographic_columns(df: DataFrame) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.withColumns({"distance_to_city_center_km": G.centre_distance_km(lat, lon, F.lower(F.col("city"))), "distance_to_coast_km": G.coast_distance_km(lon)})
