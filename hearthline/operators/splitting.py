"""Reproducible train, validation and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions import stats as S

TARGET_CITIES = ["casablanca", "rabat", "marrakech", "tangier", "fes", "agadir"]


def prepare(df: DataFrame, target: str = "price_mad", as_of_year: int = 2024) -> DataFrame:
    """Rows with a target and a city, within the 1st and 99th percentile of the target, and some derived columns."""
    city = next((c for c in ("city_cleaned", "city") if c in df.columns), None)
    if city is None:
        raise ValueError("no city column")
    if city != "city_cleaned":
        df = df.withColumn("city_cleaned", F.lower(F.trim("city")))
    known = df.where(F.col(target).isNotNull() & F.col("city_cleaned").isNotNull())
    low, high = S.quantiles(known, {target: [0.01, 0.99]})[target]
    rows = known.where(F.col(target).between(F.lit(low).cast("double"), F.lit(high).cast("double")))
    has, out = set(rows.columns), {}
    if "construction_year" in has:
        age = F.lit(as_of_year) - F.col("construction_year")
        out |= {"property_age": age, "age_category": S.right_closed(age, [0, 5, 15, 30, 100], ["new", "recent", "mature", "old"])}
    if {"rooms", "surface_m2"} <= has:
        out["room_density"] = S.ratio(F.col("rooms"), F.col("surface_m2"))
    amenities = [c for c in ("parking", "elevator", "pool", "garden", "furnished", "air_conditioning") if c in has]
    if amenities:
        out["luxury_amenity_count"] = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in amenities), F.lit(0))
    if "distance_to_city_center_km" in has:
        out["location_score"] = 1 / (1 + F.col("distance_to_city_center_km"))
    return rows.withColumns(out) if out else rows


def split_within(df: DataFrame, keys: list[str], out: str, id_col: str = "id", test: float = 0.2, val: float = 0.25, seed: int = 42) -> DataFrame:
    """``out`` is ``test``, ``val`` or ``train`` by a hash order within ``keys``: ceil(test * n) rows, then ceil(val * rest).

    A group of one row goes to training.
    """
    n = F.col("_size")
    n_test = F.when(n > 1, F.ceil(n * F.lit(test))).otherwise(0)
    n_val = F.when(n > 1, F.ceil((n - n_test) * F.lit(val))).otherwise(0)
    place = F.col("_place")
    kind = F.when(place <= n_test, "test").when(place <= n_test + n_val, "val").otherwise("train")
    return S.places_by_hash(df, keys, id_col, seed).withColumn(out, kind).drop("_place", "_size")


def split_by_city(df: DataFrame, id_col: str = "id", least: int = 100, cities: list[str] | None = None, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """``split`` within each city that has ``least`` rows, and ``split_combined`` over all of them, city by city."""
    if cities is not None:
        df = df.where(F.col("city_cleaned").isin(cities))
    counts = df.groupBy(F.col("city_cleaned").alias("_city")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    rows = df.join(counts.select("_city"), F.col("city_cleaned") == F.col("_city"), "left_semi")
    keys = ["city_cleaned", *([stratify] if stratify else [])]
    return split_within(split_within(rows, keys, "split", id_col, seed=seed), ["city_cleaned"], "split_combined", id_col, seed=seed + 1)


def split_statistics(df: DataFrame, target: str = "price_mad") -> DataFrame:
    """Counts, shares, mean and deviation of the target by city and set."""
    out = df.groupBy("city_cleaned", "split").agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("city_cleaned")))


def balance(df: DataFrame, id_col: str = "id", least: int = 500, most: int = 5000, seed: int = 42) -> DataFrame:
    """Down-sample training sets to ``most`` and the others to a quarter of that; cities with fewer than ``least`` training rows go."""
    sizes = df.where("split = 'train'").groupBy(F.col("city_cleaned").alias("_city")).agg(F.count(F.lit(1)).alias("_train")).where(F.col("_train") >= least)
    limit = F.when(F.col("_train") <= most, F.lit(1 << 40)).when(F.col("split") == "train", most).otherwise(most // 4)
    placed = S.places_by_hash(df, ["city_cleaned", "split"], id_col, seed).join(sizes, F.col("city_cleaned") == F.col("_city"))
    return placed.where(F.col("_place") <= limit).drop("_place", "_size", "_city", "_train")


def impute(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Medians and modes (the smallest of several; ``unknown`` without any) for NULLs."""
    middle, mode = S.quantiles(df, {c: [0.5] for c in numeric}), S.modes(df, text)
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c][0]).cast("double")) for c in numeric}
    return df.withColumns(fill | {c: F.coalesce(F.col(c), F.lit(mode[c]), F.lit("unknown")) for c in text})
