"""Text standardisation over listing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions import text as X

CLEANERS = {
    "city": X.clean_city,
    "property_type": X.clean_property_type,
    "neighborhood": X.clean_neighborhood,
    "title": X.clean_title,
    "description": X.clean_description,
    "address": X.clean_address,
}


def clean_text_fields(df: DataFrame) -> DataFrame:
    """``*_cleaned`` for every text column present, and the features named in descriptions."""
    out = {f"{c}_cleaned": f(F.col(c)) for c, f in CLEANERS.items() if c in df.columns}
    if "description" in df.columns:
        out["description_features"] = X.description_features(F.col("description"))
    return df.withColumns(out)


def standardise_values(df: DataFrame) -> DataFrame:
    """Booleans in place; conditions and floors as ``*_standardized``."""
    out = {c: X.standard_boolean(F.col(c)) for c in ("furnished", "parking", "elevator", "pool", "garden") if c in df.columns}
    if "condition" in df.columns:
        out["condition_standardized"] = X.standard_condition(F.col("condition"))
    if "floor" in df.columns:
        out["floor_standardized"] = X.standard_floor(F.col("floor"))
    return df.withColumns(out) if out else df


def text_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: present, missing, average length (a NULL counts as 4 characters), distinct values."""
    stats = df.agg(*[x for c in columns for x in (F.count(c).alias(f"{c}|n"), F.avg(F.length(F.coalesce(F.col(c), F.lit("None")))).alias(f"{c}|len"), F.countDistinct(c).alias(f"{c}|distinct"))], F.count(F.lit(1)).alias("rows"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}|n").alias("n_present"), (F.col("rows") - F.col(f"{c}|n")).alias("n_missing"), F.col(f"{c}|len").alias("avg_length"), F.col(f"{c}|distinct").alias("n_distinct")) for c in columns])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def consolidation(df: DataFrame, before: str, after: str) -> DataFrame:
    """Share of distinct values that cleaning has merged."""
    n = df.agg(F.countDistinct(before).alias("n_before"), F.countDistinct(after).alias("n_after"))
    return n.withColumn("consolidation_rate", F.try_divide((F.col("n_before") - F.col("n_after")).cast("double"), F.col("n_before").cast("double")))
