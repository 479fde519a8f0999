"""Price normalisation over listing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions import price as P
from hearthline.functions.stats import pct_rank_in, quantiles, ratio

TEXT_COLUMNS = ("price", "price_text", "prix", "cost", "amount")


def normalise_prices(df: DataFrame) -> DataFrame:
    """Price in MAD from the first price text, else from the number already there (confidence 1, ``existing``).

    Values out of range give NULL; ``price_per_m2`` is set where the surface is
    positive and the result in range.
    """
    text = F.coalesce(*[F.col(c).cast("string") for c in TEXT_COLUMNS if c in df.columns], F.lit(None).cast("string"))
    had = F.col("price_mad").cast("double") if "price_mad" in df.columns else F.lit(None).cast("double")
    area = F.col("surface_m2") if "surface_m2" in df.columns else F.lit(None).cast("double")
    staged = df.withColumns({"_m": P.to_mad(text), "_had": had})
    parsed = F.when(P.valid_price(F.col("_m.value")), F.col("_m.value"))
    price = F.coalesce(parsed, F.when(text.isNull(), F.when(P.valid_price(F.col("_had")), F.col("_had"))))
    known = text.isNull() & price.isNotNull()
    ppm2 = F.when(area > 0, price / area)
    return staged.withColumns({
        "price_mad": price,
        "original_currency": F.when(known, "MAD").otherwise(F.col("_m.currency")),
        "price_confidence": F.when(known, 1.0).when(price.isNotNull(), F.col("_m.confidence")).otherwise(0.0),
        "exchange_rate_used": F.col("_m.rate"),
        "price_per_m2": F.when(P.valid_ppm2(ppm2), ppm2),
        "price_normalization_method": F.when(known, "existing").when(price.isNotNull(), "text"),
    }).drop("_m", "_had")


def correct_scale(df: DataFrame) -> DataFrame:
    """Apply the power-of-ten rules; a changed price has confidence 0.7."""
    area = F.col("surface_m2") if "surface_m2" in df.columns else F.lit(None).cast("double")
    staged = df.withColumn("_c", P.corrected(F.col("price_mad"), area))
    changed = F.col("_c.method") != "no_correction"
    return staged.withColumns({
        "price_confidence": F.when(changed, 0.7).otherwise(F.col("price_confidence")) if "price_confidence" in df.columns else F.when(changed, 0.7),
        "price_per_m2": F.when(changed & (area > 0), F.col("_c.price") / area).otherwise(F.col("price_per_m2") if "price_per_m2" in df.columns else F.lit(None)),
        "price_normalization_method": F.when(changed, F.col("_c.method")).otherwise(F.col("price_normalization_method") if "price_normalization_method" in df.columns else F.lit("no_correction")),
        "price_mad": F.col("_c.price"),
    }).drop("_c")


def price_features(df: DataFrame) -> DataFrame:
    """Per room, classes, and the rank in the city where more than 10 prices are known."""
    has = set(df.columns)
    out = {"price_category": P.category(F.col("price_mad"))}
    if "rooms" in has:
        out["price_per_room"] = F.when(F.col("rooms") > 0, ratio(F.col("price_mad"), F.col("rooms")))
    if {"price_per_m2", "city"} <= has:
        out["price_per_m2_category"] = P.ppm2_category(F.col("price_per_m2"), F.lower(F.col("city")))
    df = df.withColumns(out)
    if "city" not in has:
        return df
    known = df.groupBy(F.col("city").alias("_city")).agg(F.count("price_mad").alias("_known"))
    ranked = pct_rank_in(df, "price_mad", ["city"], "_rank").join(known, F.col("city").eqNullSafe(F.col("_city")), "left")
    return ranked.withColumn("price_percentile_in_city", F.when(F.col("_known") > 10, F.col("_rank"))).drop("_rank", "_city", "_known")


def consistency_report(df: DataFrame) -> DataFrame:
    """One row: ranges, confidence, share of price per m2 off by more than 1 %, prices beyond 3 IQR."""
    low, middle, high = (F.lit(x).cast("double") for x in quantiles(df, {"price_mad": [0.25, 0.5, 0.75]})["price_mad"])
    off = F.abs(F.col("price_per_m2") - F.col("price_mad") / F.nullif(F.col("surface_m2"), F.lit(0.0))) > 0.01 * F.abs(F.col("price_per_m2"))
    far = (F.col("price_mad") < low - 3 * (high - low)) | (F.col("price_mad") > high + 3 * (high - low))
    return df.agg(
        F.count("price_mad").alias("n_prices"),
        F.min("price_mad").alias("min_price"),
        F.max("price_mad").alias("max_price"),
        F.avg("price_mad").alias("avg_price"),
        F.max(middle).alias("median_price"),
        F.count_if(off).alias("n_inconsistent"),
        F.count_if(far).alias("n_extreme"),
    )


def currency_distribution(df: DataFrame) -> DataFrame:
    """``currency, n`` of the original currencies; rows without one are not counted."""
    return df.where(F.col("original_currency").isNotNull()).groupBy(F.col("original_currency").alias("currency")).agg(F.count(F.lit(1)).alias("n"))


def confidence_report(df: DataFrame) -> DataFrame:
    """One row: how many records, prices and prices per m2 there are, and the confidence of the prices."""
    c = F.col("price_confidence")
    return df.agg(F.count(F.lit(1)).alias("n_records"), F.count("price_mad").alias("n_prices"), F.count("price_per_m2").alias("n_price_per_m2"), F.avg(c).alias("mean_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"))
