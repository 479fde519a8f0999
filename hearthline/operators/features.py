"""Feature groups for pricing models. Each adds the columns whose inputs are present."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from hearthline import vocab
from hearthline.functions import dates as D
from hearthline.functions import stats as S
from hearthline.functions import text as X
from hearthline.plans.tables import cut


def _added(df: DataFrame, out: dict[str, Column]) -> DataFrame:
    return df.withColumns(out) if out else df


def basic(df: DataFrame) -> DataFrame:
    has, out = set(df.columns), {}
    for name, a, b in (("price_per_room", "price_mad", "rooms"), ("price_per_bathroom", "price_mad", "bathrooms"), ("surface_per_room", "surface_m2", "rooms"), ("room_density", "rooms", "surface_m2"), ("bathroom_to_room_ratio", "bathrooms", "rooms")):
        if {a, b} <= has:
            out[name] = S.ratio(F.col(a), F.col(b))
    if "floor" in has:
        floor = F.col("floor").try_cast("int")
        out["is_ground_floor"] = F.coalesce(floor == 0, F.lit(False)).cast("int")
        out["is_top_floor"] = F.coalesce(floor > 5, F.lit(False))
        out["floor_category"] = S.right_closed(floor, [-1, 0, 2, 5, 20], ["ground", "low", "mid", "high"])
    return _added(df, out)


def location(df: DataFrame) -> DataFrame:
    has, out = set(df.columns), {}
    if "distance_to_city_center_km" in has:
        d = F.col("distance_to_city_center_km")
        df = df.crossJoin(F.broadcast(df.agg(F.max(d).alias("_far"))))  # one row
        out["location_premium_score"] = 1 - S.ratio(d, F.col("_far"))
        out["location_category"] = S.right_closed(d, [0, 2, 5, 10, 50], ["city_center", "inner", "suburban", "outer"])
    if "distance_to_coast_km" in has:
        d = F.col("distance_to_coast_km")
        out["coastal_proximity_score"] = 1 / (1 + d)
        out["is_coastal"] = F.coalesce(d < 5, F.lit(False)).cast("int")
    if {"latitude", "longitude"} <= has:
        lat, lon = F.col("latitude"), F.col("longitude")
        out["coordinate_precision"] = (X.decimals(lat) + X.decimals(lon)) / 2
        out["lat_rounded"], out["lon_rounded"] = F.bround(lat, 2), F.bround(lon, 2)
        out["coordinate_cluster"] = F.concat_ws("_", F.bround(lat, 2).cast("string"), F.bround(lon, 2).cast("string"))
    return _added(df, out).drop("_far")


def property_(df: DataFrame, as_of_year: int = 2024) -> DataFrame:
    has, out = set(df.columns), {}
    flag = lambda c: F.col(c).cast("int")
    amenities = [c for c in vocab.AMENITIES if c in has]
    if amenities:
        count = reduce(lambda a, b: a + b, [F.coalesce(flag(c), F.lit(0)) for c in amenities])
        out["amenity_count"] = count
        out["luxury_score"] = reduce(lambda a, b: a + b, [flag(c) * F.lit(vocab.LUXURY_WEIGHTS.get(c, 1.0)) for c in amenities])
        if "rooms" in has:
            out["amenity_density"] = S.ratio(count, F.col("rooms"))
    if "surface_m2" in has:
        out["size_category"] = S.right_closed(F.col("surface_m2"), [0, 50, 100, 150, 250, 1000], ["small", "medium", "large", "very_large", "mansion"])
        if "rooms" in has:
            out["space_efficiency"] = S.ratio(F.col("surface_m2"), F.col("rooms"))
    if "construction_year" in has:
        age = F.lit(as_of_year) - F.col("construction_year")
        out["property_age"] = age
        out["age_category"] = S.right_closed(age, [0, 5, 15, 30, 100], ["new", "recent", "mature", "old"])
        out["is_new_construction"] = F.coalesce(age <= 2, F.lit(False)).cast("int")
    return _added(df, out)


def _grouped(df: DataFrame, base: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Group statistics of ``base`` joined to ``df``: partial sums, then a table of one row per group, so a hot group is no hot task.

    ``base`` is the table before any such join, so plans grow by a sum, not by a product.
    """
    table = base.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[a.alias(n) for n, a in aggregates.items()])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys])
    return df.join(table, on, "left").drop(*[f"_{k}" for k in keys])


def market(df: DataFrame, target: str = "price_mad") -> DataFrame:
    has, base = set(df.columns), df
    if {"city_cleaned", target} <= has:
        df = _grouped(df, base, ["city_cleaned"], {"city_price_mean": F.avg(target), "city_price_std": F.stddev_samp(target), "city_listing_count": F.count(target)})
        df = df.join(S.medians(base, "city_cleaned", target, "city_price_median").withColumnRenamed("city_cleaned", "_k"), F.col("city_cleaned") == F.col("_k"), "left").drop("_k")
        gap = F.col(target) - F.col("city_price_mean")
        df = df.withColumns({"price_deviation_from_city": gap, "price_zscore_in_city": S.ratio(gap, F.col("city_price_std"))})
        df = S.pct_rank_in(df, target, ["city_cleaned"], "_rank", base)
        df = df.withColumn("price_percentile_in_city", F.when(F.col("city_cleaned").isNotNull(), F.col("_rank"))).drop("_rank")
    if "neighborhood_cleaned" in has:
        stats = {"neighborhood_popularity": F.count(F.lit(1))}
        if target in has:
            stats["neighborhood_price_mean"] = F.when(F.count(target) >= 5, F.avg(target))
        df = _grouped(df, base, ["neighborhood_cleaned"], stats)
    if {"property_type_cleaned", target} <= has:
        df = _grouped(df, base, ["property_type_cleaned"], {"property_type_price_mean": F.avg(target)})
        df = df.join(S.medians(base, "property_type_cleaned", target, "property_type_price_median").withColumnRenamed("property_type_cleaned", "_k"), F.col("property_type_cleaned") == F.col("_k"), "left").drop("_k")
        df = df.withColumn("price_premium_over_type", F.col(target) - F.col("property_type_price_mean"))
    return df


def interactions(df: DataFrame, max_values: int = 1000) -> DataFrame:
    """Products; one column for each city and type, whose names a small job finds.

    Beyond ``max_values`` of them the most frequent have columns, and the product of any
    other is the entry of its row in the map ``price_m2_city`` or ``rooms_type``: a value
    that the map lacks has the product 0, and the map is NULL where the product is.
    """
    has, out = set(df.columns), {}
    for name, a, b in (("size_location_interaction", "surface_m2", "location_premium_score"), ("luxury_location_interaction", "luxury_score", "location_premium_score")):
        if {a, b} <= has:
            out[name] = F.col(a) * F.col(b)
    for prefix, value, key in (("price_m2_city", "price_per_m2", "city_cleaned"), ("rooms_type", "rooms", "property_type_cleaned")):
        if {value, key} <= has:
            top = df.where(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count"), key).limit(max_values + 1)
            values = [r[0] for r in top.collect()]
            for v in sorted(values[:max_values]):
                out[f"{prefix}_{v}"] = F.col(value) * F.coalesce(F.col(key) == v, F.lit(False)).cast("int")
            if len(values) > max_values:
                other = F.coalesce(~F.col(key).isin(values[:max_values]), F.lit(False))
                entry = F.create_map(F.col(key), F.col(value))
                out[prefix] = F.when(F.col(value).isNotNull(), F.when(other, entry).otherwise(F.create_map().cast(f"map<string,{df.schema[value].dataType.simpleString()}>")))
    return _added(df, out)


def aggregations(df: DataFrame) -> DataFrame:
    has, base = set(df.columns), df
    for m, g in (("surface_m2", "city_cleaned"), ("rooms", "city_cleaned"), ("price_per_m2", "property_type_cleaned"), ("luxury_score", "neighborhood_cleaned")):
        if {m, g} <= has:
            df = _grouped(df, base, [g], {f"{m}_mean_by_{g}": F.avg(m), f"{m}_std_by_{g}": F.stddev_samp(m)})
            df = df.withColumn(f"{m}_zscore_by_{g}", S.ratio(F.col(m) - F.col(f"{m}_mean_by_{g}"), F.col(f"{m}_std_by_{g}")))
    return df


def transformations(df: DataFrame, columns: tuple[str, ...] = ("price_mad", "surface_m2", "price_per_m2")) -> DataFrame:
    out = {}
    for c in columns:
        if c in df.columns:
            x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            out[f"{c}_log"], out[f"{c}_sqrt"] = F.log1p(F.greatest(x, F.lit(0.0))), F.sqrt(F.greatest(x, F.lit(0.0)))
            out[f"{c}_boxcox"] = F.signum(x) * F.log1p(F.abs(x))
    base, df = df, _added(df, out)
    for c in ("price_per_m2", "surface_m2"):
        if c in df.columns:
            df = S.quantile_bins(df, c, f"{c}_bin", base=base)
    return df


def times(df: DataFrame) -> DataFrame:
    if "scraped_at" not in df.columns:
        return df
    ts = F.col("scraped_at").cast("timestamp")
    df = df.select("*", *D.parts(ts))
    if "listed_at" in df.columns:
        days = D.days_between(ts, F.col("listed_at").cast("timestamp"))
        df = df.withColumns({"days_on_market": days, "is_new_listing": F.coalesce(days <= 7, F.lit(False)).cast("int"), "is_stale_listing": F.coalesce(days >= 180, F.lit(False)).cast("int")})
    return df


def texts(df: DataFrame) -> DataFrame:
    out = {}
    for c in ("title", "description"):
        if f"{c}_cleaned" in df.columns:
            out[f"{c}_length"] = F.length(F.coalesce(F.col(f"{c}_cleaned"), F.lit("")))
            out[f"{c}_word_count"] = X.word_count(F.col(f"{c}_cleaned"))
    df = _added(df, out)
    if "title_cleaned" in df.columns:
        df = df.select("*", *X.keyword_flags(F.col("title_cleaned")))
    if "description_cleaned" in df.columns:
        good, bad = X.sentiment(F.col("description_cleaned"))
        df = df.withColumns({"description_positive_sentiment": good, "description_negative_sentiment": bad, "description_sentiment_score": good - bad})
    return df


def statistics(df: DataFrame, order: tuple[str, ...] = ("scraped_at", "id")) -> DataFrame:
    """Rolling statistics by city in the given order, and ranks over all rows and in the city."""
    has = set(df.columns)
    city = next((c for c in ("city_cleaned", "city") if c in has), None)
    keys = [c for c in order if c in has]
    out = {}
    if city and keys:
        for c in ("price_mad", "surface_m2", "price_per_m2"):
            if c in has:
                out[f"{c}_rolling_mean"], out[f"{c}_rolling_std"] = S.rolling(c, keys, [city])
    base, df = df, _added(df, out)
    for c in ("price_mad", "surface_m2", "luxury_score"):
        if c in has:
            df = S.pct_rank_global(df, c, f"{c}_rank", base)
            if city:
                df = S.pct_rank_in(df, c, [city], f"{c}_rank_in_city", base)
    return df


def engineer(df: DataFrame, target: str = "price_mad", as_of_year: int = 2024) -> DataFrame:
    """All feature groups in turn. Tables are written between groups whose statistics look at their whole input."""
    df = cut(property_(location(basic(df)), as_of_year))
    df = cut(interactions(market(df, target)))
    df = cut(aggregations(df))
    df = cut(texts(times(transformations(df))))
    return statistics(df)


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without and f.name != "id" and not f.name.endswith("_id")]


def f_scores(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """``feature, f_score`` of the univariate regressions on ``target``, from one aggregate; missing values are left out by pair."""
    cols = columns or numeric_columns(df, (target,))
    both = [F.when(F.col(target).isNotNull(), F.col(c).cast("double")) for c in cols]
    row = df.agg(*[F.corr(b, F.col(target).cast("double")).alias(f"r{i}") for i, b in enumerate(both)], *[F.count(b).alias(f"n{i}") for i, b in enumerate(both)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, c in enumerate(cols)])
    r2 = F.col("p.r") * F.col("p.r")
    return row.select(F.explode(pairs).alias("p")).select("p.feature", F.try_divide(r2 * (F.col("p.n") - 2), F.nullif(1 - r2, F.lit(0.0))).alias("f_score"))


def select_best(df: DataFrame, target: str, k: int = 50, keep: tuple[str, ...] = ("city_cleaned", "property_type_cleaned")) -> DataFrame:
    """The ``k`` numeric columns with the highest scores, the target and the key columns."""
    best = f_scores(df, target).where("f_score is not null").orderBy(F.desc("f_score"), "feature").limit(k)
    names = [r["feature"] for r in best.collect()]
    return df.select(*[c for c in ("id", target, *keep) if c in df.columns and c not in names], *[f"`{n}`" for n in names])


def mutual_information(df: DataFrame, target: str, columns: list[str], bins: int = 10) -> DataFrame:
    """``feature, importance`` in falling order: information shared by the quantile bins of a column and the target, over the largest."""
    found = S.quantiles(df.select(target, *columns), {c: [i / bins for i in range(bins + 1)] for c in (target, *columns)})
    binned = df.select(S.bin_number(F.col(target), found[target]).alias("_y"), *[S.bin_number(F.col(c), found[c]).alias(c) for c in columns])
    long = binned.select("_y", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns])).alias("p")).select("_y", "p.*").where("_y is not null and x is not null")
    cells = long.groupBy("feature", "x", "_y").agg(F.count(F.lit(1)).cast("double").alias("n"))  # at most bins * bins rows a feature
    w = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))
    parts = cells.withColumn("part", F.col("n") / w() * F.log(F.col("n") * w() / (w("x") * w("_y"))))
    return _over_largest(parts.groupBy("feature").agg(F.sum("part").alias("mi")))


def _over_largest(mi: DataFrame) -> DataFrame:
    scaled = mi.crossJoin(F.broadcast(mi.agg(F.max("mi").alias("top")))).select("feature", S.ratio(F.col("mi"), F.col("top")).alias("importance"))
    return scaled.orderBy(F.desc("importance"), "feature")


def neighbour_information(df: DataFrame, target: str, columns: list[str], neighbours: int = 3, sample_rows: int = 5000, seed: int = 42) -> DataFrame:
    """As ``mutual_information``, by distances to nearest neighbours instead of bins (Kraskov's estimate).

    The estimate compares rows pairwise, so it is made on ``sample_rows`` rows at the most,
    chosen by hash; NULL counts as the column's median. Each column is one task.
    """
    middle = S.quantiles(df.select(target, *columns), {c: [0.5] for c in (target, *columns)})
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c][0])).alias(c)
    filled = df.select(value(target), *[value(c) for c in columns])
    drawn = filled.orderBy(F.xxhash64(F.lit(seed), *filled.columns), *filled.columns).limit(sample_rows)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns])
    long = drawn.select(F.col(target).alias("y"), F.explode(pairs).alias("p")).select("y", "p.*")

    def estimate(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": rows["feature"].iloc[:1], "mi": [kraskov(rows["x"].to_numpy(float), rows["y"].to_numpy(float), neighbours)]})

    return _over_largest(long.groupBy("feature").applyInPandas(estimate, "feature string, mi double"))


def kraskov(x: np.ndarray, y: np.ndarray, neighbours: int = 3, seed: int = 42) -> float:
    """Mutual information of two continuous variables; values are scaled and ties broken by tiny noise."""
    n = len(x)
    if n <= neighbours + 1:
        return 0.0
    rng = np.random.default_rng(seed)

    def scaled(v: np.ndarray) -> np.ndarray:
        v = v / (v.std() or 1.0)
        return v + 1e-10 * max(1.0, float(np.abs(v).mean())) * rng.standard_normal(n)

    x, y = scaled(x), scaled(y)
    sx, sy = np.sort(x), np.sort(y)
    digamma = np.concatenate([[0.0], -np.euler_gamma + np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])])
    total = 0.0
    for at in range(0, n, 256):
        i = slice(at, at + 256)
        far = np.maximum(np.abs(x[i, None] - x[None, :]), np.abs(y[i, None] - y[None, :]))
        radius = np.nextafter(np.partition(far, neighbours, axis=1)[:, neighbours], 0)
        count = [np.searchsorted(s, v[i] + radius, "right") - np.searchsorted(s, v[i] - radius, "left") for s, v in ((sx, x), (sy, y))]
        total += float(sum(digamma[np.clip(c, 1, n)].sum() for c in count))
    return max(0.0, float(digamma[n] + digamma[neighbours] - total / n))


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """``kind, type, n_columns``: the columns that were there and those that were added, by type."""
    known = set(before.columns)
    kinds: dict[tuple[str, str], int] = {}
    for f in after.schema.fields:
        key = ("original" if f.name in known else "engineered", f.dataType.simpleString())
        kinds[key] = kinds.get(key, 0) + 1
    return after.sparkSession.createDataFrame([(*k, n) for k, n in sorted(kinds.items())], "kind string, type string, n_columns int")


def feature_names(df: DataFrame, without: tuple[str, ...] = ("id", "price_mad", "split", "split_combined")) -> list[str]:
    """The columns a model would use, in alphabetical order."""
    return sorted(c for c in df.columns if c not in without)


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """Standard (population deviation), minmax or robust scaling in place; NULL counts as 0."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    if method == "robust":
        found = S.quantiles(df.select(*[x[c].alias(c) for c in columns]), {c: [0.25, 0.5, 0.75] for c in columns})
        parts = {c: (q[1], q[2] - q[0]) for c, q in found.items() if q[0] is not None}
    elif method in ("standard", "minmax"):
        pair = (lambda v: (F.avg(v), F.stddev_pop(v))) if method == "standard" else (lambda v: (F.min(v), F.max(v) - F.min(v)))
        row = df.agg(F.count(F.lit(1)).alias("n"), *[e.alias(f"{k}{i}") for i, c in enumerate(columns) for k, e in zip("ab", pair(x[c]), strict=True)]).first()
        parts = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns) if row["n"]}
    else:
        raise ValueError(f"unknown scaling: {method}")
    return df.withColumns({c: (x[c] - F.lit(a)) / F.lit(b or 1.0) for c, (a, b) in parts.items()})
