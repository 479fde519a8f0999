"""Data quality checks, one row each: ``check_name, status, score``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from hearthline import vocab
from hearthline.functions import geo as G
from hearthline.functions import price as P


def _rate(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(hits).cast("double"), F.count(of).cast("double")), F.lit(0.0))


def checks(df: DataFrame) -> DataFrame:
    """All checks the columns allow, from one aggregate over the table (and one over distinct rows)."""
    has = set(df.columns)
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n")]
    rows: list[tuple[str, Column, float, str]] = []  # name, score, threshold, status below it

    def add(name: str, agg: Column, least: float, below: str = "fail") -> None:
        aggregates.append(agg.alias(name))
        rows.append((name, F.col(name), least, below))

    for group, (least, fields) in vocab.FIELD_GROUPS.items():
        present = [c for c in fields if c in has]
        if present:
            share = reduce(lambda a, b: a + b, [F.count(c) for c in present]) / (len(present) * F.nullif(F.count(F.lit(1)), F.lit(0)))
            aggregates.append(share.alias(f"share_{group}"))
            rows.append((f"completeness_{group}", F.least(F.coalesce(f"share_{group}", F.lit(0.0)) / least, F.lit(1.0)), least, "share"))
    if "price_mad" in has:
        add("price_validity", _rate(P.valid_price(F.col("price_mad")), F.col("price_mad")), 0.95)
    if {"latitude", "longitude"} <= has:
        both = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), 1)
        add("coordinate_validity", _rate(G.in_box(F.col("latitude"), F.col("longitude")), both), 0.90)
    if "surface_m2" in has:
        add("surface_validity", _rate(F.col("surface_m2").between(*vocab.SURFACE_RANGE), F.col("surface_m2")), 0.95)
    if {"price_mad", "surface_m2"} <= has:
        ppm2 = F.when(F.col("surface_m2") > 0, F.col("price_mad") / F.col("surface_m2"))
        add("price_surface_consistency", _rate(P.valid_ppm2(ppm2), ppm2), 0.90, "warning")
    if {"rooms", "surface_m2"} <= has:
        per = F.when(F.col("rooms") > 0, F.col("surface_m2") / F.col("rooms"))
        add("room_surface_consistency", _rate(per.between(10, 100), per), 0.85, "warning")
    for name, options, known, least in (("city_name_accuracy", ("city_cleaned", "city"), vocab.KNOWN_CITIES, 0.80), ("property_type_accuracy", ("property_type_cleaned", "property_type"), vocab.KNOWN_TYPES, 0.75)):
        column = next((c for c in options if c in has), None)
        if column:
            add(name, _rate(F.lower(F.col(column)).isin(known), F.col(column)), least, "warning")
    typed = [c for c in vocab.EXPECTED_TYPES if c in has]
    if typed:
        share = sum(df.schema[c].dataType.simpleString() == vocab.EXPECTED_TYPES[c] for c in typed) / len(typed)
        rows.append(("data_type_integrity", F.lit(float(share)), 0.8, "warning"))
    issues = [F.count_if(~F.col(c).between(lo, hi)) for c, lo, hi in (("rooms", 1, 20), ("bathrooms", 0, 10)) if c in has]
    if issues:
        kinds = reduce(lambda a, b: a + b, [F.when(i > 0, 1).otherwise(0) for i in issues])
        aggregates.append((1 - kinds / 5).alias("range_integrity"))
        rows.append(("range_integrity", F.col("range_integrity"), 1.0, "warning"))
    stats = df.agg(*aggregates)
    plain = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType)) and f.name != "id"]
    distinct = {"exact_uniqueness": (df.select(*plain), 0.05)}
    if {"latitude", "longitude"} <= has:
        at = df.where("latitude is not null and longitude is not null").select(F.round("latitude", 4).alias("a"), F.round("longitude", 4).alias("o"))
        distinct["coordinate_uniqueness"] = (at, 0.15)
    for name, (part, most) in distinct.items():
        # Two sums over distinct rows with their counts; the hot ones are one row per task.
        n = part.groupBy(*part.columns).agg(F.count(F.lit(1)).alias("_k")).agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("kept"))
        stats = stats.crossJoin(F.broadcast(n.select((1 - F.coalesce(F.try_divide((F.col("all") - F.col("kept")).cast("double"), F.col("all").cast("double")), F.lit(0.0))).alias(name))))
        rows.append((name, F.col(name), 1 - most, "warning"))
    out = []
    for name, score, least, below in rows:
        if below == "share":  # judged by the share itself
            share = F.coalesce(F.col(f"share_{name.split('_')[1]}"), F.lit(0.0))
            status = F.when(share >= least, "pass").when(share >= least - 0.1, "warning").otherwise("fail")
        else:
            status = F.when(F.round(score, 9) >= least, "pass").otherwise(below)
        out.append(F.struct(F.lit(name).alias("check_name"), status.alias("status"), score.cast("double").alias("score")))
    return stats.select(F.explode(F.array(*out)).alias("c")).select("c.*")


def overall(found: DataFrame) -> DataFrame:
    """One row: the raw sum of weighted scores, at most 1, and the same over the sum of the weights."""
    w = None
    for name, weight in vocab.CHECK_WEIGHTS.items():
        hit = F.startswith("check_name", F.lit(f"{name}_"))
        w = F.when(hit, weight) if w is None else w.when(hit, weight)
    w = w.otherwise(0.1)
    return found.agg(F.least(F.lit(1.0), F.sum(F.col("score") * w)).alias("overall_score_raw"), (F.sum(F.col("score") * w) / F.sum(w)).alias("overall_score"), F.count_if(F.col("status") == "fail").alias("n_failed"), F.count_if(F.col("status") == "warning").alias("n_warnings"))


def recommendations(found: DataFrame) -> DataFrame:
    """What to look at, worst first."""
    text = F.when(F.col("score") < 0.7, F.concat(F.lit("Critical: improve "), "check_name")).when(F.col("score") < 0.85, F.concat(F.lit("Improve "), "check_name"))
    return found.select("check_name", "score", text.alias("recommendation")).where("recommendation is not null").orderBy("score", "check_name")


def completeness(df: DataFrame) -> DataFrame:
    """``column, n_missing, missing_share`` for every column, from one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("_rows") - F.col(f"`{c}`")).alias("n_missing")) for c in df.columns])
    return row.select("_rows", F.explode(cells).alias("c")).select("c.column", "c.n_missing", F.try_divide(F.col("c.n_missing").cast("double"), F.col("_rows").cast("double")).alias("missing_share"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``bucket, n`` over equal widths between the smallest and largest value."""
    edges = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    x = F.col(column).cast("double")
    bucket = F.least(F.floor((x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(F.coalesce(bucket, F.lit(0)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r`` of every pair of at most ten columns, from one aggregate."""
    cols = columns[:10]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def assessment(df: DataFrame, n_outliers: int) -> DataFrame:
    """One row: mean completeness of four fields, share without outliers, share of consistent prices per m2, and their mean."""
    fields = [c for c in ("price_mad", "surface_m2", "city", "property_type") if c in df.columns]
    full = reduce(lambda a, b: a + b, [F.count(c) for c in fields]) / (len(fields) * F.nullif(F.count(F.lit(1)), F.lit(0)))
    clean = F.greatest(F.lit(0.0), 1 - F.lit(float(n_outliers)) / F.nullif(F.count(F.lit(1)), F.lit(0)))
    ok = F.avg(F.when(F.col("surface_m2") > 0, P.valid_ppm2(F.col("price_mad") / F.col("surface_m2")).cast("int")))
    return df.agg(full.alias("completeness"), clean.alias("accuracy"), F.coalesce(ok, F.lit(0.0)).alias("consistency")).withColumn("quality", (F.col("completeness") + F.col("accuracy") + F.col("consistency")) / 3)
