"""Points of interest near listings by grid join, and figures that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline import vocab
from hearthline.functions import geo as G
from hearthline.plans.tables import cut


def nearby(left: DataFrame, right: DataFrame, metres: float, left_id: str = "id", salts: int = 1) -> DataFrame:
    """``left_id, poi_id, category, metres`` of points within ``metres``: equal cells, then the distance.

    Points of the right side are sent to the nine cells around their own; ``salts``
    deals each cell's listings over several tasks where cities crowd.
    """
    ly, lx = G.cell(F.col("latitude"), F.col("longitude"), metres)
    ry, rx = G.cell(F.col("latitude"), F.col("longitude"), metres)
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    here = left.where("latitude is not null and longitude is not null").select(F.col(left_id), F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"), ly.alias("_y"), lx.alias("_x"), F.pmod(F.xxhash64(left_id), F.lit(salts)).alias("_s"))
    there = right.select("poi_id", "category", F.col("latitude").alias("_pa"), F.col("longitude").alias("_po"), ry.alias("_y0"), rx.alias("_x0"))
    there = there.withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around)).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    there = there.select("poi_id", "category", "_pa", "_po", (F.col("_y0") + F.col("_dy")).alias("_y"), (F.col("_x0") + F.col("_dx")).alias("_x"), "_s")
    d = G.haversine_km(F.col("_la"), F.col("_lo"), F.col("_pa"), F.col("_po")) * 1000
    return here.join(there, ["_y", "_x", "_s"]).withColumn("metres", d).where(F.col("metres") <= metres).select(left_id, "poi_id", "category", "metres")


def poi_counts(listings: DataFrame, pois: DataFrame, metres: float = 1000.0, id_col: str = "id") -> DataFrame:
    """Counts and least distances by category, and the walkability score."""
    near = nearby(listings, pois, metres, id_col)
    kinds = list(vocab.POI_CATEGORIES)
    counts = near.groupBy(id_col).agg(*[F.count_if(F.col("category") == k).alias(f"{k}_count_1km") for k in kinds], *[F.min(F.when(F.col("category") == k, F.col("metres"))).alias(f"distance_to_nearest_{k}") for k in ("schools", "hospitals")])
    out = listings.join(counts, id_col, "left").fillna(0, [f"{k}_count_1km" for k in kinds])
    walk = F.least(F.lit(100), 2 * (F.col("schools_count_1km") + F.col("restaurants_count_1km") + F.col("shops_count_1km") + F.col("parks_count_1km")))
    return out.withColumn("walkability_score", walk)


def nearest(listings: DataFrame, pois: DataFrame, metres: float, id_col: str = "id", most: float | None = None) -> DataFrame:
    """The nearest point and its distance, looked for within ``metres`` first; NULL without one.

    With ``most`` the radius is doubled for the listings that have found none, up to that
    distance, so dense places never meet the points of a wide circle.
    """
    open_, found, reach = listings, None, metres
    while True:
        near = cut(nearby(open_, pois, reach, id_col).groupBy(id_col).agg(F.min(F.struct("metres", "poi_id")).alias("_n")))
        found = near if found is None else found.unionByName(near)
        if most is None or reach >= most:
            break
        open_, reach = listings.join(found, id_col, "left_anti"), min(2 * reach, most)
    return listings.join(found, id_col, "left").select(*listings.columns, F.col("_n.poi_id").alias("nearest_poi"), F.col("_n.metres").alias("nearest_metres"))


def distances(df: DataFrame) -> DataFrame:
    """Metres to the centre and the airport of the city, and what the former says of the neighborhood."""
    lat, lon, city = F.col("latitude"), F.col("longitude"), F.lower(F.trim("city"))
    centre = G.centre_distance_km(lat, lon, city, vocab.ENRICHMENT_CENTRES)
    return df.withColumns({
        "distance_to_city_center": centre * 1000,
        "distance_to_airport": G.airport_distance_km(lat, lon, city) * 1000,
        "neighborhood_income_level": F.when(centre < 5, "high").when(centre < 15, "medium").when(centre.isNotNull(), "low"),
        "street_quality_score": F.when(centre < 5, 8.5).when(centre < 15, 7.0).when(centre.isNotNull(), 5.5),
    })


def with_census(df: DataFrame) -> DataFrame:
    """City figures, a table of a few fixed rows."""
    table = df.sparkSession.createDataFrame(vocab.CENSUS, "_city string, population long, density_per_km2 long, unemployment_rate double, literacy_rate double")
    return df.join(F.broadcast(table), F.lower("city") == F.col("_city"), "left").drop("_city")


def with_infrastructure(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in vocab.INFRASTRUCTURE.items()})


def with_relations(listings: DataFrame, enrichments: DataFrame, images: DataFrame) -> DataFrame:
    """Listings with their enrichment (a struct, NULL without one) and their images (an array, empty without any).

    One row per listing: a listing has one enrichment, and images are gathered by
    listing before the join; those of one listing are bounded by its page.
    """
    facts = enrichments.select(F.col("listing_id").alias("_e"), F.struct(*[f"`{c}`" for c in enrichments.columns if c != "listing_id"]).alias("enrichment"))
    shown = [c for c in images.columns if c != "listing_id"]
    photos = images.groupBy(F.col("listing_id").alias("_i")).agg(F.array_sort(F.collect_list(F.struct("original_url", *[f"`{c}`" for c in shown if c != "original_url"]))).alias("images"))
    out = listings.join(facts, F.col("id") == F.col("_e"), "left").join(photos, F.col("id") == F.col("_i"), "left").drop("_e", "_i")
    return out.withColumn("images", F.coalesce("images", F.array().cast(photos.schema["images"].dataType)))
