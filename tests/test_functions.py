"""Literal cases of the column functions and invariants of the operators."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline.functions import geo, html, price, similarity, stats, text
from hearthline.operators import coordinates, dedup, encoding, images, outliers, splitting, upsert
from hearthline.schema import LISTING, conform


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, want", [("1 500 000 DH", 1500000), ("Price: 850000", 850000), ("2,300,000 MAD", 2300000), ("No price", None), (None, None)])
def test_digits_price(spark, value, want):
    assert one(spark, price.digits_price, value) == want


@pytest.mark.parametrize("value, want", [("80 m²", 80.0), ("120.5 m2", 120.5), ("Surface: 95 m²", 95.0), ("No surface", None)])
def test_surface(spark, value, want):
    assert one(spark, price.surface, value) == want


def test_coordinates_in_url(spark):
    assert tuple(one(spark, html.coordinates_from_url, "https://x/?lat=33.5731&lng=-7.5898")) == (33.5731, -7.5898)
    assert tuple(one(spark, html.coordinates_from_url, "https://x/")) == (None, None)


def test_title_case(spark):
    assert one(spark, text.title_case, "l'hay-riad 3pieces été") == "L'Hay-Riad 3Pieces Été"


def test_standard_boolean_finds_yes_words_first(spark):
    assert [one(spark, text.standard_boolean, v) for v in ("non disponible", "non", "x", None)] == [True, False, None, None]


def test_scale_correction(spark):
    row = spark.range(1).select(price.corrected(F.lit(60000.0), F.lit(None).cast("double")).alias("c")).first()["c"]
    assert (row["price"], row["method"]) == (60_000_000.0, "multiplied_by_1000")


def test_right_closed_bins(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 0.5, 2.0, 20.0, 21.0)], "x double")
    got = [r[0] for r in rows.select(stats.right_closed(F.col("x"), [-1, 0, 2, 5, 20], ["ground", "low", "mid", "high"])).collect()]
    assert got == ["ground", "low", "low", "high", None]


def test_percent_rank_equals_pandas(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), rng.choice([None, 1.0, 2.0, 3.0, 4.0])) for i in range(200)]
    df = spark.createDataFrame(data, "id int, g string, v double")
    pdf = pd.DataFrame(data, columns=["id", "g", "v"]).astype({"v": float})
    got = df.select("id", stats.pct_rank("v", "g").alias("p")).toPandas().set_index("id")["p"].astype(float).sort_index()
    np.testing.assert_allclose(got, pdf.groupby("g")["v"].rank(pct=True), equal_nan=True)
    parted = stats.pct_rank_in(df, "v", ["g"], "p").toPandas().set_index("id")["p"].astype(float).sort_index()
    assert got.equals(parted) or ((got - parted).abs().fillna(0) < 1e-12).all() and (got.isna() == parted.isna()).all()
    whole = stats.pct_rank_global(df, "v", "p").toPandas().set_index("id")["p"].astype(float).sort_index()
    np.testing.assert_allclose(whole, pdf["v"].rank(pct=True), equal_nan=True)


def test_quantile_bins_equal_pandas(spark):
    values = [0.0, 0, 0, 0, 5, 6, 7, 8, 9, 10]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double")
    got = [r["b"] for r in stats.quantile_bins(df, "v", "b").orderBy("id").collect()]
    assert got == pd.qcut(values, 10, labels=False, duplicates="drop").tolist()


def test_geodesic_and_haversine(spark):
    row = spark.range(1).select(geo.geodesic_m(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)).alias("g"), (geo.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)) * 1000).alias("h")).first()
    assert abs(row["g"] - 343_923) < 200 and abs(row["h"] / row["g"] - 1) < 0.006


def test_distance_to_centre_and_airport(spark):
    row = spark.range(1).select(geo.centre_distance_km(F.lit(33.5731), F.lit(-7.5898), F.lit("casablanca")).alias("c"), geo.airport_distance_km(F.lit(33.5731), F.lit(-7.5898), F.lit("casablanca")).alias("a")).first()
    assert row["c"] < 1 and row["a"] > 10


def test_fallback_coordinates_are_stable(spark):
    df = spark.createDataFrame([(1, "rabat", None, None), (2, "nowhere", None, None), (3, "rabat", 34.0, -6.8)], "id long, city string, latitude double, longitude double")
    a, b = (coordinates.fallback_to_centre(df).orderBy("id").collect() for _ in range(2))
    assert a == b and abs(a[0]["latitude"] - 34.0209) <= 0.05 and a[1]["latitude"] is None and a[2]["latitude"] == 34.0


def test_title_score_bounds():
    assert similarity.title_score("villa in rabat", "villa in rabat") == pytest.approx(1.0)
    assert similarity.title_score("", "x") == 0.0


def _listings(spark, n=60):
    rows = [(i, f"Nice flat number {i} downtown", "rabat", "agdal", 34.0 + i * 0.01, -6.8, 500_000.0 + 40_000 * i, 80.0 + i, 3, "apartment", str(i), "a") for i in range(n)]
    rows += [(1000 + i, *rows[i][1:10], str(i), "b") for i in range(0, n, 6)]
    return spark.createDataFrame(rows, "id long, title string, city string, neighborhood string, latitude double, longitude double, price_mad double, surface_m2 double, rooms int, property_type string, source_id string, source_platform string")


def test_duplicates_are_found_and_groups_are_disjoint(spark):
    df = _listings(spark)
    found = dedup.matches(df).collect()
    pairs = {(r["a"], r["b"]) for r in found}
    assert {(i, 1000 + i) for i in range(0, 60, 6)} <= pairs
    groups = dedup.groups(df, dedup.matches(df)).collect()
    assert len({g["id"] for g in groups}) == len(groups)
    kept = dedup.keep_best(conform(df), dedup.groups(df, dedup.matches(df)), "first").where("kept").count()
    assert kept == len({g["group_id"] for g in groups})


def test_blocking_loses_no_feature_match(spark):
    df = conform(_listings(spark, 25), LISTING)
    blocked = {(r["a"], r["b"]) for r in dedup.matches(df).where("match_type = 'features'").collect()}
    a, b = df.alias("a"), df.alias("b")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    every = a.join(b, x("id") < y("id")).where(similarity.feature_similarity(x, y) >= 0.85).select(x("id"), y("id")).collect()
    others = {(r["a"], r["b"]) for r in dedup.matches(df).where("match_type <> 'features'").collect()}
    assert {tuple(r) for r in every} <= blocked | others


def test_split_sizes(spark):
    df = spark.range(103).select(F.col("id"), F.lit("rabat").alias("city_cleaned"), F.col("id").cast("double").alias("price_mad"))
    sizes = {r["split"]: r["count"] for r in splitting.split_by_city(df, least=100).groupBy("split").count().collect()}
    assert sizes == {"test": 21, "val": 21, "train": 61}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1", "x", None, 1.0)], "source_platform string, source_id string, title string, latitude double, longitude double")
    new = spark.createDataFrame([("a", "1", None, 2.0, 3.0), ("a", "2", "y", 1.0, 1.0)], old.schema)
    once = upsert.merge(old, new, ["source_platform", "source_id"], ["title"], ["latitude", "longitude"])
    again = upsert.merge(once.drop("merge_action"), new, ["source_platform", "source_id"], ["title"], ["latitude", "longitude"])
    key = lambda df: sorted(map(tuple, df.drop("merge_action").collect()), key=str)
    assert key(once) == key(again) == [("a", "1", None, 2.0, 1.0), ("a", "2", "y", 1.0, 1.0)]
    assert {r["merge_action"] for r in again.collect()} == {"updated"}


def test_encoder_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, "abc"[i % 3], f"n{i % 7}") for i in range(70)], "id int, property_type string, neighborhood string")
    e = encoding.fit(df)
    e.save(str(tmp_path / "e"))
    again = encoding.Encoder.load(spark, str(tmp_path / "e"))
    key = lambda x: sorted(map(str, x.transform(df).select(*sorted(x.transform(df).columns)).collect()))
    assert key(e) == key(again)
    unseen = e.transform(spark.createDataFrame([(1, "z", "new")], df.schema)).first()
    assert unseen["neighborhood_encoded"] == 0 and unseen["property_type_a"] == 0


def test_isolation_forest_marks_far_rows(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 10, 1000.0).otherwise(F.rand(1)).alias("a"), F.when(F.col("id") < 10, -1000.0).otherwise(F.rand(2)).alias("b"))
    got = outliers.isolation_forest(df, ["a", "b"])
    assert got.where("is_outlier and id < 10").count() == 10 and got.where("is_outlier").count() <= 40


def test_image_measures():
    flat = images.measure(np.full((8, 8, 3), 128, np.uint8))
    noisy = images.measure(np.random.default_rng(1).integers(0, 255, (8, 8, 3), np.uint8))
    assert flat[0] < 1e-6 < noisy[0] and abs(flat[1] - 0.5) < 0.01


def test_trees_of_pages_go_without_the_collector():
    import gc

    from hearthline.sources import dom

    alive = lambda: sum(isinstance(x, dom.Element) for x in gc.get_objects())
    gc.collect()
    gc.disable()
    try:
        before = alive()
        for _ in range(5):
            assert dom.profile("<div><p>a<b>c</b></p></div>")["tags"] == {"div": 1, "p": 1, "b": 1}
            assert dom.listing("<h1>Villa</h1><p>3 chambres</p>", "http://x/a/1")["rooms"] == 3
        assert alive() == before
    finally:
        gc.enable()
