"""Statistics without a task that holds a column, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.functions import stats as S
from hearthline.operators import features, splitting


@pytest.mark.parametrize("fetched", [S.FETCHED, 20])
def test_quantiles_are_exact(spark, monkeypatch, fetched):
    monkeypatch.setattr(S, "FETCHED", fetched)
    monkeypatch.setattr(S, "ACCURACY", 100 if fetched == 20 else S.ACCURACY)
    rng = np.random.default_rng(3)
    x = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000) * 1e6)
    y = [None if rng.random() < 0.2 else float(v) for v in rng.integers(-5, 5, 3000)]
    df = spark.createDataFrame([(float(a), b, None, 3) for a, b in zip(x, y, strict=True)], "x double, y double, z double, k int").repartition(5)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = S.quantiles(df, {"x": ps, "y": ps, "z": [0.5], "k": [0.3]})
    assert got["x"] == pytest.approx(np.quantile(x, ps).tolist(), rel=1e-12)
    assert got["y"] == pytest.approx(np.quantile([v for v in y if v is not None], ps).tolist(), rel=1e-12)
    assert got["z"] == [None] and got["k"] == [3.0]
    assert S.quantiles(df.where("false"), {"x": [0.5]}) == {"x": [None]}


def test_medians_of_groups(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.integers(9)}", None if rng.random() < 0.1 else float(rng.integers(0, 50))) for _ in range(2000)] + [(None, 1.0), ("alone", 4.0), ("none", None)]
    got = {r["k"]: r["m"] for r in S.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v", "m").collect()}
    groups = {}
    for k, v in rows:
        if k is not None and v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: float(np.median(v)) for k, v in groups.items()}


def test_modes(spark):
    df = spark.createDataFrame([("b", "x", None), ("a", "x", None), (None, "y", None)], "p string, q string, r string")
    assert S.modes(df, ["p", "q", "r"]) == {"p": "a", "q": "x", "r": None}


def test_numbers_and_places(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v")).repartition(7)
    assert all(r["n"] == r["v"] for r in S.numbered(df, ["v"], "n").collect())
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 5, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("city"))
    placed = S.places_by_hash(rows.withColumn("h", F.xxhash64("id", F.lit(9))), ["city"], "id", 9).collect()
    groups = {}
    for r in placed:
        groups.setdefault(r["city"], []).append(r)
    assert sum(map(len, groups.values())) == 3000
    for g in groups.values():
        g.sort(key=lambda r: (r["h"], r["id"]))
        assert [r["_place"] for r in g] == list(range(1, len(g) + 1)) and {r["_size"] for r in g} == {len(g)}


def test_splits_repeat_and_keep_their_shares(spark):
    df = spark.range(1200).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("city_cleaned"), F.rand(1).alias("price_mad"))
    once, again = (sorted((r["id"], r["split"], r["split_combined"]) for r in splitting.split_by_city(d).collect()) for d in (df, df.repartition(6)))
    assert once == again and len(once) == 1200
    counts = {}
    for i, s, _ in once:
        counts[i % 4 == 0, s] = counts.get((i % 4 == 0, s), 0) + 1
    for city, n in ((True, 300), (False, 900)):
        t = math.ceil(n * 0.2)
        v = math.ceil((n - t) * 0.25)
        assert [counts[city, s] for s in ("test", "val", "train")] == [t, v, n - t - v]


def test_neighbour_information_ranks_dependence(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=800)
    rows = [(float(a), float(2 * a + 0.1 * rng.normal()), float(rng.normal()), float(a * a)) for a in y]
    df = spark.createDataFrame(rows, "y double, line double, noise double, square double")
    got = [(r["feature"], r["importance"]) for r in features.neighbour_information(df, "y", ["line", "noise", "square"]).collect()]
    assert got[0] == ("square", 1.0) and [f for f, _ in got] == ["square", "line", "noise"] and got[2][1] < 0.1 < got[1][1]
    # Two normal variables of correlation r share -ln(1 - r^2) / 2.
    a, b = rng.normal(size=(2, 3000))
    assert features.kraskov(a, 0.8 * a + 0.6 * b) == pytest.approx(-math.log(1 - 0.64) / 2, abs=0.06)


def test_summaries(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "id long, price_mad double, rooms int")
    after = df.withColumn("x", F.lit(1.0))
    assert [tuple(r) for r in features.summary(df, after).collect()] == [("engineered", "double", 1), ("original", "bigint", 1), ("original", "double", 1), ("original", "int", 1)]
    assert features.feature_names(after) == ["rooms", "x"]


def test_ranks_in_one_bracket_share_a_sketch(spark, monkeypatch):
    from hearthline.functions import stats

    made, plain = [], stats.F.percentile_approx
    monkeypatch.setattr(stats, "FETCHED", 500)
    monkeypatch.setattr(stats.F, "percentile_approx", lambda *a: made.append(1) or plain(*a))
    df = spark.range(4000).selectExpr("cast((id * 37) % 4000 as double) AS x")
    assert stats.quantiles(df, {"x": [i / 10 for i in range(11)]})["x"] == pytest.approx([399.9 * i for i in range(11)])
    assert len(made) == 1
