"""Duplicate matches against comparisons of whole cities."""

import random

import pytest
from pyspark.sql import functions as F

from hearthline.functions import similarity
from hearthline.operators import dedup, leaders
from hearthline.schema import conform

SCHEMA = "id long, title string, city string, neighborhood string, latitude double, longitude double, price_mad double, surface_m2 double, source_id string, source_platform string"


def _found(df, **options):
    return {(r["a"], r["b"]): (r["match_type"], r["similarity"]) for r in dedup.matches(df, **options).collect()}


def test_titles_with_typos_meet_without_surface_or_place(spark):
    rows = [
        (1, "appartement moderne centre ville", "rabat", "agdal", None, None, 1_000_000.0, None, "1", "a"),
        (2, "appartment moderne centre ville", "rabat", "agdal", None, None, 1_300_000.0, 80.0, "2", "a"),
        (3, "appartement moderrne centre ville", "rabat", "agdal", 34.0, -6.8, None, 100.0, "3", "a"),
        (4, "appartement moderne centre ville", "rabat", "agdal", None, None, 2_900_000.0, None, "4", "a"),
        # 780 m apart, so that no 60 m cell holds both; their surfaces differ widely.
        (5, "grande villa avec jardin", "rabat", "agdal", 33.9, -6.9, 1_000_000.0, 100.0, "5", "a"),
        (6, "grande vila avec jardin", "rabat", "agdal", 33.907, -6.9, 1_200_000.0, 500.0, "6", "a"),
        (7, "granda villa avec jardin", "rabat", "agdal", 33.93, -6.9, 1_000_000.0, 500.0, "7", "a"),
        # Beyond 60 degrees and over the date line, cells do not hold their distance.
        (8, "petite maison au bord du lac", "nord", "a", 70.0, 20.0, 1_000_000.0, None, "8", "a"),
        (9, "petit maison au bord du lac", "nord", "a", 70.0, 20.025, 1_000_000.0, None, "9", "a"),
        (10, "petite maison au bord du lac", "est", "a", 0.0, 179.998, 1_000_000.0, None, "10", "a"),
        (11, "petit maison au bord du lac", "est", "a", 0.0, -179.998, 1_000_000.0, None, "11", "a"),
    ]
    found = _found(spark.createDataFrame(rows, SCHEMA))
    assert {p for p, (kind, _) in found.items() if kind == "title"} == {(1, 2), (2, 3), (5, 6), (8, 9), (10, 11)}


def test_title_blocks_lose_no_match_of_a_city(spark):
    rng = random.Random(5)
    titles = ["appartement moderne centre ville", "villa avec jardin et piscine", "studio meuble proche tram"]

    def title():
        t = list(rng.choice(titles))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("abcdest ")
        return "".join(t)

    def row(i):
        placed = rng.random() < 0.5
        some = lambda x: None if rng.random() < 0.3 else x
        return (i, title(), rng.choice(["rabat", "fes"]), some(rng.choice(["agdal", "riad"])), 34 + rng.random() / 50 if placed else None, -6.8 + rng.random() / 50 if placed else None, some(1e6 * rng.uniform(0.5, 2)), some(rng.uniform(40, 200)), str(i), "a")

    df = spark.createDataFrame([row(i) for i in range(150)], SCHEMA)
    got, want = _found(df), _found(df, exact_titles=True)
    assert got == want and sum(kind == "title" for kind, _ in got.values()) > 100


def test_names_of_neighborhoods_are_compared_as_titles(spark):
    names = [("Gauthier", "Gauthier Centre Ville"), ("Maarif Extension", "Extension Maarif"), ("Agdal", "Haut Agdal Riad"), ("AGDAL", "agdal"), ("", "Agdal"), (None, "Agdal"), ("Agdal", "Oulfa")]
    rows = []
    for k, pair in enumerate(names):
        rows += [(2 * k + i, "appartement moderne centre ville", f"city {k}", name, None, None, 1_000_000.0 + 200_000 * i, None, str(2 * k + i), "a") for i, name in enumerate(pair)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = _found(df)
    assert {p for p, (kind, _) in found.items() if kind == "title"} == {(2 * k, 2 * k + 1) for k in range(6)}
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.city = b.city AND a.id < b.id"))
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    got = [r["s"] for r in pairs.select(x("id").alias("id"), similarity.location_similarity(x, y).alias("s")).orderBy("id").collect()]
    want = [(1 + (0.5 if not p or not q else similarity.title_score(p, q))) / 2 for p, q in names]
    assert got == pytest.approx(want) and [round(g, 2) for g in got[:3]] == [0.78, 0.78, 0.75]


def test_features_count_the_names_of_neighborhoods_as_titles(spark):
    rows = [(i, f"{i}", "rabat", name, None, None, 1_000_000.0, surface, str(i), "a") for i, (name, surface) in enumerate([("Maarif Extension", 100.0), ("Extension Maarif", 72.0)])]
    # 0.3 + 0.25 * 0.72 + 0.25 * 0.78 + 0.2 = 0.87; an edit distance gives 0.56 in place of 0.78, and 0.82.
    assert {p: kind for p, (kind, _) in _found(spark.createDataFrame(rows, SCHEMA)).items()} == {(0, 1): "features"}


def test_blocks_lose_no_match_by_features_or_place(spark):
    rng = random.Random(11)
    some = lambda x, p=0.15: None if rng.random() < p else x

    def row(i):
        lat, lon = 34 + rng.choice([0, 0, 0.004, 0.02, 0.5]) + rng.random() / 3000, -6.8 + rng.random() / 3000
        placed = rng.random() < 0.8
        return (i, f"listing number {rng.randrange(5)}", rng.choice(["rabat", "fes", None]), some("agdal", 0.3), lat if placed else None, lon if placed else None, some(1e6 * rng.choice([1, 1.05, 1.2, 1.9, 0.0])), some(100.0 * rng.choice([1, 1.1, 1.3, 2.2])), some(rng.randrange(1, 4)), some(rng.choice(["villa", "studio"])), some(str(rng.randrange(60))), rng.choice("ab"))

    schema = "id long, title string, city string, neighborhood string, latitude double, longitude double, price_mad double, surface_m2 double, rooms int, property_type string, source_id string, source_platform string"
    df = spark.createDataFrame([row(i) for i in range(180)], schema)
    got, want = _found(df), _found(df, exact_titles=True)
    assert got == want and {kind for kind, _ in got.values()} == {"coordinates", "features", "source_id", "title"}
    assert _found(df.where("false")) == {}


def test_pairs_of_a_hot_group_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 30)
    monkeypatch.setattr(dedup, "PAIRS_A_TASK", 2000)
    df = spark.range(300).select("id", F.when(F.col("id") < 240, "hot").when(F.col("id") < 290, "cold").alias("k"))
    pairs = dedup.pairs_within(df, ["k"]).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.spark_partition_id().alias("task")).toPandas()
    want = {(a, b) for lo, hi in ((0, 240), (240, 290)) for b in range(lo, hi) for a in range(lo, b)}
    assert len(pairs) == len(want) and set(zip(pairs["a"], pairs["b"])) == want
    assert pairs.groupby("task").size().max() < 0.25 * len(want)


def test_coordinate_part_needs_no_distance_far_away(spark):
    places = [(34.0, -6.8), (34.008, -6.8), (34.0092, -6.8), (35.0, -6.8), (None, -6.8), (35.0, None), (float("nan"), 1.0)]
    rows = [(*p, *q) for p in places for q in places]
    df = spark.createDataFrame(rows, "a_latitude double, a_longitude double, b_latitude double, b_longitude double")
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    m = similarity.metres(a, b)
    plain = F.when(m <= 100, 1.0).when(m <= 500, 0.8).when(m <= 1000, 0.6).when(m.isNotNull(), 0.0)
    got = df.select(similarity.near(a, b).alias("got"), plain.alias("want"), similarity.surely_far(a, b).alias("far")).collect()
    assert all(r["got"] == r["want"] for r in got) and sum(bool(r["far"]) for r in got) > 5


def test_leaders_found_in_turns_give_the_groups_of_all_matches(spark, monkeypatch):
    rng = random.Random(3)
    some = lambda x, p=0.1: None if rng.random() < p else x

    def row(i):
        placed = rng.random() < 0.9
        return (i * 3, rng.choice(["grande villa au jardin", "studio meuble"]), some(rng.choice(["rabat", "fes"])), "agdal", 34 + rng.random() / 5 if placed else None, -6.8 + rng.random() / 50 if placed else None, some(1e6 * rng.uniform(0.6, 1.5)), some(rng.uniform(40, 200)), rng.randrange(1, 3), some(rng.choice(["villa", "studio"])), some(str(rng.randrange(100))), rng.choice("ab"))

    schema = "id long, title string, city string, neighborhood string, latitude double, longitude double, price_mad double, surface_m2 double, rooms int, property_type string, source_id string, source_platform string"
    df = spark.createDataFrame([row(i) for i in range(150)], schema)
    found = dedup.cut(dedup.matches(df))
    greedy = dedup._leaders(found.where("similarity >= 0.85").toPandas())
    want = sorted(greedy[greedy.groupby("group_id")["id"].transform("size") > 1].itertuples(index=False, name=None))
    assert sorted(map(tuple, dedup.groups(df, found).collect())) == want
    monkeypatch.setattr(dedup, "FIRST_IDS", 60)
    assert sorted(map(tuple, dedup.leader_groups(df).collect())) == want and len(want) > 60
    sources = {(r["a"], r["b"]) for r in dedup.matches(df, sources=True).collect()}
    assert sources == {(r["a"], r["b"]) for r in found.where("match_type = 'source_id'").collect()} and sources


LISTINGS = "id long, title string, city string, neighborhood string, latitude double, longitude double, price_mad double, surface_m2 double, rooms int, property_type string, source_id string, source_platform string"


def _dense(seed, n, first=0):
    """Listings of few kinds with gaps, odd values and places beyond the cells."""
    rng = random.Random(seed)
    some = lambda x, p=0.1: None if rng.random() < p else x
    titles = ["Vente grande villa au jardin", "grande villa (neuve) au jardin", "GRANDE VILA AU JARDIN URGENT", "studio meublé centre", "studio", None, "à vendre studio meuble centre"]
    lats = [34.0, 34.0, 34.004, 34.02, 70.0, 89.9, 95.0, float("nan")]

    def row(i):
        lat = rng.choice(lats[:4]) + rng.random() / 2000 if rng.random() < 0.85 else rng.choice(lats)
        price = rng.choice([0.0, -1.0, float("nan")]) if rng.random() < 0.05 else 1e6 * rng.uniform(0.5, 1.5)
        return (first + i, rng.choice(titles), some(rng.choice(["rabat", "fes"]), 0.03), some(rng.choice(["agdal", "Agdal Riad", "riad", ""])), some(lat), some(rng.choice([-6.8, -6.8005, 179.95])), some(price), some(rng.uniform(40, 200)), some(rng.randrange(1, 4)), some(rng.choice(["villa", "studio"])), some(rng.choice(["", str(rng.randrange(60))])), some(rng.choice("ab")))

    return [row(i) for i in range(n)]


@pytest.mark.parametrize(("threshold", "exact"), [(0.85, False), (0.78, False), (0.93, True)])
def test_leaders_sent_to_later_listings_decide_as_the_matchers_do(spark, threshold, exact):
    df = spark.createDataFrame(_dense(21, 260), LISTINGS)
    found = dedup.matches(df, threshold, exact).where(F.col("similarity") >= threshold).toPandas()
    links = {(r.a, r.b) for r in found.itertuples()}
    # By the definition: who is taken by no earlier leader leads.
    leads, want = [], {}
    city = {r["id"]: r["city"] for r in df.collect()}
    for i in sorted(city):
        if city[i] is None:
            continue
        want[i] = next((a for a in leads if (a, i) in links), i)
        if want[i] == i:
            leads.append(i)
    assert set(found["match_type"]) == {"coordinates", "features", "source_id", "title"}
    rows = leaders.columns(conform(df, keep_extra=False).where("city is not null")).toPandas()
    got = {r.id: r.group_id for _, part in rows.groupby("city") for r in leaders.settle(part, threshold).itertuples()}
    assert got == want
    # The same leaders and later listings that were not settled with them.
    first, later = rows[rows["id"] < 120], rows[rows["id"] >= 120]
    heads = first[[want[i] == i for i in first["id"]]]
    took = {r.id: r.group_id for part in leaders.taken(dict(iter(heads.groupby("city"))), threshold)(iter([later])) for r in part.itertuples()}
    assert took == {i: a for i in later["id"] if (a := next((a for a in heads["id"] if (a, i) in links), None)) is not None}


def test_dense_listings_need_no_table_of_pairs(spark, monkeypatch):
    df = spark.createDataFrame(_dense(4, 200), LISTINGS)
    monkeypatch.setattr(dedup, "FIRST_IDS", 40)
    with monkeypatch.context() as m:
        m.setattr(dedup, "PAIRS_AT_ONCE", 0)
        want = sorted(map(tuple, dedup.leader_groups(df).collect()))
    monkeypatch.setattr(dedup, "candidates", None)
    assert sorted(map(tuple, dedup.leader_groups(df).collect())) == want and len(want) > 60
