"""Registered queries of the core library, each with the SQL that gives the same rows.

Listings are derived from the ``part`` table by plain expressions that both engines
read alike; the operators are then applied to them. Doubles are rounded, as sums may
run in another order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import vocab
from hearthline.functions import dates as D
from hearthline.functions import geo as G
from hearthline.functions import html as H
from hearthline.functions import price as P
from hearthline.functions import similarity as M
from hearthline.functions import stats as S
from hearthline.functions import text as X
from hearthline.operators import coordinates, dedup, encoding, enrich, features, images, monitoring, outliers, prices, quality, splitting, textclean, upsert
from hearthline.plans import workflow
from hearthline.sources import dom
from hearthline.sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a table loader, with its SQL if there is any."""

    def wrap(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: f(partial(_table, spark, sf_dir))
        if sql:
            _SQL[key] = sql
        return f

    return wrap


LISTING_EXPRESSIONS = [
    "p_partkey AS id",
    "p_name AS title",
    "CASE p_partkey % 7 WHEN 0 THEN 'casablanca' WHEN 1 THEN 'rabat' WHEN 2 THEN 'marrakech' WHEN 3 THEN 'tangier' WHEN 4 THEN 'fes' WHEN 5 THEN 'agadir' ELSE 'oujda' END AS city",
    "CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE concat('zone ', CAST(p_size % 9 AS VARCHAR(9))) END AS neighborhood",
    "CASE p_partkey % 5 WHEN 0 THEN 'apartment' WHEN 1 THEN 'house' WHEN 2 THEN 'villa' WHEN 3 THEN 'studio' ELSE 'barn' END AS property_type",
    "CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 89 = 0 THEN p_retailprice * 1e5 WHEN p_partkey % 83 = 0 THEN p_retailprice * 1e1 ELSE p_retailprice * 1e3 END AS price_mad",
    "CASE WHEN p_partkey % 61 = 0 THEN NULL WHEN p_partkey % 59 = 0 THEN 5e3 ELSE p_size * 8e0 + 5e0 END AS surface_m2",
    "CAST(p_partkey % 7 AS INT) AS rooms",
    "CAST(p_partkey % 3 AS INT) AS bathrooms",
    "CAST(p_partkey % 24 - 1 AS INT) AS floor",
    "CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE 3.05e1 + (p_partkey % 5200) / 1e3 END AS latitude",
    "CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE -9.4e0 + (p_partkey % 4400) / 1e3 END AS longitude",
    "CASE WHEN p_partkey % 2 = 0 THEN TRUE WHEN p_partkey % 31 = 0 THEN NULL ELSE FALSE END AS parking",
    "p_partkey % 3 = 0 AS elevator",
    "p_partkey % 5 = 0 AS pool",
    "p_partkey % 4 = 0 AS garden",
    "CAST(1980 + p_partkey % 45 AS INT) AS construction_year",
]
L = f"WITH l AS (SELECT {', '.join(LISTING_EXPRESSIONS)} FROM part) "
LP = f"WITH l0 AS (SELECT {', '.join(LISTING_EXPRESSIONS)} FROM part), l AS (SELECT *, price_mad / NULLIF(surface_m2, 0) AS price_per_m2 FROM l0) "


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "listings":
        return _table(spark, sf_dir, "part").selectExpr(*[e.replace("VARCHAR(9)", "STRING") for e in LISTING_EXPRESSIONS])
    if name == "priced":
        return _table(spark, sf_dir, "listings").withColumn("price_per_m2", S.ratio(F.col("price_mad"), F.col("surface_m2")))
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def n_rows() -> Column:
    return F.count(F.lit(1)).alias("n")


CASE_CATEGORY = "CASE WHEN {0} < 500000 THEN 'budget' WHEN {0} < 1500000 THEN 'mid_range' WHEN {0} < 5000000 THEN 'premium' WHEN {0} IS NOT NULL THEN 'luxury' END"

# -- scans, projections, joins, sets ------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN 50000 AND 100000 AND l_quantity BETWEEN 10 AND 40")
def scan_filter_range(t):
    return t("lineitem").where(F.col("l_extendedprice").between(50_000, 100_000) & F.col("l_quantity").between(10, 40)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query(f"""SELECT p_brand, {CASE_CATEGORY.format('l_extendedprice * 40')} AS category, count(*) AS n, round(avg(l_extendedprice / l_quantity), 4) AS avg_unit, round(sum(l_extendedprice), 2) AS total
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def price_category_by_segment(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("category", P.category(F.col("l_extendedprice") * 40))
    return rows.groupBy("p_brand", "category").agg(n_rows(), r(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).alias("avg_unit"), r(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_join(t):
    return t("orders").join(t("customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_join(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def except_rows(t):
    return t("customer").select("c_custkey").subtract(t("orders").where("o_totalprice > 200000").select("o_custkey"))


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_values(t):
    return t("customer").groupBy(F.col("c_mktsegment").alias("value")).agg(n_rows()).orderBy(F.desc("n"), "value").limit(10)


@query(LP + "SELECT id, city, price_mad, 1.0::DOUBLE AS price_rate FROM l WHERE price_mad BETWEEN 50000 AND 100000000")
def valid_prices(t):
    return t("priced").where(P.valid_price(F.col("price_mad"))).select("id", "city", "price_mad", F.lit(1.0).alias("price_rate"))


# -- ratios, bins, transforms ---------------------------------------------------


@query(L + """SELECT id, round(price_mad / NULLIF(rooms, 0), 4) AS price_per_room, round(price_mad / NULLIF(bathrooms, 0), 4) AS price_per_bathroom, round(surface_m2 / NULLIF(rooms, 0), 4) AS surface_per_room,
round(rooms / NULLIF(surface_m2, 0), 6) AS room_density, round(bathrooms / NULLIF(rooms, 0)::DOUBLE, 6) AS bathroom_to_room_ratio,
coalesce(floor = 0, false)::INT AS is_ground_floor, coalesce(floor > 5, false) AS is_top_floor,
CASE WHEN floor > -1 AND floor <= 0 THEN 'ground' WHEN floor > 0 AND floor <= 2 THEN 'low' WHEN floor > 2 AND floor <= 5 THEN 'mid' WHEN floor > 5 AND floor <= 20 THEN 'high' END AS floor_category FROM l""")
def ratio_features(t):
    x = features.basic(t("listings"))
    return x.select("id", *[r(c).alias(c) for c in ("price_per_room", "price_per_bathroom", "surface_per_room")], *[r(c, 6).alias(c) for c in ("room_density", "bathroom_to_room_ratio")], "is_ground_floor", "is_top_floor", "floor_category")


@query(L + """SELECT id, round(ln(1 + greatest(coalesce(price_mad, 0), 0)), 6) AS price_mad_log, round(sqrt(greatest(coalesce(price_mad, 0), 0)), 4) AS price_mad_sqrt,
round(sign(coalesce(price_mad, 0)) * ln(1 + abs(coalesce(price_mad, 0))), 6) AS price_mad_boxcox FROM l""")
def log_sqrt_boxcox(t):
    x = features.transformations(t("listings"), ("price_mad",))
    return x.select("id", r("price_mad_log", 6).alias("price_mad_log"), r("price_mad_sqrt").alias("price_mad_sqrt"), r("price_mad_boxcox", 6).alias("price_mad_boxcox"))


@query(L + """SELECT id, CASE WHEN surface_m2 > 0 AND surface_m2 <= 50 THEN 'small' WHEN surface_m2 > 50 AND surface_m2 <= 100 THEN 'medium' WHEN surface_m2 > 100 AND surface_m2 <= 150 THEN 'large'
WHEN surface_m2 > 150 AND surface_m2 <= 250 THEN 'very_large' WHEN surface_m2 > 250 AND surface_m2 <= 1000 THEN 'mansion' END AS size_category,
(2024 - construction_year)::INT AS property_age, CASE WHEN 2024 - construction_year > 0 AND 2024 - construction_year <= 5 THEN 'new' WHEN 2024 - construction_year > 5 AND 2024 - construction_year <= 15 THEN 'recent'
WHEN 2024 - construction_year > 15 AND 2024 - construction_year <= 30 THEN 'mature' WHEN 2024 - construction_year > 30 AND 2024 - construction_year <= 100 THEN 'old' END AS age_category,
(2024 - construction_year <= 2)::INT AS is_new_construction, (coalesce(parking::INT, 0) + elevator::INT + pool::INT + garden::INT)::INT AS amenity_count,
(parking::INT * 1.0::DOUBLE + elevator::INT * 1.5::DOUBLE + pool::INT * 3.0::DOUBLE + garden::INT * 2.0::DOUBLE) AS luxury_score FROM l""")
def cut_bins(t):
    return features.property_(t("listings")).select("id", "size_category", "property_age", "age_category", "is_new_construction", "amenity_count", "luxury_score")


@query("""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(p_retailprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM part)
SELECT p_partkey, greatest(0, len(list_filter(edges, lambda e: e < p_retailprice)) - 1)::INT AS bin FROM part, e""")
def qcut_deciles(t):
    return S.quantile_bins(t("part"), "p_retailprice", "bin").select("p_partkey", "bin")


@query(L + ", m AS (SELECT max(abs(longitude + 7.5) * 111) AS far FROM l) SELECT id, round(1 - abs(longitude + 7.5) * 111 / far, 6) AS premium, round(1 / (1 + abs(longitude + 7.5) * 111), 6) AS proximity, coalesce(abs(longitude + 7.5) * 111 < 5, false)::INT AS is_coastal FROM l, m")
def location_features(t):
    x = t("listings").withColumns({"distance_to_city_center_km": G.coast_distance_km(F.col("longitude")), "distance_to_coast_km": G.coast_distance_km(F.col("longitude"))})
    return features.location(x).select("id", r("location_premium_score", 6).alias("premium"), r("coastal_proximity_score", 6).alias("proximity"), "is_coastal")


# -- group statistics and windows -------------------------------------------------


@query(L + """SELECT id, round(avg(price_mad) OVER w, 4) AS city_price_mean, round(median(price_mad) OVER w, 4) AS city_price_median, round(stddev_samp(price_mad) OVER w, 4) AS city_price_std,
count(price_mad) OVER w AS city_listing_count, round(price_mad - avg(price_mad) OVER w, 4) AS price_deviation_from_city FROM l WINDOW w AS (PARTITION BY city)""")
def group_stats_mapback(t):
    x = features.market(t("listings").withColumn("city_cleaned", F.col("city")))
    return x.select("id", *[r(c).alias(c) for c in ("city_price_mean", "city_price_median", "city_price_std")], "city_listing_count", r("price_deviation_from_city").alias("price_deviation_from_city"))


@query(L + "SELECT id, round((surface_m2 - avg(surface_m2) OVER w) / NULLIF(stddev_samp(surface_m2) OVER w, 0), 6) AS z FROM l WINDOW w AS (PARTITION BY city)")
def zscore_in_group(t):
    return t("listings").select("id", r(S.zscore_in("surface_m2", "city"), 6).alias("z"))


@query(L + """, m AS (SELECT *, concat(neighborhood, city, rooms) AS place FROM l) SELECT id, CASE WHEN place IS NOT NULL THEN count(*) OVER w END AS popularity, CASE WHEN place IS NOT NULL AND count(price_mad) OVER w >= 5 THEN round(avg(price_mad) OVER w, 4) END AS mean,
round(avg(price_mad) OVER v, 4) AS type_mean, round(median(price_mad) OVER v, 4) AS type_median, round(price_mad - avg(price_mad) OVER v, 4) AS premium FROM m WINDOW w AS (PARTITION BY place), v AS (PARTITION BY property_type)""".replace("concat(neighborhood, city, rooms)", "neighborhood || city || rooms"))
def group_mean_min5(t):
    x = t("listings").withColumns({"neighborhood_cleaned": F.concat("neighborhood", "city", F.col("rooms").cast("string")), "property_type_cleaned": F.col("property_type")})
    x = features.market(x)
    return x.select("id", F.col("neighborhood_popularity").alias("popularity"), r("neighborhood_price_mean").alias("mean"), r("property_type_price_mean").alias("type_mean"), r("property_type_price_median").alias("type_median"), r("price_premium_over_type").alias("premium"))


RANK_SQL = "(rank() OVER (PARTITION BY {g} ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0::DOUBLE) / count({v}) OVER (PARTITION BY {g})"


@query(L + f"SELECT id, CASE WHEN price_mad IS NOT NULL THEN round({RANK_SQL.format(g='city', v='price_mad')}, 8) END AS pct FROM l")
def pct_rank_in_group(t):
    return S.pct_rank_in(t("listings").select("id", "city", "price_mad"), "price_mad", ["city"], "pct").select("id", r("pct", 8).alias("pct"))


@query("SELECT o_orderkey, round((rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0::DOUBLE) / count(*) OVER (), 8) AS pct FROM orders")
def pct_rank_global(t):
    return S.pct_rank_global(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", "pct").select("o_orderkey", r("pct", 8).alias("pct"))


@query(L + f"SELECT id, CASE WHEN price_mad IS NOT NULL AND count(price_mad) OVER (PARTITION BY city) > 10 THEN round({RANK_SQL.format(g='city', v='price_mad')}, 8) END AS pct, {CASE_CATEGORY.format('price_mad')} AS price_category FROM l")
def pct_rank_min10(t):
    x = prices.price_features(t("priced"))
    return x.select("id", r("price_percentile_in_city", 8).alias("pct"), "price_category")


@query("""SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 6) END AS mean, CASE WHEN count(value) OVER w >= 3 THEN round(stddev_samp(value) OVER w, 6) END AS std
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def rolling10_min3(t):
    mean, std = S.rolling("value", ["ts", "event_id"], ["event_type"])
    return t("events").select("event_id", r(mean, 6).alias("mean"), r(std, 6).alias("std"))


@query(LP + """SELECT id, round(avg(price_per_m2) OVER w, 4) AS price_per_m2_mean_by_property_type_cleaned, round(stddev_samp(price_per_m2) OVER w, 4) AS price_per_m2_std_by_property_type_cleaned,
round((price_per_m2 - avg(price_per_m2) OVER w) / NULLIF(stddev_samp(price_per_m2) OVER w, 0), 6) AS price_per_m2_zscore_by_property_type_cleaned FROM l WINDOW w AS (PARTITION BY property_type)""")
def aggregation_features(t):
    x = features.aggregations(t("priced").withColumn("property_type_cleaned", F.col("property_type")))
    p = "price_per_m2_{}_by_property_type_cleaned"
    return x.select("id", r(p.format("mean")).alias(p.format("mean")), r(p.format("std")).alias(p.format("std")), r(p.format("zscore"), 6).alias(p.format("zscore")))


@query(LP + ", ".join(["SELECT id"] + [f"round(price_per_m2 * (city = '{c}')::INT, 4) AS price_m2_city_{c}" for c in ("agadir", "casablanca", "fes", "marrakech", "oujda", "rabat", "tangier")]) + " FROM l")
def interaction_features(t):
    x = features.interactions(t("priced").withColumn("city_cleaned", F.col("city")))
    return x.select("id", *[r(c).alias(c) for c in x.columns if c.startswith("price_m2_city_")])


# -- outliers -------------------------------------------------------------------------

IQR_SQL = """, q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM l)
SELECT id, '{c}' AS feature, 'iqr' AS method, {c}::DOUBLE AS value FROM l, q WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)"""


@query(L + IQR_SQL.format(c="price_mad"))
def iqr_outliers(t):
    return outliers.iqr_outliers(t("listings"), ["price_mad"]).select("id", "feature", "method", "value")


@query(L + ", m AS (SELECT avg(surface_m2) AS m, stddev_pop(surface_m2) AS s FROM l) SELECT id, 'surface_m2' AS feature, 'zscore' AS method, surface_m2 AS value FROM l, m WHERE abs(surface_m2 - m) > 3 * s")
def zscore_outliers(t):
    return outliers.zscore_outliers(t("listings"), ["surface_m2"]).select("id", "feature", "method", "value")


def _limits(k: int, column: str) -> str:
    """Tests for values outside a city's limits."""
    lo = " ".join(f"WHEN '{c}' THEN {v[k][0]}" for c, v in vocab.CITIES.items())
    hi = " ".join(f"WHEN '{c}' THEN {v[k][1]}" for c, v in vocab.CITIES.items())
    d = vocab.CITIES[vocab.DEFAULT_CITY][k]
    return f"({column} < CASE city {lo} ELSE {d[0]} END OR {column} > CASE city {hi} ELSE {d[1]} END)"


DOMAIN_SQL = f"""SELECT id, 'price_mad' AS feature, 'domain' AS method, price_mad AS value FROM l WHERE {_limits(0, 'price_mad')}
UNION ALL SELECT id, 'price_per_m2', 'domain', price_per_m2 FROM l WHERE {_limits(1, 'price_per_m2')}
UNION ALL SELECT id, 'surface_m2', 'domain', surface_m2 FROM l WHERE surface_m2 < 15 OR surface_m2 > 2000
UNION ALL SELECT id, 'rooms', 'domain', rooms::DOUBLE FROM l WHERE rooms < 1 OR rooms > 15"""


@query(f"{LP} SELECT id, feature, method, round(value, 4) AS value FROM ({DOMAIN_SQL})")
def domain_outliers(t):
    return outliers.domain_outliers(t("priced")).select("id", "feature", "method", r("value").alias("value"))


@query(L + ", q AS (SELECT quantile_cont(price_mad, 0.05) AS a, quantile_cont(price_mad, 0.95) AS b FROM l) SELECT id, CASE WHEN price_mad IS NOT NULL THEN round(least(greatest(price_mad, a), b), 4) END AS price_mad FROM l, q")
def cap_outliers(t):
    return outliers.handle(t("listings"), "cap", ["price_mad"]).select("id", r("price_mad").alias("price_mad"))


@query(f"""{LP}, d AS (SELECT id FROM ({DOMAIN_SQL})), q AS (SELECT quantile_cont(price_mad, [0.25, 0.75]) AS p, quantile_cont(surface_m2, [0.25, 0.75]) AS s, quantile_cont(rooms, [0.25, 0.75]) AS o, quantile_cont(price_per_m2, [0.25, 0.75]) AS m FROM l),
i AS (SELECT id FROM l, q WHERE price_mad < p[1] - 1.5 * (p[2] - p[1]) OR price_mad > p[2] + 1.5 * (p[2] - p[1]) OR surface_m2 < s[1] - 1.5 * (s[2] - s[1]) OR surface_m2 > s[2] + 1.5 * (s[2] - s[1])
 OR rooms < o[1] - 1.5 * (o[2] - o[1]) OR rooms > o[2] + 1.5 * (o[2] - o[1]) OR price_per_m2 < m[1] - 1.5 * (m[2] - m[1]) OR price_per_m2 > m[2] + 1.5 * (m[2] - m[1]))
SELECT id FROM l WHERE id NOT IN (SELECT id FROM d) AND id NOT IN (SELECT id FROM i)""")
def remove_outliers(t):
    return outliers.handle(t("priced"), "remove").select("id")


@query(f"{LP} SELECT feature, count(*) AS n, count(DISTINCT id) AS n_listings FROM ({DOMAIN_SQL}) GROUP BY feature")
def outlier_counts(t):
    return outliers.domain_outliers(t("priced")).groupBy("feature").agg(n_rows(), F.countDistinct("id").alias("n_listings"))


@query()
def isolation_forest(t):
    rows = t("lineitem").select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"), "l_quantity", "l_extendedprice", "l_discount")
    return outliers.isolation_forest(rows, ["l_quantity", "l_extendedprice", "l_discount"]).groupBy("is_outlier").agg(n_rows(), r(F.avg("score"), 3).alias("avg_score"))


# -- encodings ---------------------------------------------------------------------------


@query("WITH f AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n < 5 THEN 4 ELSE n END AS p_type_encoded FROM part JOIN f USING (p_type)")
def freq_encode(t):
    e = encoding.Encoder({"p_type": "frequency"}, {"p_type": encoding.frequency_table(t("part"), "p_type")})
    return e.transform(t("part")).select("p_partkey", F.col("p_type_encoded").cast("long").alias("p_type_encoded"))


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def label_encode(t):
    e = encoding.Encoder({"c_mktsegment": "label"}, {"c_mktsegment": encoding.label_table(t("customer"), "c_mktsegment")})
    return e.transform(t("customer")).select("c_custkey", F.col("c_mktsegment_encoded").cast("long").alias("code"))


@query(L + ", ".join(["SELECT id"] + [f"(property_type = '{v}')::INT AS property_type_{v}" for v in ("apartment", "barn", "house", "studio", "villa")]) + " FROM l")
def onehot_encode(t):
    x = encoding.fit(t("listings").select("id", "property_type"), {"property_type": "onehot"}).transform(t("listings"))
    return x.select("id", *[c for c in x.columns if c.startswith("property_type_")])


@query(L + f"SELECT id, CASE {CASE_CATEGORY.format('price_mad')} WHEN 'budget' THEN 0 WHEN 'mid_range' THEN 1 WHEN 'premium' THEN 2 WHEN 'luxury' THEN 3 END AS code, coalesce(parking, false)::INT AS parking_encoded FROM l")
def ordinal_boolean_encode(t):
    x = t("listings").withColumn("price_category", P.category(F.col("price_mad")))
    x = encoding.Encoder({"price_category": "ordinal", "parking": "boolean"}).transform(x)
    return x.select("id", F.col("price_category_encoded").alias("code"), "parking_encoded")


@query(L + """SELECT id, concat_ws('_', city, property_type) AS city_property_interaction, count(*) OVER (PARTITION BY city, property_type) AS property_frequency_in_city,
count(*) OVER (PARTITION BY city, neighborhood) AS neighborhood_frequency_in_city, coalesce(parking, false)::INT * elevator::INT AS parking_and_elevator, pool::INT * garden::INT AS pool_and_garden FROM l""")
def pair_frequency(t):
    return encoding.combinations(t("listings")).select("id", "city_property_interaction", "property_frequency_in_city", "neighborhood_frequency_in_city", "parking_and_elevator", "pool_and_garden")


@query("""SELECT * FROM (SELECT 'p_brand' AS "column", CASE WHEN count(DISTINCT p_brand) > 100 THEN 'frequency' WHEN count(DISTINCT p_brand) > 20 THEN 'label' WHEN count(DISTINCT p_brand) > 2 THEN 'onehot' ELSE 'boolean' END AS method, count(DISTINCT p_brand) / count(*) AS u FROM part
UNION ALL SELECT 'p_type', CASE WHEN count(DISTINCT p_type) > 100 THEN 'frequency' WHEN count(DISTINCT p_type) > 20 THEN 'label' WHEN count(DISTINCT p_type) > 2 THEN 'onehot' ELSE 'boolean' END, count(DISTINCT p_type) / count(*) FROM part
UNION ALL SELECT 'p_name', CASE WHEN count(DISTINCT p_name) > 100 THEN 'frequency' WHEN count(DISTINCT p_name) > 20 THEN 'label' WHEN count(DISTINCT p_name) > 2 THEN 'onehot' ELSE 'boolean' END, count(DISTINCT p_name) / count(*) FROM part) WHERE u < 0.95""".replace("SELECT * FROM (", 'SELECT "column", method FROM (', 1))
def encoding_plan(t):
    found = encoding.plan(t("part"))
    return t("part").sparkSession.createDataFrame(sorted(found.items()), "column string, method string")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: NOT list_contains(['STOP'], x)) AS w FROM documents),
t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT term, count(*) AS df, sum(tf) AS a FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
k AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM d, n WHERE df >= 5 AND df <= 0.95 * n ORDER BY a DESC, term LIMIT 50), x AS (SELECT doc_id, term, tf * idf AS x FROM c JOIN k USING (term))
SELECT doc_id AS id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""".replace("'STOP'", ", ".join(f"'{w}'" for w in encoding.STOP_WORDS)))
def tfidf_top50(t):
    return encoding.tfidf(t("documents"), "doc_id", "text").select("id", "term", r("weight", 6).alias("weight"))


# -- scaling, selection, imputation ----------------------------------------------------------


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def standard_scale(t):
    return features.scale(t("part"), ["p_retailprice"]).select("p_partkey", r("p_retailprice", 6).alias("p_retailprice"))


@query("SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS p_size FROM part")
def minmax_scale(t):
    return features.scale(t("part"), ["p_size"], "minmax").select("p_partkey", r("p_size", 6).alias("p_size"))


@query("WITH q AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part) SELECT p_partkey, round((p_retailprice - q[2]) / (q[3] - q[1]), 6) AS p_retailprice FROM part, q")
def robust_scale(t):
    return features.scale(t("part"), ["p_retailprice"], "robust").select("p_partkey", r("p_retailprice", 6).alias("p_retailprice"))


@query("""WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS q, corr(l_discount, l_extendedprice) AS d, corr(l_tax, l_extendedprice) AS x FROM lineitem), p AS (SELECT n, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([q, d, x]) AS r FROM c)
SELECT feature, round(r * r * (n - 2) / (1 - r * r), 3) AS f_score FROM p""")
def f_regression(t):
    return features.f_scores(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).select("feature", r("f_score", 3).alias("f_score"))


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 8) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 8) FROM lineitem")
def corr_matrix(t):
    return quality.correlations(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", r("r", 8).alias("r"))


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS q, corr(l_discount, l_extendedprice) AS d, corr(l_tax, l_extendedprice) AS x FROM lineitem), p AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([q, d, x]) AS r FROM c)
SELECT feature FROM (SELECT feature FROM p ORDER BY r * r / (1 - r * r) DESC, feature LIMIT 2) UNION ALL SELECT 'l_extendedprice'""")
def selected_features(t):
    x = features.select_best(t("lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax"), "l_extendedprice", 2)
    return x.sparkSession.createDataFrame([(c,) for c in x.columns], "feature string")


EDGES_SQL = "list_sort(list_distinct(quantile_cont({0}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))"


@query(f"""WITH e AS (SELECT {EDGES_SQL.format('l_extendedprice')} AS y, {EDGES_SQL.format('l_quantity')} AS q, {EDGES_SQL.format('l_discount')} AS d, {EDGES_SQL.format('l_tax')} AS x FROM lineitem),
b AS (SELECT greatest(0, len(list_filter(y, lambda v: v < l_extendedprice)) - 1) AS y, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature,
 unnest([greatest(0, len(list_filter(q, lambda v: v < l_quantity)) - 1), greatest(0, len(list_filter(d, lambda v: v < l_discount)) - 1), greatest(0, len(list_filter(x, lambda v: v < l_tax)) - 1)]) AS x FROM lineitem, e),
c AS (SELECT feature, x, y, count(*)::DOUBLE AS n FROM b GROUP BY ALL), w AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS a, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM c),
m AS (SELECT feature, sum(n / a * ln(n * a / (nx * ny))) AS mi FROM w GROUP BY 1) SELECT feature, round(mi / max(mi) OVER (), 4) AS importance FROM m""")
def mutual_information(t):
    x = features.mutual_information(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return x.select("feature", r("importance").alias("importance"))


@query()
def neighbour_information(t):
    x = features.neighbour_information(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return x.select("feature", r("importance").alias("importance"))


@query(L + ", s AS (SELECT median(price_mad) AS p, median(surface_m2) AS a FROM l), k AS (SELECT neighborhood FROM l WHERE neighborhood IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT id, round(coalesce(price_mad, p), 4) AS price_mad, coalesce(surface_m2, a) AS surface_m2, coalesce(l.neighborhood, k.neighborhood) AS neighborhood FROM l, s, k")
def median_mode_impute(t):
    x = splitting.impute(t("listings"), ["price_mad", "surface_m2"], ["neighborhood"])
    return x.select("id", r("price_mad").alias("price_mad"), "surface_m2", "neighborhood")


# -- splits -----------------------------------------------------------------------------------------

SPLIT_SQL = L + """, e AS (SELECT quantile_cont(price_mad, [0.01, 0.99]) AS e FROM l), f AS (SELECT l.* FROM l, e WHERE price_mad BETWEEN e[1] AND e[2]), c AS (SELECT city, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 100),
s AS (SELECT city, n, ceil(n * 0.2::DOUBLE)::BIGINT AS t FROM c), v AS (SELECT city, n, t, ceil((n - t) * 0.25::DOUBLE)::BIGINT AS v FROM s)"""


@query(SPLIT_SQL + " SELECT city, 'test' AS split, t AS n FROM v UNION ALL SELECT city, 'val', v FROM v UNION ALL SELECT city, 'train', n - t - v FROM v")
def split_sizes(t):
    x = splitting.split_by_city(splitting.prepare(t("listings")))
    return x.groupBy(F.col("city_cleaned").alias("city"), "split").agg(n_rows())


@query(L + """, s AS (SELECT city AS city_cleaned, CASE id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, price_mad FROM l),
g AS (SELECT city_cleaned, split, count(*) AS n, avg(price_mad) AS m, stddev_samp(price_mad) AS d FROM s GROUP BY ALL) SELECT city_cleaned, split, n, round(m, 2) AS mean, round(d, 2) AS std, round(n / sum(n) OVER (PARTITION BY city_cleaned), 4) AS share FROM g""")
def split_statistics(t):
    kind = F.when(F.col("id") % 5 == 0, "test").when(F.col("id") % 5 == 1, "val").otherwise("train")
    x = splitting.split_statistics(t("listings").select(F.col("city").alias("city_cleaned"), kind.alias("split"), "price_mad"))
    return x.select("city_cleaned", "split", "n", r("mean", 2).alias("mean"), r("std", 2).alias("std"), r("share", 4).alias("share"))


@query(SPLIT_SQL + " SELECT city, 'test' AS split, least(t, 25) AS n FROM v UNION ALL SELECT city, 'val', least(v, 25) FROM v UNION ALL SELECT city, 'train', least(n - t - v, 100) FROM v")
def split_balanced(t):
    x = splitting.balance(splitting.split_by_city(splitting.prepare(t("listings"))), least=50, most=100)
    return x.groupBy(F.col("city_cleaned").alias("city"), "split").agg(n_rows())


# -- quality ---------------------------------------------------------------------------------------------

QUALITY_SQL = L + """, a AS (SELECT count(*) AS n, (count(price_mad) + count(surface_m2) + count(city) + count(property_type)) / (4 * count(*)) AS c1, (count(rooms) + count(neighborhood) + count(latitude) + count(longitude)) / (4 * count(*)) AS c2,
(count(bathrooms) + count(floor) + count(parking) + count(elevator)) / (4 * count(*)) AS c3,
count_if(price_mad BETWEEN 50000 AND 100000000) / count(price_mad) AS p, count_if(latitude BETWEEN 21 AND 36 AND longitude BETWEEN -17.5 AND -1) / count(latitude) AS g, count_if(surface_m2 BETWEEN 15 AND 2000) / count(surface_m2) AS s,
count_if(price_mad / surface_m2 BETWEEN 1000 AND 200000) / count(price_mad / surface_m2) AS ps, count_if(surface_m2 / rooms BETWEEN 10 AND 100 AND rooms > 0) / count(CASE WHEN rooms > 0 THEN surface_m2 END) AS rs,
count_if(property_type <> 'barn') / count(*) AS t, CASE WHEN count_if(rooms NOT BETWEEN 1 AND 20) > 0 THEN 0.8 ELSE 1.0 END AS i FROM l),
d AS (SELECT count(*) / max(n) AS u FROM (SELECT DISTINCT * EXCLUDE (id) FROM l), a), x AS (SELECT count(DISTINCT (round(latitude, 4), round(longitude, 4))) / count(latitude) AS u FROM l WHERE latitude IS NOT NULL)
SELECT check_name, round(score, 6) AS score FROM (SELECT 'completeness_critical' AS check_name, least(c1 / 0.95, 1) AS score FROM a UNION ALL SELECT 'completeness_important', least(c2 / 0.8, 1) FROM a UNION ALL SELECT 'completeness_optional', least(c3 / 0.5, 1) FROM a
UNION ALL SELECT 'price_validity', p FROM a UNION ALL SELECT 'coordinate_validity', g FROM a UNION ALL SELECT 'surface_validity', s FROM a UNION ALL SELECT 'price_surface_consistency', ps FROM a UNION ALL SELECT 'room_surface_consistency', rs FROM a
UNION ALL SELECT 'city_name_accuracy', 1.0 FROM a UNION ALL SELECT 'property_type_accuracy', t FROM a UNION ALL SELECT 'data_type_integrity', 7 / 9 FROM a UNION ALL SELECT 'range_integrity', i FROM a
UNION ALL SELECT 'exact_uniqueness', u FROM d UNION ALL SELECT 'coordinate_uniqueness', u FROM x)"""


@query(QUALITY_SQL)
def quality_checks(t):
    return quality.checks(t("listings")).select("check_name", r("score", 6).alias("score"))


OVERALL_SQL = QUALITY_SQL.replace("SELECT check_name, round(score, 6) AS score FROM (", ", k AS (SELECT check_name, score::DOUBLE AS score FROM (") + """), j AS (SELECT check_name, score, CASE split_part(check_name, '_', 1) WHEN 'completeness' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS w,
CASE WHEN check_name IN ('completeness_critical', 'completeness_important', 'completeness_optional') THEN CASE WHEN score >= 1 THEN 'pass' WHEN score * CASE check_name WHEN 'completeness_critical' THEN 0.95 WHEN 'completeness_important' THEN 0.8 ELSE 0.5 END >= CASE check_name WHEN 'completeness_critical' THEN 0.85 WHEN 'completeness_important' THEN 0.7 ELSE 0.4 END THEN 'warning' ELSE 'fail' END
WHEN round(score, 9) >= CASE check_name WHEN 'price_validity' THEN 0.95 WHEN 'coordinate_validity' THEN 0.9 WHEN 'surface_validity' THEN 0.95 WHEN 'price_surface_consistency' THEN 0.9 WHEN 'room_surface_consistency' THEN 0.85 WHEN 'city_name_accuracy' THEN 0.8 WHEN 'property_type_accuracy' THEN 0.75 WHEN 'data_type_integrity' THEN 0.8 WHEN 'range_integrity' THEN 1.0 WHEN 'exact_uniqueness' THEN 0.95 ELSE 0.85 END THEN 'pass'
WHEN check_name LIKE '%validity' THEN 'fail' ELSE 'warning' END AS status FROM k)
SELECT round(least(1, sum(score * w)), 6) AS overall_score_raw, round(sum(score * w) / sum(w), 6) AS overall_score, count_if(status = 'fail')::BIGINT AS n_failed, count_if(status = 'warning')::BIGINT AS n_warnings FROM j"""


@query(OVERALL_SQL)
def quality_overall(t):
    x = quality.overall(quality.checks(t("listings")))
    return x.select(r("overall_score_raw", 6).alias("overall_score_raw"), r("overall_score", 6).alias("overall_score"), "n_failed", "n_warnings")


@query(L + "SELECT 'price_mad' AS \"column\", count(*) - count(price_mad) AS n_missing FROM l UNION ALL SELECT 'surface_m2', count(*) - count(surface_m2) FROM l UNION ALL SELECT 'neighborhood', count(*) - count(neighborhood) FROM l ORDER BY n_missing DESC LIMIT 10")
def missing_top(t):
    return quality.completeness(t("listings").select("price_mad", "surface_m2", "neighborhood")).select("column", "n_missing").orderBy(F.desc("n_missing")).limit(10)


@query("WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem) SELECT least(floor((l_extendedprice - a) / (b - a) * 50), 49)::INT AS bucket, count(*) AS n FROM lineitem, e GROUP BY 1")
def histogram50(t):
    return quality.histogram(t("lineitem"), "l_extendedprice")


@query(r"""SELECT 'lang' AS "column", count(lang) AS n_present, count(*) - count(lang) AS n_missing, round(avg(length(coalesce(lang, 'None'))), 6) AS avg_length, count(DISTINCT lang) AS n_distinct FROM documents
UNION ALL SELECT 'text', count(text), count(*) - count(text), round(avg(length(coalesce(text, 'None'))), 6), count(DISTINCT text) FROM documents""")
def text_statistics(t):
    x = textclean.text_statistics(t("documents"), ["lang", "text"])
    return x.select("column", "n_present", "n_missing", r("avg_length", 6).alias("avg_length"), "n_distinct")


@query("SELECT count(*) - count(DISTINCT text) AS n_duplicates, count(DISTINCT text) AS n_texts FROM documents")
def dedup_exact(t):
    sized = t("documents").groupBy("text").agg(n_rows())
    return sized.agg((F.sum("n") - F.count(F.lit(1))).alias("n_duplicates"), F.count(F.lit(1)).alias("n_texts"))


# -- text ----------------------------------------------------------------------------------------------------

W = X.WORD


@query(rf"""SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text), '<[^>]+>', '', 'g'), '!{{3,}}', '!!!', 'g'), '\?{{3,}}', '???', 'g'), '\.{{4,}}', '...', 'g'),
'(^|[^{W}])[0-9]{{10,}}($|[^{W}])', '\1[PHONE]\2', 'g'), '(^|[^{W}])[{W}][{W}.%+-]*@[{W}.-]+\.[A-Za-z|]{{2,}}', '\1[EMAIL]', 'g'), '\s+', ' ', 'g')), '') AS description FROM documents""")
def text_clean_description(t):
    return t("documents").select("doc_id", X.clean_description(F.col("text")).alias("description"))


@query(rf"""WITH a AS (SELECT doc_id, translate(trim(text), '{X._ACCENTED}', '{X._PLAIN}') AS t FROM documents)
SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(^|[^{W}])avenue($|[^{W}])', '\1av\2', 'gi'), '(^|[^{W}])boulevard($|[^{W}])', '\1bd\2', 'gi'), '(^|[^{W}])place($|[^{W}])', '\1pl\2', 'gi'), '(^|[^{W}])quartier($|[^{W}])', '\1qt\2', 'gi'), '[^{W}\s,.-]', '', 'g'), '\s+', ' ', 'g')), '') AS address FROM a""")
def text_clean_address(t):
    return t("documents").select("doc_id", X.clean_address(F.col("text")).alias("address"))


TITLE_SQL = r"array_to_string(list_transform(regexp_extract_all({0}, '(\p{{L}}+|\P{{L}}+)'), lambda w: upper(w[1]) || lower(w[2:])), '')"


@query("SELECT p_partkey, " + TITLE_SQL.format("p_name || ' l''hay-riad 3pieces'") + " AS title FROM part")
def title_case(t):
    return t("part").select("p_partkey", X.title_case(F.concat("p_name", F.lit(" l'hay-riad 3pieces"))).alias("title"))


@query(rf"""SELECT doc_id, translate(text, '{X._ACCENTED}', '{X._PLAIN}') AS plain FROM documents""")
def text_remove_accents(t):
    return t("documents").select("doc_id", X.remove_accents(F.col("text")).alias("plain"))


CITY_TEXTS = ["Casa", " RABAT-Salé ", "Marrakesh", "tanger ville", "Fès", "agadir-ida", "Oujda", "bni mellal", "", "unknown town", "el jadida", "Kénitra!"]
TYPE_TEXTS = ["Appartement", "villa moderne", "Terrain agricole", "local commercial", "Entrepôt", "grande maison", "riad", "barn", "", "APP. 3", "parcelle 12"]
FLAG_TEXTS = ["oui", "Non", "10", "non disponible", "sans", "maybe", "TRUE", "0", "avec garage", ""]
FLOOR_TEXTS = ["RDC", "3ème étage", "sous-sol", "dernier", "floor 012", "penthouse", "mezzanine", "rez de chaussée", "", "-1"]
STATE_TEXTS = ["Très bon", "Excellent état", "neuf", "mauvais", "à rénover", "moyen", "renovated", "strange", "", "Parfait"]


def _values(values: list[str]) -> str:
    """Texts by key over the whole part table."""
    return f"(SELECT p_partkey AS k, list_extract([{', '.join(repr(v) for v in values)}], CAST(p_partkey % {len(values)} + 1 AS INT)) AS x FROM part) v"


def _variant_sql(variants: list[tuple[str, str]], both: bool) -> str:
    exact = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in variants)
    part = " ".join(f"WHEN contains(y, '{a}')" + (f" OR contains('{a}', y)" if both else "") + f" THEN '{b}'" for a, b in variants)
    return f"coalesce(CASE y {exact} END, CASE {part} END, y)"


def _literal(t, values: list[str]) -> DataFrame:
    at = (F.col("p_partkey") % len(values) + 1).cast("int")
    return t("part").select(F.col("p_partkey").alias("k"), F.element_at(F.array(*[F.lit(v) for v in values]), at).alias("x"))


@query(rf"WITH y AS (SELECT k, nullif(trim(regexp_replace(regexp_replace(translate(lower(trim(x)), '{X._ACCENTED}', '{X._PLAIN}'), '[^{W}\s-]', '', 'g'), '\s+', ' ', 'g')), '') AS y FROM {_values(CITY_TEXTS)}) SELECT k, {_variant_sql(vocab.CITY_VARIANTS, True)} AS city FROM y")
def city_standardise(t):
    return _literal(t, CITY_TEXTS).select("k", X.clean_city(F.col("x")).alias("city"))


@query(rf"WITH y AS (SELECT k, nullif(trim(regexp_replace(regexp_replace(translate(lower(trim(x)), '{X._ACCENTED}', '{X._PLAIN}'), '[^{W}\s]', ' ', 'g'), '\s+', ' ', 'g')), '') AS y FROM {_values(TYPE_TEXTS)}) SELECT k, {_variant_sql(vocab.TYPE_VARIANTS, False)} AS kind FROM y")
def type_standardise(t):
    return _literal(t, TYPE_TEXTS).select("k", X.clean_property_type(F.col("x")).alias("kind"))


def _any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(f"SELECT k, CASE WHEN {_any_sql('lower(x)', vocab.TRUE_WORDS)} THEN true WHEN {_any_sql('lower(x)', vocab.FALSE_WORDS)} THEN false END AS flag FROM {_values(FLAG_TEXTS)}")
def boolean_standardise(t):
    return _literal(t, FLAG_TEXTS).select("k", X.standard_boolean(F.col("x")).alias("flag"))


@query(f"WITH y AS (SELECT k, nullif(translate(trim(lower(x)), '{X._ACCENTED}', '{X._PLAIN}'), '') AS y FROM {_values(STATE_TEXTS)}) SELECT k, CASE " + " ".join(f"WHEN {_any_sql('y', w)} THEN '{n}'" for n, w in vocab.CONDITION_WORDS) + " ELSE y END AS state FROM y")
def condition_standardise(t):
    return _literal(t, STATE_TEXTS).select("k", X.standard_condition(F.col("x")).alias("state"))


@query(f"WITH y AS (SELECT k, nullif(trim(lower(x)), '') AS y FROM {_values(FLOOR_TEXTS)}) SELECT k, CASE WHEN regexp_extract(y, '[0-9]+') <> '' THEN 'floor_' || CAST(CAST(regexp_extract(y, '[0-9]+') AS INT) AS VARCHAR) " + " ".join(f"WHEN {_any_sql('y', w)} THEN '{n}'" for n, w in vocab.FLOOR_WORDS) + " ELSE y END AS floor FROM y")
def floor_standardise(t):
    return _literal(t, FLOOR_TEXTS).select("k", X.standard_floor(F.col("x")).alias("floor"))


@query("SELECT doc_id, " + ", ".join(f"{_any_sql('lower(text)', w)} AS {n}" for n, w in vocab.FEATURE_WORDS.items()) + " FROM documents")
def description_features(t):
    return t("documents").select("doc_id", X.description_features(F.col("text")).alias("f")).select("doc_id", "f.*")


@query(r"SELECT doc_id, length(text) AS description_length, len(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+')) AS description_word_count, len(regexp_extract_all(lower(text), '" + "|".join(vocab.POSITIVE_WORDS) + "')) AS description_positive_sentiment, len(regexp_extract_all(lower(text), '" + "|".join(vocab.NEGATIVE_WORDS) + "')) AS description_negative_sentiment, " + ", ".join(f"contains(lower(text), '{w}')::INT AS title_has_{w}" for w in vocab.TITLE_WORDS) + " FROM documents")
def text_features(t):
    x = features.texts(t("documents").select("doc_id", F.col("text").alias("description_cleaned"), F.col("text").alias("title_cleaned")))
    names = ["description_length", "description_word_count", "description_positive_sentiment", "description_negative_sentiment"]
    return x.select("doc_id", *[F.col(c).cast("long").alias(c) for c in names], *[f"title_has_{w}" for w in vocab.TITLE_WORDS])


@query(rf"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (new) - urgent sale'), '\s*(urgent|opportunity|occasion)[^\n]*$', ''), '\s*\([^)]*\)\s*', '', 'g'), '[^{W}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM part""")
def match_titles(t):
    return t("part").select("p_partkey", X.match_title(F.concat("p_name", F.lit(" (new) - urgent sale"))).alias("title"))


# -- html ------------------------------------------------------------------------------------------------------

PLAIN_SQL = r"trim(regexp_replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("SELECT page_id, nullif(" + PLAIN_SQL.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)") + ", '') AS title, " + PLAIN_SQL.format("html") + " AS plain FROM pages")
def html_title_text(t):
    return t("pages").select("page_id", H.title(F.col("html")).alias("title"), H.plain(F.col("html")).alias("plain"))


@query("""SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) GROUP BY 1""")
def html_links(t):
    return t("pages").select(F.explode(H.links(F.col("html"))).alias("link")).groupBy("link").agg(n_rows())


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '/a/([0-9]+)', 1), ''), nullif(regexp_extract(url, '/pa/([0-9]+)', 1), ''), nullif(regexp_extract(url, '/([0-9]+)(?:$|/)', 1), ''), split_part(rtrim(url, '/'), '/', -1)) AS source_id FROM pages")
def html_source_id(t):
    return t("pages").select("page_id", H.source_id(F.col("url")).alias("source_id"))


@query(r"WITH u AS (SELECT page_id, url || '&lat=' || CAST(page_id % 50 AS VARCHAR) || '.5&lng=-' || CAST(page_id % 9 AS VARCHAR) || '.25' AS u FROM pages) SELECT page_id, CAST(page_id % 50 AS VARCHAR)::DOUBLE + 0.5 AS latitude, -(page_id % 9 + 0.25)::DOUBLE AS longitude FROM u")
def html_coordinates(t):
    u = F.concat("url", F.lit("&lat="), (F.col("page_id") % 50).cast("string"), F.lit(".5&lng=-"), (F.col("page_id") % 9).cast("string"), F.lit(".25"))
    return t("pages").select("page_id", H.coordinates_from_url(u).alias("c")).select("page_id", "c.*")


@query("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '{p}')) AS {n}" for p, n in (("<a ", "n_links"), ("<p[ >]", "n_paragraphs"), ("<script", "n_scripts"), ("<meta", "n_meta"), ("<img", "n_images"), ("class=", "n_classes"))) + " FROM pages")
def html_profile(t):
    return t("pages").select("page_id", *H.profile(F.col("html")))


#: Listing pages composed from the part table: nested blocks, a breadcrumb in place of a location on every third, and text to be passed over.
PAGE_SQL = """'<html><head><style>.price {x: 1}</style><script>var map = {"lat": 33.' || (p_partkey % 90 + 10) || ', "lng": -7.5};</script></head><body><nav class="main breadcrumb"><a href="/">Home</a><a>Ville ' || p_partkey % 4 || '</a></nav><div class="top title"><h1> ' || p_name || '
 ' || p_partkey || '</h1></div><div class="box"><div class="old-price">n/a</div><span class="price tag"><b>' || p_partkey || ' 000</b> DH <i>net</i></span></div><div class="adDetails"><div><span>' || p_size || ',5 m²</span></div><p>' || (p_partkey % 6 + 1) || ' pièces, 2 salles de bain</p></div>'
 || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<p class="listing-location"><a>Hay ' || p_partkey % 5 || '</a>, Ville ' || p_partkey % 7 || '</p>' END || '<div class="listing-description"><div>First part.</div><div>Second <b>part</b>.</div></div><div class="photos"><a><img src="//img.example.com/' || p_partkey || '.jpg"></a><img data-src="/b.png"><img src="//img.example.com/' || p_partkey || '.jpg"></div>
<div class="agent-box"><span class="agent-name">Agency ' || p_partkey % 11 || '</span> tel 0522 12 34 56</div><div class="features-list"><ul><li>Parking</li><li> Pool </li></ul></div></body></html>'"""


@query("""SELECT 'https://x.example.com/fr/a/' || p_partkey || '/offer' AS source_url, CAST(p_partkey AS VARCHAR) AS source_id, regexp_replace(trim(p_name || ' ' || p_partkey), '\\s+', ' ', 'g') AS title, nullif((p_partkey * 1000)::DOUBLE, 0) AS price_mad, p_size + 0.5::DOUBLE AS surface_m2, (p_partkey % 6 + 1)::INT AS rooms, 2::INT AS bathrooms,
CASE WHEN p_partkey % 3 <> 0 THEN 'Hay ' || p_partkey % 5 END AS neighborhood, 'Ville ' || CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 ELSE p_partkey % 7 END AS city, CAST('33.' || (p_partkey % 90 + 10) AS DOUBLE) AS latitude, -7.5::DOUBLE AS longitude, 'First part.Second part.' AS description,
'https://img.example.com/' || p_partkey || '.jpg|https://x.example.com/b.png' AS images, 'Agency ' || p_partkey % 11 AS agent_name, '0522 12 34 56' AS agent_phone, 'parking|pool' AS amenities FROM part""")
def html_listings(t):
    pages = t("part").selectExpr("concat('https://x.example.com/fr/a/', p_partkey, '/offer') AS url", f"{PAGE_SQL} AS html")
    x = dom.listings(pages, "https://x.example.com")
    joined = {"images": F.array_join("image_urls", "|"), "amenities": F.array_join("amenities", "|")}
    return x.withColumns(joined).select("source_url", "source_id", "title", "price_mad", "surface_m2", "rooms", "bathrooms", "neighborhood", "city", "latitude", "longitude", "description", "images", "agent_name", "agent_phone", "amenities")


@query()
def html_page_listings(t):
    from hearthline.sources.readers import parse_pages

    return parse_pages(t("pages")).select("source_url", "source_id", "title", "city", "neighborhood", "price_mad", "surface_m2", "rooms")


@query("SELECT url, len(regexp_extract_all(html, '<script')) AS scripts, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def html_profiles(t):
    count = lambda tag: F.coalesce(F.col("tags")[tag], F.lit(0)).cast("long")
    return dom.profiles(t("pages")).select("url", count("script").alias("scripts"), count("p").alias("paragraphs"))


# -- prices ---------------------------------------------------------------------------------------------------------

PRICE_TEXTS = [("1 500 000 DH", 1500000.0, "MAD", 0.9), ("850,000 MAD", 850000.0, "MAD", 0.9), ("120000€", 1320000.0, "EUR", 0.9), ("$ 50,000.50", 500005.0, "USD", 0.9), ("£90 000", 1125000.0, "GBP", 0.9), ("about 700000", 700000.0, "MAD", 0.5), ("1.500.000 dh", 0.0, "MAD", 0.9), ("2,300,000 dirham", 2300000.0, "MAD", 0.9)]


@query("SELECT p_partkey AS k, value, currency, confidence FROM part JOIN (VALUES " + ", ".join(f"({k}, {v}::DOUBLE, '{c}', {f}::DOUBLE)" for k, (_, v, c, f) in enumerate(PRICE_TEXTS)) + ", (8, NULL, 'UNKNOWN', 0.0)) v(i, value, currency, confidence) ON p_partkey % 9 = i")
def price_parse(t):
    return _literal(t, [x[0] for x in PRICE_TEXTS] + ["no price"]).select("k", P.to_mad(F.col("x")).alias("m")).select("k", "m.value", "m.currency", "m.confidence")


@query("SELECT p_partkey, CAST(p_partkey * 10 AS BIGINT) AS digits, CAST(p_size AS DOUBLE) AS surface, p_size AS rooms FROM part")
def number_parse(t):
    return t("part").select("p_partkey", P.digits_price(F.concat(F.lit("Price: "), F.col("p_partkey").cast("string"), F.lit("0 DH"))).alias("digits"), P.surface(F.concat(F.lit("Surface: "), F.col("p_size").cast("string"), F.lit(" m²"))).alias("surface"), P.first_integer(F.concat(F.col("p_size").cast("string"), F.lit(" chambres, 2 sdb"))).alias("rooms"))


SCALE_SQL = """CASE WHEN price_mad > 50000000 AND price_mad / 100 BETWEEN 50000 AND 100000000 THEN 'divided_by_100'
WHEN price_mad < 100000 AND price_mad * 1000 BETWEEN 50000 AND 100000000 AND (surface_m2 IS NULL OR price_mad * 1000 / surface_m2 BETWEEN 1000 AND 200000) THEN 'multiplied_by_1000'
WHEN price_mad / surface_m2 > 500000 AND price_mad / 10 BETWEEN 50000 AND 100000000 AND price_mad * 0.1::DOUBLE / surface_m2 BETWEEN 1000 AND 200000 THEN 'divided_by_10'
WHEN price_mad / surface_m2 < 500 AND price_mad * 10 BETWEEN 50000 AND 100000000 AND price_mad * 10 / surface_m2 BETWEEN 1000 AND 200000 THEN 'multiplied_by_10' ELSE 'no_correction' END"""


@query(L + f", m AS (SELECT *, {SCALE_SQL} AS method FROM l) SELECT id, method, round(price_mad * CASE method WHEN 'divided_by_100' THEN 1e-2 WHEN 'multiplied_by_1000' THEN 1e3 WHEN 'divided_by_10' THEN 1e-1 WHEN 'multiplied_by_10' THEN 1e1 ELSE 1e0 END, 2) AS price_mad FROM m")
def scaling_correction(t):
    x = prices.correct_scale(t("listings"))
    return x.select("id", F.col("price_normalization_method").alias("method"), r("price_mad", 2).alias("price_mad"))


@query(L + """, p AS (SELECT *, CASE WHEN price_mad BETWEEN 50000 AND 100000000 THEN price_mad END AS p FROM l), c AS (SELECT *, p / NULLIF(surface_m2, 0) AS m FROM p)
SELECT id, round(p, 2) AS price_mad, round(CASE WHEN m BETWEEN 1000 AND 200000 THEN m END, 4) AS price_per_m2, CASE WHEN p IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS price_confidence FROM c""")
def price_normalise(t):
    x = prices.normalise_prices(t("listings"))
    return x.select("id", r("price_mad", 2).alias("price_mad"), r("price_per_m2").alias("price_per_m2"), "price_confidence")


LEVEL_SQL = "CASE " + " ".join(f"WHEN city = '{c}' THEN CASE WHEN price_per_m2 < {v[2][0]} THEN 'below_market' WHEN price_per_m2 < {v[2][1]} THEN 'market_rate' WHEN price_per_m2 < {v[2][2]} THEN 'above_market' ELSE 'premium_market' END" for c, v in vocab.CITIES.items()) + " END"


@query(f"{LP} SELECT id, CASE WHEN price_per_m2 IS NOT NULL THEN {LEVEL_SQL} END AS level FROM l")
def price_levels(t):
    return t("priced").select("id", P.ppm2_category(F.col("price_per_m2"), F.col("city")).alias("level"))


@query(LP + """, q AS (SELECT quantile_cont(price_mad, [0.25, 0.75]) AS q FROM l) SELECT count(price_mad) AS n_prices, min(price_mad) AS min_price, max(price_mad) AS max_price, round(avg(price_mad), 4) AS avg_price, round(median(price_mad), 4) AS median_price,
count_if(abs(price_per_m2 - price_mad / NULLIF(surface_m2, 0)) > 0.01 * abs(price_per_m2))::BIGINT AS n_inconsistent, count_if(price_mad < q[1] - 3 * (q[2] - q[1]) OR price_mad > q[2] + 3 * (q[2] - q[1]))::BIGINT AS n_extreme FROM l, q""")
def price_consistency(t):
    return prices.consistency_report(t("priced")).withColumns({"avg_price": r("avg_price"), "median_price": r("median_price")})


@query(L + """, p AS (SELECT price_mad BETWEEN 50000 AND 100000000 AS ok, price_mad / NULLIF(surface_m2, 0) AS m FROM l) SELECT count(*) AS n_records, count_if(ok)::BIGINT AS n_prices, count_if(ok AND m BETWEEN 1000 AND 200000)::BIGINT AS n_price_per_m2,
round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS mean_confidence, min(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS min_confidence, max(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS max_confidence FROM p""")
def price_confidence(t):
    return prices.confidence_report(prices.normalise_prices(t("listings"))).withColumn("mean_confidence", r("mean_confidence", 6))


@query("SELECT currency, count(*) AS n FROM part JOIN (VALUES " + ", ".join(f"({k}, '{c}')" for k, (_, _, c, _) in enumerate(PRICE_TEXTS)) + ", (8, 'UNKNOWN')) v(i, currency) ON p_partkey % 9 = i GROUP BY 1")
def price_currencies(t):
    rows = _literal(t, [x[0] for x in PRICE_TEXTS] + ["no price"]).select("k", F.col("x").alias("price_text"))
    return prices.currency_distribution(prices.normalise_prices(rows))


# -- geography -------------------------------------------------------------------------------------------------------


def _haversine(lat: str, lon: str) -> str:
    h = f"(pow(sin(radians({lat} - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians({lat})) * pow(sin(radians({lon} - longitude) / 2), 2))"
    return f"2 * 6371 * atan2(sqrt({h}), sqrt(1 - {h}))"


CENTRE_SQL = "CASE city " + " ".join(f"WHEN '{c}' THEN {_haversine(str(v[3][0]), str(v[3][1]))}" for c, v in vocab.CITIES.items()) + " END"


@query(f"{L} SELECT id, round({CENTRE_SQL}, 5) AS centre_km, round(abs(longitude + 7.5) * 111, 5) AS coast_km FROM l")
def distance_to_centre(t):
    x = coordinates.geographic_columns(t("listings"))
    return x.select("id", r("distance_to_city_center_km", 5).alias("centre_km"), r("distance_to_coast_km", 5).alias("coast_km"))


@query(f"""{L}, d AS (SELECT id, latitude, longitude, {CENTRE_SQL} AS d FROM l), s AS (SELECT id, latitude, latitude BETWEEN 21 AND 36 AND longitude BETWEEN -17.5 AND -1 AS box, (CASE WHEN latitude BETWEEN 21 AND 36 AND longitude BETWEEN -17.5 AND -1 THEN 0.4 ELSE -0.5 END)::DOUBLE
+ (CASE WHEN d IS NULL THEN 0 WHEN d <= 50 THEN 0.4 WHEN d <= 100 THEN 0.2 ELSE -0.3 END)::DOUBLE
+ (CASE WHEN (abs(latitude - round(latitude)) < 1e-6 AND abs(longitude - round(longitude)) < 1e-6) OR length(split_part(CAST(latitude AS VARCHAR), '.', 2)) > 10 OR length(split_part(CAST(longitude AS VARCHAR), '.', 2)) > 10 THEN -0.4 ELSE 0 END)::DOUBLE AS score FROM d)
SELECT id, CASE WHEN latitude IS NULL THEN false ELSE round(score, 6) >= 0.3 AND box END AS is_valid, CASE WHEN latitude IS NULL THEN 0.0 ELSE round(greatest(0, score), 4) END AS confidence FROM s""")
def coordinate_validate(t):
    x = coordinates.validate_coordinates(t("listings"))
    return x.select("id", F.col("coordinate_check.is_valid").alias("is_valid"), r(F.col("coordinate_check.confidence")).alias("confidence"))


POI_SQL = "poi AS (SELECT s_suppkey AS poi_id, CASE s_suppkey % 5 WHEN 0 THEN 'schools' WHEN 1 THEN 'hospitals' WHEN 2 THEN 'restaurants' WHEN 3 THEN 'shops' ELSE 'parks' END AS category, 3.05e1 + (s_suppkey * 37 % 5200) / 1e3 AS plat, -9.4e0 + (s_suppkey * 37 % 4400) / 1e3 AS plon FROM supplier)"


def _pois(t) -> DataFrame:
    return t("supplier").selectExpr("s_suppkey AS poi_id", "CASE s_suppkey % 5 WHEN 0 THEN 'schools' WHEN 1 THEN 'hospitals' WHEN 2 THEN 'restaurants' WHEN 3 THEN 'shops' ELSE 'parks' END AS category", "3.05e1 + (s_suppkey * 37 % 5200) / 1e3 AS latitude", "-9.4e0 + (s_suppkey * 37 % 4400) / 1e3 AS longitude")


NEAR_SQL = f", {POI_SQL}, n AS (SELECT l.id, poi_id, category, {_haversine('plat', 'plon')} * 1000 AS m FROM l, poi), k AS (SELECT * FROM n WHERE m <= 1000)"


@query(L + NEAR_SQL + """, c AS (SELECT id, count_if(category = 'schools') AS s, count_if(category = 'restaurants') AS r, count_if(category = 'shops') AS h, count_if(category = 'parks') AS p, min(CASE WHEN category = 'schools' THEN m END) AS ds FROM k GROUP BY 1)
SELECT l.id, coalesce(s, 0)::BIGINT AS schools_count_1km, coalesce(r, 0)::BIGINT AS restaurants_count_1km, round(ds, 2) AS distance_to_nearest_schools, least(100, 2 * coalesce(s + r + h + p, 0))::BIGINT AS walkability_score FROM l LEFT JOIN c ON l.id = c.id""")
def poi_walkability(t):
    x = enrich.poi_counts(t("listings"), _pois(t))
    return x.select("id", "schools_count_1km", "restaurants_count_1km", r("distance_to_nearest_schools", 2).alias("distance_to_nearest_schools"), F.col("walkability_score").cast("long").alias("walkability_score"))


@query(L + NEAR_SQL + " SELECT id, min(poi_id) AS nearest_poi, round(min(m), 2) AS nearest_metres FROM (SELECT id, poi_id, m, rank() OVER (PARTITION BY id ORDER BY m, poi_id) AS k FROM k) WHERE k = 1 GROUP BY id")
def nearest_poi(t):
    return enrich.nearest(t("listings"), _pois(t), 1000).where("nearest_poi is not null").select("id", "nearest_poi", r("nearest_metres", 2).alias("nearest_metres"))


@query(L + ", c AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {p}, {d})" for c, p, d, _, _ in vocab.CENSUS) + ") c(city, population, density)) SELECT id, c.population::BIGINT AS population, c.density::BIGINT AS density_per_km2 FROM l LEFT JOIN c USING (city)")
def census_lookup(t):
    return enrich.with_census(t("listings")).select("id", "population", "density_per_km2")


@query(L + ", g AS (SELECT DISTINCT city || ' x' AS a FROM l) SELECT id, CASE WHEN latitude IS NULL AND neighborhood IS NOT NULL THEN 30.5::DOUBLE ELSE latitude END AS latitude, CASE WHEN latitude IS NULL AND neighborhood IS NOT NULL THEN 0.8::DOUBLE END AS geocoding_confidence FROM l")
def geocode_cache(t):
    rows = t("listings")
    cache = rows.where("neighborhood is not null").select(X.full_address(F.col("neighborhood"), F.col("city")).alias("address"), F.lit(30.5).alias("lat"), F.lit(-7.0).alias("lon")).distinct()
    return coordinates.geocode_missing(rows, cache).select("id", "latitude", "geocoding_confidence")


# -- time ---------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS scraping_year, month(o_orderdate)::INT AS scraping_month, (isodow(o_orderdate) - 1)::INT AS scraping_day_of_week, quarter(o_orderdate)::INT AS scraping_quarter,
CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS scraping_season FROM orders""")
def time_features(t):
    return t("orders").select("o_orderkey", *D.parts(F.col("o_orderdate").cast("timestamp")))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000)::BIGINT AS days_on_market, coalesce(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000) <= 7, false)::INT AS is_new FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def days_on_market(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = D.days_between(F.col("l_shipdate"), F.col("o_orderdate"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", days.alias("days_on_market"), F.coalesce(days <= 7, F.lit(False)).cast("int").alias("is_new"))


# -- duplicates, merges, logs ------------------------------------------------------------------------------------------


def _copies(t) -> DataFrame:
    """Listings and slightly changed copies of a tenth of them."""
    rows = t("listings").withColumns({"source_platform": F.lit("a"), "source_id": F.col("id").cast("string"), "scraped_at": F.lit(None).cast("timestamp"), "description": F.lit(None).cast("string")})
    again = rows.where("id % 10 = 0").withColumns({"id": F.col("id") + 10_000_000, "source_platform": F.lit("b"), "price_mad": F.col("price_mad") * 1.02})
    return rows.unionByName(again)


@query(L + ", s AS (SELECT id FROM l WHERE id % 10 = 0) SELECT id AS a, id + 10000000 AS b, 'source_id' AS match_type FROM s")
def dedup_source_matches(t):
    return dedup.matches(_copies(t), sources=True).select("a", "b", "match_type")


@query()
def dedup_groups(t):
    rows = _copies(t)
    grouped = dedup.leader_groups(rows)
    return dedup.keep_best(rows, grouped, "keep_most_complete")


@query(L + """, p AS (SELECT a.id AS a, b.id AS b, a.price_mad AS pa, b.price_mad AS pb, a.surface_m2 AS sa, b.surface_m2 AS sb, a.rooms = b.rooms AS r, a.property_type = b.property_type AS t,
 2 * 6371000 * atan2(sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)), sqrt(1 - (pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) AS m
 FROM l a JOIN l b ON a.city = b.city AND a.floor = b.floor AND a.bathrooms = b.bathrooms AND a.id < b.id)
SELECT a, b, round(0.3 * CASE WHEN pa > 0 AND pb > 0 THEN least(pa, pb) / greatest(pa, pb) ELSE 0 END + 0.25 * CASE WHEN sa > 0 AND sb > 0 THEN least(sa, sb) / greatest(sa, sb) ELSE 0 END
+ 0.25 * CASE WHEN m IS NULL THEN 1.5 / 2 ELSE (1.5 + CASE WHEN m <= 100 THEN 1 WHEN m <= 500 THEN 0.8 WHEN m <= 1000 THEN 0.6 ELSE 0 END) / 3 END + 0.1 * r::INT + 0.1 * t::INT, 6) AS score FROM p""")
def pair_similarity(t):
    rows = t("listings").withColumn("neighborhood", F.lit(None).cast("string"))
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    pairs = dedup.pairs_within(rows, ["city", "floor", "bathrooms"])
    # The distance is a column of its own, worked out once and only where it can matter: code of one pair must stay small to be compiled.
    pairs = pairs.withColumn("_m", F.when(~F.coalesce(M.surely_far(x, y), F.lit(False)), M.metres(x, y)))
    pairs = pairs.withColumn("_near", M.near(x, y, F.col("_m")))
    place = M.location_similarity(x, y, M.neighborhood_similarity(x("neighborhood"), y("neighborhood")), close=F.col("_near"))
    return pairs.select(x("id").alias("a"), y("id").alias("b"), r(M.feature_similarity(x, y, place=place), 6).alias("score"))


@query("""WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, upper(c_name) AS c_name, nullif(c_acctbal, 0) * 2 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE o.c_name END AS c_name, CASE WHEN o.c_custkey IS NOT NULL THEN coalesce(o.c_acctbal, n.c_acctbal) ELSE n.c_acctbal END AS c_acctbal,
CASE WHEN o.c_custkey IS NULL THEN 'new' WHEN n.c_custkey IS NOT NULL THEN 'updated' ELSE 'kept' END AS merge_action FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert_merge(t):
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.nullif("c_acctbal", F.lit(0.0)) * 2).alias("c_acctbal"))
    return upsert.merge(c.where("c_custkey % 3 <> 0"), new, ["c_custkey"], overwrite=["c_name"], fill=["c_acctbal"])


@query("SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 END AS v FROM customer WHERE c_custkey % 2 = 0) n ON o.k = n.k")
def enrichment_coalesce(t):
    c = t("customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).alias("v"))
    return upsert.coalesce_merge(old, new, ["k"])


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN false ELSE true END AS is_active FROM customer")
def soft_delete(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.lit(True).alias("is_active"))
    return upsert.soft_delete(rows, t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))


@query("SELECT event_type AS platform, CAST(user_id % 3 AS VARCHAR) AS city, count(*) AS listings_found, sum(event_id % 2)::BIGINT AS listings_new, sum(event_id % 3)::BIGINT AS listings_updated, sum(event_id % 5)::BIGINT AS errors_count FROM events GROUP BY ROLLUP (event_type, CAST(user_id % 3 AS VARCHAR))")
def ingest_rollup(t):
    log = t("events").select(F.col("event_type").alias("platform"), (F.col("user_id") % 3).cast("string").alias("city"), F.lit(1).cast("long").alias("listings_found"), (F.col("event_id") % 2).alias("listings_new"), (F.col("event_id") % 3).alias("listings_updated"), (F.col("event_id") % 5).alias("errors_count"))
    return upsert.rollup(log)


@query("SELECT user_id, arg_max(event_type, ts) AS status, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS duration_seconds FROM events GROUP BY 1")
def ingest_run_state(t):
    log = t("events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"))
    return upsert.run_state(log).select(F.col("session_id").cast("long").alias("user_id"), "status", "duration_seconds")


@query("""SELECT p_partkey, round(least(1::DOUBLE, 0.3::DOUBLE * least(1::DOUBLE, p_size * 50::DOUBLE / 1000::DOUBLE) + 0.2::DOUBLE * (1::DOUBLE - 2::DOUBLE * abs((p_partkey % 100)::DOUBLE / 100::DOUBLE - 0.5::DOUBLE))
+ 0.3::DOUBLE * least(1::DOUBLE, (p_size * 20 * 400)::DOUBLE / 307200::DOUBLE) + 0.2::DOUBLE * CASE WHEN p_size * 20 >= 300 THEN 1::DOUBLE ELSE 0.5::DOUBLE END), 9) AS score FROM part""")
def image_quality(t):
    s = images.quality_score(F.col("p_size") * 50.0, (F.col("p_partkey") % 100) / 100.0, F.col("p_size") * 20, F.lit(400))
    return t("part").select("p_partkey", r(s, 9).alias("score"))


# -- workflow and streams ---------------------------------------------------------------------------------------------------


@query("SELECT unnest(['dedup', 'outliers', 'coordinates', 'prices', 'text', 'encoding', 'features', 'split']) AS step, 'completed' AS status")
def workflow_end_to_end(t):
    rows = t("listings").withColumns({"scraped_at": F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")), "source_platform": F.lit("a"), "source_id": F.col("id").cast("string"), "description": F.concat(F.lit("Beautiful "), "title")})
    result = workflow.Workflow(workflow.Options(least_per_city=50)).run(rows)
    return result.summary().select("step", "status")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(t):
    """Hourly counters as a stream over the stored events, run until all are read."""
    from hearthline.plans.tables import shared_folder
    from hearthline.streaming.ingest import run_complete, windowed_counts

    events = t("events")
    spark = events.sparkSession
    folder = events.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(folder if folder.endswith(".parquet") else f"{folder}/events.parquet*")
    counts = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), window="1 hour", delay="40 days")
    place = f"{shared_folder(spark)}/streams/{uuid.uuid4()}"
    return run_complete(counts, f"{place}/rows", f"{place}/state").select(F.col("window.start").alias("hour"), "event_type", "n", r("total").alias("total"))


@query(LP + f"SELECT id, {CASE_CATEGORY.format('price_mad')} AS category, CASE WHEN price_per_m2 IS NOT NULL THEN {LEVEL_SQL} END AS level, round({_haversine('33.5731', '-7.5898')}, 5) AS km, floor::VARCHAR AS floor_text FROM l")
def sql_functions(t):
    """The registered functions from SQL."""
    from hearthline.functions import sql

    rows = t("priced")
    sql.register(rows.sparkSession)
    rows.createOrReplaceTempView("priced_listings")
    return rows.sparkSession.sql(
        "SELECT id, hl_price_category(price_mad) AS category, hl_price_per_m2_category(price_per_m2, city) AS level, round(hl_haversine_km(33.5731, -7.5898, latitude, longitude), 5) AS km, hl_title_case(CAST(floor AS STRING)) AS floor_text FROM priced_listings"
    )


@query("""WITH e AS (SELECT c_custkey AS id, c_custkey * 2 AS score FROM customer WHERE c_custkey % 3 = 0), i AS (SELECT o_custkey AS id, count(DISTINCT o_orderkey) AS n, min(CAST(o_orderkey AS VARCHAR)) AS first FROM orders GROUP BY 1)
SELECT c_custkey AS id, score, coalesce(n, 0) AS n_images, first AS first_image FROM customer LEFT JOIN e ON e.id = c_custkey LEFT JOIN i ON i.id = c_custkey""")
def relations(t):
    facts = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("listing_id"), (F.col("c_custkey") * 2).alias("score"))
    images = t("orders").select(F.col("o_custkey").alias("listing_id"), F.col("o_orderkey").cast("string").alias("original_url"))
    x = enrich.with_relations(t("customer").select(F.col("c_custkey").alias("id")), facts, images)
    return x.select("id", "enrichment.score", F.size("images").cast("long").alias("n_images"), F.get("images", F.lit(0))["original_url"].alias("first_image"))


@query(
    "WITH o AS (SELECT c_custkey AS listing_id, 'u' || c_nationkey AS original_url, c_acctbal AS quality_score FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS listing_id, 'u' || c_nationkey AS original_url, c_acctbal + 1 AS quality_score, CASE WHEN c_custkey % 4 = 0 THEN 'timeout' END AS download_error FROM customer WHERE c_custkey % 2 = 0) "
    "SELECT listing_id, original_url, CASE WHEN n.listing_id IS NOT NULL THEN n.quality_score ELSE o.quality_score END AS quality_score, coalesce(download_error, '') = '' AS downloaded, CASE WHEN o.listing_id IS NULL THEN 'new' WHEN n.listing_id IS NOT NULL THEN 'updated' ELSE 'kept' END AS merge_action FROM o FULL JOIN n USING (listing_id, original_url)"
)
def upsert_images(t):
    c = t("customer").select(F.col("c_custkey").alias("listing_id"), F.concat(F.lit("u"), "c_nationkey").alias("original_url"), F.col("c_acctbal").alias("quality_score"), F.lit(None).cast("string").alias("download_error"))
    error = F.when(F.col("listing_id") % 4 == 0, "timeout")
    new = c.where("listing_id % 2 = 0").withColumns({"quality_score": F.col("quality_score") + 1, "download_error": error})
    x = upsert.upsert_images(c.where("listing_id % 3 <> 0"), new)
    return x.select("listing_id", "original_url", "quality_score", "downloaded", "merge_action")


LOG_SQL = "WITH g AS (SELECT event_type AS platform, CAST(user_id % 3 AS VARCHAR) AS city, CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'failed' END AS status, event_id % 4 AS listings_found, event_id % 2 AS errors_count, event_id FROM events) "


def _log(t) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "completed").otherwise("failed")
    return t("events").select(F.col("event_type").alias("platform"), (F.col("user_id") % 3).cast("string").alias("city"), status.alias("status"), (F.col("event_id") % 4).alias("listings_found"), F.lit(0).alias("listings_new"), F.lit(0).alias("listings_updated"), (F.col("event_id") % 2).alias("errors_count"), F.col("event_id").alias("at"))


@query(LOG_SQL + "SELECT unnest(['runs_total', 'listings_found_total', 'errors_count_total']) AS metric, platform, city, status, unnest([count(*), sum(listings_found)::BIGINT, sum(errors_count)::BIGINT]) AS value FROM g GROUP BY platform, city, status")
def run_metrics(t):
    return monitoring.metrics(_log(t)).where("metric in ('runs_total', 'listings_found_total', 'errors_count_total')")


@query(LOG_SQL + """, r AS (SELECT *, sum((status <> 'failed')::INT) OVER (PARTITION BY platform, city ORDER BY event_id) AS run FROM g), f AS (SELECT platform, city, run, count(*) AS n FROM r WHERE status = 'failed' GROUP BY ALL HAVING count(*) >= 5)
SELECT 'SCRAPING_FAILURES' AS alert, platform, city, 'Consecutive failures for ' || platform || ' in ' || city || ': ' || n AS message FROM f
UNION ALL SELECT 'HIGH_ERROR_RATE', platform, NULL, 'High error rate for ' || platform || ': ' || format('{:.1f}', sum(errors_count) / sum(listings_found) * 100) || '% (' || sum(errors_count) || '/' || sum(listings_found) || ')' FROM g GROUP BY platform HAVING sum(errors_count) / sum(listings_found) > 0.1""")
def run_alerts(t):
    return monitoring.alerts(_log(t))


@query(f"{LP} SELECT feature, method, count(*) AS n FROM ({DOMAIN_SQL} UNION ALL SELECT id, 'surface_m2', 'zscore', surface_m2 FROM l, (SELECT avg(surface_m2) AS m, stddev_pop(surface_m2) AS s FROM l) z WHERE abs(surface_m2 - m) > 3 * s) GROUP BY ALL")
def outlier_findings(t):
    x = outliers.detect(t("priced"))
    return x.where("method = 'domain' or (method = 'zscore' and feature = 'surface_m2')").groupBy("feature", "method").agg(n_rows())


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
