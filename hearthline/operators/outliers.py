"""Outlier detectors, each a long table of findings, and ways of handling them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hearthline import vocab
from hearthline.functions import stats as S
from hearthline.plans.tables import cut

NUMERIC = ["price_mad", "surface_m2", "rooms", "price_per_m2"]


def _city(pick) -> tuple[Column, Column]:
    """Low and high limits by city, the default city's where it is unknown."""
    city = F.lower(F.trim(F.col("city")))
    bounds = []
    for k in (0, 1):
        out = None
        for name, v in vocab.CITIES.items():
            out = F.when(city == name, float(pick(v)[k])) if out is None else out.when(city == name, float(pick(v)[k]))
        bounds.append(out.otherwise(float(pick(vocab.CITIES[vocab.DEFAULT_CITY])[k])))
    return bounds[0], bounds[1]


def domain_outliers(df: DataFrame) -> DataFrame:
    """``id, feature, method, value, low, high`` of values outside the market's limits."""
    limits = {}
    if "city" in df.columns:
        limits["price_mad"], limits["price_per_m2"] = _city(lambda v: v[0]), _city(lambda v: v[1])
    limits["surface_m2"] = tuple(F.lit(float(x)) for x in vocab.SURFACE_RANGE)
    limits["rooms"] = tuple(F.lit(float(x)) for x in vocab.ROOMS_RANGE)
    found = [F.when((F.col(c) < lo) | (F.col(c) > hi), _finding(c, "domain", F.col(c), lo, hi)) for c, (lo, hi) in limits.items() if c in df.columns]
    return _long(df, found)


def _finding(feature: str, method: str, value: Column, low: Column, high: Column) -> Column:
    return F.struct(F.lit(feature).alias("feature"), F.lit(method).alias("method"), value.cast("double").alias("value"), low.alias("low"), high.alias("high"))


def _long(df: DataFrame, found: list[Column]) -> DataFrame:
    return df.select("id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select("id", "f.*")


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5, least: int = 10) -> DataFrame:
    """Values beyond ``factor`` interquartile ranges; columns with fewer than ``least`` values have none.

    The limits of all columns are taken together.
    """
    cols = [c for c in columns or NUMERIC if c in df.columns]
    edges, counts = S.quantiles(df, {c: [0.25, 0.75] for c in cols}), df.agg(F.count(F.lit(1)), *[F.count(c).alias(c) for c in cols]).first()
    found = []
    for c in cols:
        q1, q3 = edges[c]
        if q1 is not None and counts[c] >= least:
            lo, hi = F.lit(q1 - factor * (q3 - q1)), F.lit(q3 + factor * (q3 - q1))
            found.append(F.when((F.col(c) < lo) | (F.col(c) > hi), _finding(c, "iqr", F.col(c), lo, hi)))
    if not found:  # no limits, so no findings
        none = F.lit(None).cast("double")
        return _long(df.where("false"), [_finding("", "iqr", none, none, none)])
    return _long(df.select("id", *cols), found)


def zscore_outliers(df: DataFrame, columns: list[str] | None = None, limit: float = 3.0, least: int = 10) -> DataFrame:
    """Values more than ``limit`` population deviations from the mean."""
    cols = [c for c in columns or NUMERIC if c in df.columns]
    stats = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"), F.count(c).alias(f"{c}_n"))])
    found = []
    for c in cols:
        m, s = F.col(f"{c}_m"), F.col(f"{c}_s")
        found.append(F.when((F.col(f"{c}_n") >= least) & (s > 0) & (F.abs(F.col(c) - m) > limit * s), _finding(c, "zscore", F.col(c), m - limit * s, m + limit * s)))
    return _long(df.select("id", *cols).crossJoin(F.broadcast(stats)), found)


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 100, contamination: float = 0.1, seed: int = 42, subsample: int = 256, least: int = 50) -> DataFrame:
    """``id, score, is_outlier`` of rows complete in ``columns``: the share ``contamination`` isolated soonest.

    Each tree is grown on its own rows, ``subsample`` of a sample of ``trees * subsample / 4``
    rows (6400 by default) by hash of the id, as the method defines it; every complete row is
    scored on the executors.
    """
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    rows = df.where(full).select("id", *[F.col(c).cast("double").alias(c) for c in columns])
    drawn = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(trees * subsample // 4).select(*columns).toPandas().to_numpy()
    if len(drawn) < least or len(columns) < 2:
        return rows.select("id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_outlier"))
    rng = np.random.default_rng(seed)
    mean, sd = drawn.mean(0), drawn.std(0)
    drawn = (drawn - mean) / np.where(sd > 0, sd, 1)
    size = min(subsample, len(drawn))
    grown = [_grow(drawn[rng.choice(len(drawn), size, replace=False)], rng, int(np.ceil(np.log2(size)))) for _ in range(trees)]
    usual = _average_path(size)

    @F.pandas_udf(DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = (np.stack([c.to_numpy(float) for c in cols], 1) - mean) / np.where(sd > 0, sd, 1)
        depth = np.zeros(len(x))
        for feature, cut, left, length in grown:
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                at = np.flatnonzero(inner)
                n = node[at]
                node[at] = left[n] + (x[at, feature[n]] >= cut[n])
            depth += length[node]
        return pd.Series(2.0 ** (-depth / len(grown) / usual))

    scored = rows.select("id", score(*columns).alias("score"))
    scored = cut(scored)
    edge = S.quantiles(scored, {"score": [1 - contamination]})["score"][0]
    return scored.select("id", "score", (F.col("score") > F.lit(edge)).alias("is_outlier"))


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    """Arrays of a random tree: split feature (-1 for a leaf), cut, left child (right follows), path length."""
    feature, cut, left, length = [-1], [0.0], [0], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, rows, depth = todo.pop()
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth >= limit or not len(spread):
            length[node] = depth + _average_path(len(rows))
            continue
        f = int(rng.choice(spread))
        c = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        feature[node], cut[node], left[node] = f, c, len(feature)
        below = rows[:, f] < c
        for part in (rows[below], rows[~below]):
            todo.append((len(feature), part, depth + 1))
            feature.append(-1)
            cut.append(0.0)
            left.append(0)
            length.append(0.0)
    return np.array(feature), np.array(cut), np.array(left), np.array(length)


def detect(df: DataFrame) -> DataFrame:
    """All findings of the rule, quartile and deviation detectors."""
    return domain_outliers(df).unionByName(iqr_outliers(df)).unionByName(zscore_outliers(df))


def handle(df: DataFrame, strategy: str = "remove", columns: list[str] | None = None) -> DataFrame:
    """``remove`` rows found by rule or quartiles, ``cap`` at the 5th and 95th percentile, or ``transform`` by log1p."""
    cols = [c for c in columns or ["price_mad", "price_per_m2"] if c in df.columns]
    if strategy == "remove":
        return df.join(domain_outliers(df).unionByName(iqr_outliers(df)).select("id").distinct(), "id", "left_anti")
    if strategy == "cap":
        cols = [c for c in columns or NUMERIC if c in df.columns]
        edges = S.quantiles(df, {c: [0.05, 0.95] for c in cols})
        low, high = (lambda c: F.lit(edges[c][0]).cast("double")), (lambda c: F.lit(edges[c][1]).cast("double"))
        return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), low(c)), high(c))) for c in cols})
    if strategy == "transform":
        return df.withColumns({f"{c}_log": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in cols})
    return df
