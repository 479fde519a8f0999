"""Similarities of listings."""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hearthline.functions.geo import haversine_km
from hearthline.functions.stats import ratio


#: A little more than a kilometre, in degrees of latitude.
FAR_DEGREES = 0.0091


def ratio_similarity(a: Column, b: Column) -> Column:
    """Smaller over larger; 0 where one is NULL or not positive."""
    return F.when((a > 0) & (b > 0), ratio(F.least(a, b), F.greatest(a, b))).otherwise(0.0)


def same(a: Column, b: Column) -> Column:
    """1 if equal or both NULL, 0.5 if one is NULL, else 0."""
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.0).otherwise(0.0)


def _terms(title: str) -> Counter[str]:
    words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in title.lower()).split() if len(w) > 1]
    return Counter(words) + Counter(" ".join(p) for p in zip(words, words[1:], strict=False))


def title_score(a: str, b: str, least: float = 0.0) -> float:
    """The larger of the matching-blocks ratio and the cosine of TF-IDF vectors over the two titles alone.

    Below ``least`` any score below it may be returned, which saves most of the matching.
    """
    if not a or not b:
        return 0.0
    x, y = _terms(a), _terms(b)
    idf = {t: (math.log(3 / (1 + (t in x) + (t in y))) + 1) ** 2 for t in x | y}
    dot = sum(x[t] * y[t] * idf[t] for t in x if t in y)
    norm = math.sqrt(sum(n * n * idf[t] for t, n in x.items()) * sum(n * n * idf[t] for t, n in y.items()))
    cosine = dot / norm if norm else 0.0
    blocks = SequenceMatcher(None, a, b)
    for bound in (blocks.real_quick_ratio, blocks.quick_ratio):
        if bound() <= cosine or bound() < least:
            return cosine
    return max(blocks.ratio(), cosine)


def scored_titles(least: float = 0.0):
    """``title_score`` as an Arrow function of two columns; NULL counts as empty."""

    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([title_score(x or "", y or "", least) for x, y in zip(a, b, strict=True)], dtype=float)

    return score


def title_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    return scored_titles(least)(a, b)


@lru_cache(1 << 16)
def _name_score(a: str, b: str) -> float:
    return title_score(a, b)


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """As ``title_similarity``, for names of which few are distinct."""
    return pd.Series([_name_score(x or "", y or "") for x, y in zip(a, b, strict=True)])


def neighborhood_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.5 if one is NULL or empty, else the similarity of the names as titles."""
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    # Equal and missing names reach Python as NULL.
    differ = ~missing & (a != b)
    return F.when(missing, 0.5).when(a == b, 1.0).otherwise(name_similarity(F.when(differ, a), F.when(differ, b)))


def metres(a, b) -> Column:
    """Distance of two listings; NULL where one has no place."""
    return haversine_km(a("latitude"), a("longitude"), b("latitude"), b("longitude")) * 1000


def surely_far(a, b) -> Column:
    """Whether latitudes alone put two listings with places more than a kilometre apart, which needs no distance."""
    valid = a("longitude").isNotNull() & b("longitude").isNotNull() & (F.abs(a("latitude")) <= 90) & (F.abs(b("latitude")) <= 90)
    return valid & (F.abs(a("latitude") - b("latitude")) > FAR_DEGREES)


def near(a, b, apart: Column | None = None) -> Column:
    """The coordinate part of two places; NULL where one is missing. ``apart`` is the distance if it is known, needed only where it is not surely far."""
    m = metres(a, b) if apart is None else apart
    placed = reduce(Column.__and__, [x(c).isNotNull() for x in (a, b) for c in ("latitude", "longitude")])
    return F.when(surely_far(a, b), 0.0).when(m <= 100, 1.0).when(m <= 500, 0.8).when(m <= 1000, 0.6).when(placed, 0.0)


def location_similarity(a, b, hood: Column | None = None, apart: Column | None = None, close: Column | None = None) -> Column:
    """Mean of the city, neighborhood and coordinate parts; 0 for different cities.

    ``a(name)`` gives a column; ``hood`` is the neighborhood part, ``apart`` the distance and ``close`` the coordinate part if they are known.
    """
    if hood is None:
        hood = neighborhood_similarity(a("neighborhood"), b("neighborhood"))
    close = near(a, b, apart) if close is None else close
    mean = F.when(close.isNull(), (1 + hood) / 2).otherwise((1 + hood + close) / 3)
    return F.when(a("city") == b("city"), mean).otherwise(0.0)


def feature_similarity(a, b, hood: Column | None = None, place: Column | None = None) -> Column:
    """The weighted parts; ``place`` is the location's if it is known."""
    return (
        0.3 * ratio_similarity(a("price_mad"), b("price_mad"))
        + 0.25 * ratio_similarity(a("surface_m2"), b("surface_m2"))
        + 0.25 * (location_similarity(a, b, hood) if place is None else place)
        + 0.1 * same(a("rooms"), b("rooms"))
        + 0.1 * same(a("property_type"), b("property_type"))
    )
