"""Coordinates and distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hearthline import vocab
from hearthline.functions.text import decimals

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


@F.pandas_udf(DoubleType())
def geodesic_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Vincenty's inverse on the WGS-84 ellipsoid, all rows at once; NaN where it does not settle."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x.to_numpy(float)))) for x in (lat1, lat2))
    ell = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    lam = ell.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(60):
            ss = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / ss)
            c2 = 1 - sa**2
            cm = np.where(c2 == 0, 0, cs - 2 * np.sin(u1) * np.sin(u2) / c2)
            c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
            new = ell + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-12
            lam = new
            if done:
                break
        k2 = c2 * (a**2 - b**2) / b**2
        big_a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
        big_b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
        ds = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm**2 - 1) - big_b / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
    return pd.Series(b * big_a * (sigma - ds))


def in_box(lat: Column, lon: Column) -> Column:
    return lat.between(*vocab.LAT_RANGE) & lon.between(*vocab.LON_RANGE)


def needs_geocoding(lat: Column, lon: Column) -> Column:
    return lat.isNull() | lon.isNull() | (lat == 0) | (lon == 0)


def suspicious(lat: Column, lon: Column) -> Column:
    """Placeholders, whole degrees, or more than 10 decimals."""
    whole = (F.abs(lat - F.rint(lat)) < 1e-6) & (F.abs(lon - F.rint(lon)) < 1e-6)
    point = ((lat == 0) & (lon == 0)) | ((lat == 1) & (lon == 1))
    return point | whole | (decimals(lat) > 10) | (decimals(lon) > 10)


def centre_distance_km(lat: Column, lon: Column, city: Column, centres: dict | None = None) -> Column:
    """Distance to the centre of a known city, else NULL."""
    out = None
    for name, (clat, clon) in (centres or {c: v[3] for c, v in vocab.CITIES.items()}).items():
        d = haversine_km(lat, lon, F.lit(clat), F.lit(clon))
        out = F.when(city == name, d) if out is None else out.when(city == name, d)
    return out


def airport_distance_km(lat: Column, lon: Column, city: Column) -> Column:
    return centre_distance_km(lat, lon, city, {c: v[4] for c, v in vocab.CITIES.items()})


def coast_distance_km(lon: Column) -> Column:
    return F.abs(lon + 7.5) * 111.0


def coordinate_check(lat: Column, lon: Column, city: Column) -> Column:
    """``struct(is_valid, confidence, errors)`` of a coordinate pair."""
    box, odd = F.coalesce(in_box(lat, lon), F.lit(False)), F.coalesce(suspicious(lat, lon), F.lit(False))
    d = centre_distance_km(lat, lon, F.lower(F.trim(city)))
    near = F.when(d.isNull(), 0.0).when(d <= 50, 0.4).when(d <= 100, 0.2).otherwise(-0.3)
    score = F.when(box, 0.4).otherwise(-0.5) + near + F.when(odd, -0.4).otherwise(0.0)
    missing = lat.isNull() | lon.isNull()
    errors = F.filter(
        F.array(
            F.when(missing, F.lit("missing coordinates")),
            F.when(~missing & ~box, F.lit("outside the country")),
            F.when(d > 100, F.format_string("%.1f km from the city", d)),
            F.when(~missing & odd, F.lit("suspicious pattern")),
        ),
        lambda x: x.isNotNull(),
    )
    return F.struct(
        F.when(missing, False).otherwise((F.round(score, 6) >= 0.3) & box).alias("is_valid"),
        F.when(missing, 0.0).otherwise(F.greatest(F.lit(0.0), score)).alias("confidence"),
        errors.alias("errors"),
    )


def jittered_centre(id_: Column, city: Column, which: int, spread: float = 0.05, salt: int = 7) -> Column:
    """A city centre's coordinate moved by up to ``spread``, the same for each id."""
    unit = F.pmod(F.xxhash64(id_, F.lit(salt), F.lit(which)), F.lit(1_000_001)) / 1_000_000
    out = None
    for name, v in vocab.CITIES.items():
        x = F.lit(v[3][which]) + (unit * 2 - 1) * spread
        out = F.when(city == name, x) if out is None else out.when(city == name, x)
    return out


def cell(lat: Column, lon: Column, metres: float) -> tuple[Column, Column]:
    """Grid cell indices: any two points within ``metres`` lie in the same or in neighbouring cells, up to 60 degrees."""
    dlat = metres / 111_000.0
    dlon = dlat / math.cos(math.radians(60))
    return F.floor(lat / dlat).cast("long"), F.floor(lon / dlon).cast("long")
