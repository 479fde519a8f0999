"""The column functions as SQL functions.

Each is registered with its own expression as its body, so a query that calls it is
planned and compiled like one written out; no Python runs. Functions that need Python
(title scores, geodesic distances) are registered as Arrow functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import dates as D
from hearthline.functions import geo as G
from hearthline.functions import html as H
from hearthline.functions import price as P
from hearthline.functions import similarity as M
from hearthline.functions import text as X

PREFIX = "hl_"
#: Functions by name, with the types of their arguments.
FUNCTIONS: dict[str, tuple[Callable[..., Column], list[str]]] = {
    "remove_accents": (X.remove_accents, ["string"]),
    "title_case": (X.title_case, ["string"]),
    "clean_city": (X.clean_city, ["string"]),
    "clean_property_type": (X.clean_property_type, ["string"]),
    "clean_neighborhood": (X.clean_neighborhood, ["string"]),
    "clean_title": (X.clean_title, ["string"]),
    "clean_description": (X.clean_description, ["string"]),
    "clean_address": (X.clean_address, ["string"]),
    "match_title": (X.match_title, ["string"]),
    "standard_boolean": (X.standard_boolean, ["string"]),
    "standard_condition": (X.standard_condition, ["string"]),
    "standard_floor": (X.standard_floor, ["string"]),
    "description_features": (X.description_features, ["string"]),
    "word_count": (X.word_count, ["string"]),
    "full_address": (X.full_address, ["string", "string"]),
    "digits_price": (P.digits_price, ["string"]),
    "surface": (P.surface, ["string"]),
    "first_integer": (P.first_integer, ["string"]),
    "to_mad": (P.to_mad, ["string"]),
    "valid_price": (P.valid_price, ["double"]),
    "valid_price_per_m2": (P.valid_ppm2, ["double"]),
    "price_category": (P.category, ["double"]),
    "price_per_m2_category": (P.ppm2_category, ["double", "string"]),
    "haversine_km": (G.haversine_km, ["double", "double", "double", "double"]),
    "in_box": (G.in_box, ["double", "double"]),
    "suspicious_coordinates": (G.suspicious, ["double", "double"]),
    "centre_distance_km": (G.centre_distance_km, ["double", "double", "string"]),
    "airport_distance_km": (G.airport_distance_km, ["double", "double", "string"]),
    "coast_distance_km": (G.coast_distance_km, ["double"]),
    "season": (D.season, ["timestamp"]),
    "days_between": (D.days_between, ["timestamp", "timestamp"]),
    "source_id": (H.source_id, ["string"]),
    "coordinates_from_url": (H.coordinates_from_url, ["string"]),
    "html_title": (H.title, ["string"]),
    "html_text": (H.plain, ["string"]),
    "ratio_similarity": (M.ratio_similarity, ["double", "double"]),
}


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Register all functions for the session's queries; returns their names."""
    for name, (function, types) in FUNCTIONS.items():
        names = [f"arg{i}" for i in range(len(types))]
        arguments = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
        frame = spark.createDataFrame([], arguments).select(function(*[F.col(n) for n in names]).alias("v"))
        body = _arrows(frame._jdf.queryExecution().analyzed().expressions().head().child().sql())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {frame.schema[0].dataType.simpleString()} RETURN {body}")
    python = {"title_similarity": M.scored_titles(), "geodesic_m": G.geodesic_m}
    for name, function in python.items():
        spark.udf.register(f"{prefix}{name}", function)
    return [f"{prefix}{n}" for n in (*FUNCTIONS, *python)]


_CALL, _VARIABLE = "lambdafunction(", "namedlambdavariable()"


def _arrows(sql: str) -> str:
    """Write printed lambda functions, which are not SQL, with arrows; they take one argument and are not nested."""
    k = 0
    while (at := sql.rfind(_CALL)) >= 0:
        end, depth, quoted = at + len(_CALL), 1, False
        while depth:
            c = sql[end]
            if quoted:
                end += c == "\\"
                quoted = c != "'"
            elif c == "'":
                quoted = True
            else:
                depth += (c == "(") - (c == ")")
            end += 1
        body = sql[at + len(_CALL) : end - 1].removesuffix(f", {_VARIABLE}")
        if _VARIABLE in body and body.count("->"):
            raise ValueError("nested lambda functions")
        sql = f"{sql[:at]}x{k} -> {body.replace(_VARIABLE, f'x{k}')}{sql[end:]}"
        k += 1
    return sql
