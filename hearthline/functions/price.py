"""Prices: parsing, currencies, validity, scale and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline import vocab

_NUMBER = r"([0-9]+(?:[,\s][0-9]{3})*(?:\.[0-9]{2})?)"
# Currency notations, in order of preference.
NOTATIONS = [
    (rf"{_NUMBER}\s*(?:mad|dh|dhs|dirham)", "MAD"),
    (rf"{_NUMBER}\s*€", "EUR"),
    (rf"{_NUMBER}\s*\$", "USD"),
    (rf"{_NUMBER}\s*£", "GBP"),
    (rf"€\s*{_NUMBER}", "EUR"),
    (rf"\$\s*{_NUMBER}", "USD"),
    (rf"£\s*{_NUMBER}", "GBP"),
]


def digits_price(c: Column) -> Column:
    """All digits of a text as one number."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")


def surface(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(c), r"([0-9]+(?:\.[0-9]+)?)\s*m²?", 1), F.lit("")).try_cast("double")


def first_integer(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).try_cast("int")


def _number(t: Column, pattern: str) -> Column:
    return F.regexp_replace(F.regexp_extract(t, pattern, 1), "[, ]", "").try_cast("double")


def to_mad(c: Column, fallback: str = "MAD") -> Column:
    """``struct(value, currency, confidence, rate)`` of a price text."""
    t = F.nullif(F.trim(F.lower(c.cast("string"))), F.lit(""))
    result = lambda v, cur, conf, rate: F.struct((v * rate).alias("value"), F.lit(cur).alias("currency"), F.lit(conf).alias("confidence"), F.lit(float(rate)).alias("rate"))
    out = None
    for pattern, currency in NOTATIONS:
        v, rate = _number(t, pattern), vocab.RATES[currency]
        out = F.when(v.isNotNull(), result(v, currency, 0.9, rate)) if out is None else out.when(v.isNotNull(), result(v, currency, 0.9, rate))
    v = _number(t, _NUMBER)
    out = out.when(v.isNotNull(), result(v, fallback, 0.5, vocab.RATES.get(fallback, 1.0)))
    return out.otherwise(result(F.lit(None).cast("double"), "UNKNOWN", 0.0, 1.0))


def valid_price(c: Column) -> Column:
    return c.between(*vocab.PRICE_RANGE)


def valid_ppm2(c: Column) -> Column:
    return c.between(*vocab.PPM2_RANGE)


def corrected(price: Column, surface_m2: Column) -> Column:
    """``struct(price, method)`` of a price that may be off by a power of ten; the first rule that fits counts."""
    ppm2 = F.when(surface_m2 > 0, price / surface_m2)
    after = lambda factor: F.when(surface_m2 > 0, price * factor / surface_m2)
    result = lambda p, m: F.struct(p.alias("price"), F.lit(m).alias("method"))
    has_surface = F.coalesce(surface_m2 > 0, F.lit(False))
    return (
        F.when((price > 50_000_000) & valid_price(price / 100), result(price / 100, "divided_by_100"))
        .when((price < 100_000) & valid_price(price * 1000) & (~has_surface | valid_ppm2(after(1000.0))), result(price * 1000.0, "multiplied_by_1000"))
        .when((ppm2 > 500_000) & valid_price(price / 10) & valid_ppm2(after(0.1)), result(price / 10, "divided_by_10"))
        .when((ppm2 < 500) & valid_price(price * 10) & valid_ppm2(after(10.0)), result(price * 10.0, "multiplied_by_10"))
        .otherwise(result(price.cast("double"), "no_correction"))
    )


def category(price: Column) -> Column:
    return F.when(price < 500_000, "budget").when(price < 1_500_000, "mid_range").when(price < 5_000_000, "premium").when(price.isNotNull(), "luxury")


def ppm2_category(ppm2: Column, city: Column) -> Column:
    """The level of a price per m2 in its city; NULL for cities without levels."""
    out = F.when(ppm2.isNull(), F.lit(None))
    for name, (_, _, (low, mid, high), _, _) in vocab.CITIES.items():
        level = F.when(ppm2 < low, "below_market").when(ppm2 < mid, "market_rate").when(ppm2 < high, "above_market").otherwise("premium_market")
        out = out.when(city == name, level)
    return out
