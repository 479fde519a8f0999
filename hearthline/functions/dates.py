"""Date parts and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient(c: Column) -> Column:
    """A timestamp, or NULL for what is none."""
    return F.try_to_timestamp(c.cast("string"))


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isNotNull(), "autumn")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days of elapsed time, rounded down."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / 86_400_000_000).cast("long")


def parts(ts: Column, prefix: str = "scraping") -> list[Column]:
    return [
        F.year(ts).alias(f"{prefix}_year"),
        F.month(ts).alias(f"{prefix}_month"),
        F.weekday(ts).alias(f"{prefix}_day_of_week"),
        F.quarter(ts).alias(f"{prefix}_quarter"),
        season(ts).alias(f"{prefix}_season"),
    ]
