"""Counters and alerts over run logs, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits beyond which an alert is raised.
ERROR_RATE, FAILURES = 0.1, 5


def metrics(log: DataFrame) -> DataFrame:
    """``metric, platform, city, status, value``: entries and listings of a run log by platform, city and status."""
    by = ["platform", "city", "status"]
    totals = log.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("runs_total"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{c}_total") for c in ("listings_found", "listings_new", "listings_updated", "errors_count")])
    names = [c for c in totals.columns if c not in by]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return totals.select(*by, F.explode(pairs).alias("m")).select("m.metric", *by, "m.value")


def exposition(found: DataFrame, prefix: str = "hearthline") -> DataFrame:
    """``line``: the metrics in the text format that metric collectors read, NULL labels as empty."""
    label = lambda c: F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))
    labels = F.concat_ws(",", *[label(c) for c in ("platform", "city", "status")])
    return found.select(F.concat(F.lit(f"{prefix}_"), "metric", F.lit("{"), labels, F.lit("} "), F.col("value").cast("string")).alias("line"))


def error_alerts(log: DataFrame, most: float = ERROR_RATE) -> DataFrame:
    """Platforms whose errors exceed ``most`` of what was found; platforms that found nothing raise none."""
    sums = log.groupBy("platform").agg(F.sum("errors_count").alias("errors"), F.sum("listings_found").alias("total"))
    rate = F.try_divide(F.col("errors").cast("double"), F.col("total").cast("double"))
    message = F.format_string("High error rate for %s: %.1f%% (%d/%d)", "platform", F.col("rate") * 100, "errors", "total")
    return sums.withColumn("rate", rate).where(F.col("rate") > most).select(F.lit("HIGH_ERROR_RATE").alias("alert"), "platform", F.lit(None).cast("string").alias("city"), message.alias("message"))


def failure_runs(log: DataFrame, least: int = FAILURES) -> DataFrame:
    """Runs of consecutive failures by platform and city that reach ``least``; a success ends a run."""
    w = Window.partitionBy("platform", "city").orderBy("at")
    good = F.sum(F.when(F.col("status") != "failed", 1).otherwise(0)).over(w)
    runs = log.withColumn("_run", good).where("status = 'failed'").groupBy("platform", "city", "_run")
    return runs.agg(F.count(F.lit(1)).alias("failures"), F.min("at").alias("since")).where(F.col("failures") >= least).drop("_run")


def alerts(log: DataFrame, most: float = ERROR_RATE, least: int = FAILURES) -> DataFrame:
    """``alert, platform, city, message`` of error rates and of failures in a row."""
    runs = failure_runs(log.where("city is not null"), least)
    message = F.format_string("Consecutive failures for %s in %s: %d", "platform", "city", "failures")
    return error_alerts(log, most).unionByName(runs.select(F.lit("SCRAPING_FAILURES").alias("alert"), "platform", "city", message.alias("message")))
