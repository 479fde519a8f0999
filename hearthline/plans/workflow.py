"""The cleaning workflow: toggled steps, each a function of a table, with a log of what happened."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from time import monotonic

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators import coordinates, dedup, encoding, features, outliers, prices, quality, splitting, textclean
from hearthline.plans.tables import cut

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Options:
    steps: tuple[str, ...] = ("dedup", "outliers", "coordinates", "prices", "text", "encoding", "features", "split")
    target: str = "price_mad"
    duplicate_threshold: float = 0.85
    outlier_strategy: str = "remove"
    scale_correction: bool = True
    select_features: int | None = None
    least_per_city: int = 100
    as_of_year: int = 2024


@dataclass
class Result:
    data: DataFrame
    quality: DataFrame
    log: list[dict] = field(default_factory=list)

    def summary(self) -> DataFrame:
        """The step log as a table."""
        return self.data.sparkSession.createDataFrame([(e["step"], e["status"], e["message"], float(e["seconds"])) for e in self.log], "step string, status string, message string, seconds double")

    def step(self, name: str) -> dict | None:
        """The log entry of a step; None if it did not run."""
        return next((e for e in self.log if e["step"] == name), None)

    def report(self) -> DataFrame:
        """``section, name, value``: what ran, what came out, how good it is, and what to look at."""
        spark = self.data.sparkSession
        done = [e for e in self.log if e["status"] == "completed"]
        rows = [
            ("run", "steps", float(len(self.log))),
            ("run", "completed", float(len(done))),
            ("run", "failed", float(len(self.log) - len(done))),
            ("run", "seconds", float(sum(e["seconds"] for e in self.log))),
            ("data", "rows", float(self.data.count())),
            ("data", "columns", float(len(self.data.columns))),
        ]
        made = spark.createDataFrame(rows, "section string, name string, value double")
        whole = quality.overall(self.quality)
        score = whole.select(F.lit("quality").alias("section"), F.lit("overall_score").alias("name"), F.col("overall_score").cast("double").alias("value"))
        each = self.quality.select(F.lit("quality").alias("section"), F.col("check_name").alias("name"), F.col("score").alias("value"))
        advice = recommendations(self.summary(), self.quality).select(F.lit("recommendation").alias("section"), F.col("recommendation").alias("name"), F.lit(None).cast("double").alias("value"))
        return made.unionByName(score).unionByName(each).unionByName(advice)


class Workflow:
    """Steps run in the order of ``Options.steps``; one that fails is logged and its input goes on."""

    def __init__(self, options: Options | None = None, geocode_cache: DataFrame | None = None):
        self.options, self.cache = options or Options(), geocode_cache
        self.encoder: encoding.Encoder | None = None

    def steps(self) -> dict[str, Step]:
        o = self.options
        return {
            "dedup": lambda df: dedup.remove_duplicates(df, o.duplicate_threshold),
            "outliers": lambda df: outliers.handle(df, o.outlier_strategy),
            "coordinates": self._coordinates,
            "prices": self._prices,
            "text": lambda df: textclean.standardise_values(textclean.clean_text_fields(df)),
            "encoding": self._encode,
            "features": self._features,
            "split": lambda df: splitting.split_by_city(splitting.prepare(df, o.target, o.as_of_year), least=o.least_per_city),
        }

    def _coordinates(self, df: DataFrame) -> DataFrame:
        if self.cache is not None:
            df = coordinates.geocode_missing(df, self.cache)
        return coordinates.validate_coordinates(coordinates.geographic_columns(coordinates.fallback_to_centre(df)))

    def _prices(self, df: DataFrame) -> DataFrame:
        df = prices.normalise_prices(df)
        return prices.price_features(prices.correct_scale(df) if self.options.scale_correction else df)

    def _encode(self, df: DataFrame) -> DataFrame:
        self.encoder = encoding.fit(df)
        return encoding.combinations(self.encoder.transform(df))

    def _features(self, df: DataFrame) -> DataFrame:
        o = self.options
        out = features.engineer(df, o.target, o.as_of_year)
        return features.select_best(out, o.target, o.select_features) if o.select_features else out

    def run(self, df: DataFrame) -> Result:
        """Each step's rows are written to the shared folder, so failures show in their own step."""
        log = []
        known = self.steps()
        for name in self.options.steps:
            began = monotonic()
            try:
                df = cut(known[name](df))
                log.append({"step": name, "status": "completed", "message": "", "seconds": monotonic() - began})
            except Exception as e:  # noqa: BLE001  the step's input goes on
                log.append({"step": name, "status": "failed", "message": str(e)[:500], "seconds": monotonic() - began})
        return Result(df, quality.checks(df.select(*[f"`{c}`" for c in df.columns])), log)


def recommendations(log: DataFrame, found: DataFrame) -> DataFrame:
    """Failed steps and weak checks in one list."""
    failed = log.where("status = 'failed'").select(F.concat(F.lit("Look into step "), "step").alias("recommendation"))
    return failed.unionByName(quality.recommendations(found).select("recommendation"))
