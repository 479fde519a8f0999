"""Categorical encodings: a plan, a fitted mapping table, and its application."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from hearthline import vocab
from hearthline.functions import stats as S


def plan(df: DataFrame, custom: dict[str, str] | None = None) -> dict[str, str]:
    """An encoding for each text column, from one aggregate over the table.

    Columns that are nearly unique (95 %), lists, and results of encoding are left
    out; columns without a default get one by their number of values.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and not f.name.endswith(("_encoded", "_onehot"))]
    names += [c for c in vocab.DEFAULT_ENCODINGS if c in df.columns and c not in names and not isinstance(df.schema[c].dataType, ArrayType)]
    if not names:
        return {}
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.countDistinct(c).alias(c) for c in names]).first()
    out = {}
    for c in names:
        if row["_n"] and row[c] / row["_n"] >= 0.95 and c not in (custom or {}):
            continue
        auto = "frequency" if row[c] > 100 else "label" if row[c] > 20 else "onehot" if row[c] > 2 else "boolean"
        out[c] = (custom or {}).get(c) or vocab.DEFAULT_ENCODINGS.get(c) or auto
    return out


def boolean_code(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin(vocab.BOOLEAN_TRUE), F.lit(False)).cast("int")


def label_table(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: distinct values in order from 0; NULL is 'MISSING'."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit("MISSING")).alias("value")).distinct()
    return S.numbered(values, ["value"], "code").select("value", "code")


def frequency_table(df: DataFrame, column: str, least: int = 5) -> DataFrame:
    """``value, code``: counts; those below ``least`` become ``least - 1``."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).count()
    return counts.select("value", F.when(F.col("count") < least, least - 1).otherwise(F.col("count")).alias("code"))


def ordinal_code(c: Column, order: list[str]) -> Column:
    out = None
    for k, v in enumerate(order):
        out = F.when(c == v, k) if out is None else out.when(c == v, k)
    return out


@dataclass
class Encoder:
    """Fitted encodings; ``tables`` hold mappings, ``values`` the one-hot categories."""

    methods: dict[str, str]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    values: dict[str, list[str]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the codes; values that were not seen get 0 (NULL for ordinal columns)."""
        for c, method in self.methods.items():
            if c not in df.columns:
                continue
            if method == "boolean":
                df = df.withColumn(f"{c}_encoded", boolean_code(F.col(c)))
            elif method == "onehot":
                df = df.withColumns({f"{c}_{v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("int") for v in self.values[c]})
            elif method == "ordinal" and c in vocab.ORDINAL:
                df = df.withColumn(f"{c}_encoded", ordinal_code(F.col(c), vocab.ORDINAL[c]))
            else:
                key = F.col(c).cast("string")
                key = F.coalesce(key, F.lit("MISSING")) if method == "label" else key
                t = self.tables[c].select(F.col("value").alias("_v"), F.col("code").alias("_c"))
                df = df.join(t, key == F.col("_v"), "left").withColumn(f"{c}_encoded", F.coalesce("_c", F.lit(0))).drop("_v", "_c")
        return df

    def save(self, path: str) -> None:
        """Mapping tables as one Parquet table ``column, method, value, code``."""
        self.mapping().write.mode("overwrite").parquet(path)

    def mapping(self) -> DataFrame:
        spark = SparkSession.active()
        rows = [(c, m, v, k) for c, m in self.methods.items() for k, v in enumerate(self.values.get(c, [None]))]
        out = spark.createDataFrame(rows, "column string, method string, value string, code bigint")
        for c, t in self.tables.items():
            out = out.unionByName(t.select(F.lit(c).alias("column"), F.lit(self.methods[c]).alias("method"), "value", F.col("code").cast("bigint").alias("code")))
        return out

    @classmethod
    def load(cls, spark, path: str) -> Encoder:
        rows = spark.read.parquet(path)
        methods = {r["column"]: r["method"] for r in rows.select("column", "method").distinct().collect()}
        values: dict[str, list[str]] = {c: [] for c, m in methods.items() if m == "onehot"}
        for r in rows.where("method = 'onehot' and value is not null").orderBy("column", "code").collect():
            values[r["column"]].append(r["value"])
        tables = {c: rows.where((F.col("column") == c) & F.col("value").isNotNull()).select("value", "code") for c, m in methods.items() if m in ("label", "frequency", "target")}
        return cls(methods, tables, values)


def fit(df: DataFrame, custom: dict[str, str] | None = None, max_categories: int = 50) -> Encoder:
    """Plan and fit; only one-hot categories, ``max_categories`` at the most, come to the driver."""
    methods = plan(df, custom)
    encoder = Encoder(methods)
    for c, method in methods.items():
        if method == "onehot":
            top = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(max_categories)
            encoder.values[c] = sorted(r["v"] for r in top.collect())
        elif method == "label":
            encoder.tables[c] = label_table(df, c)
        elif method in ("frequency", "target"):
            encoder.tables[c] = frequency_table(df, c)
        elif method == "ordinal" and c not in vocab.ORDINAL:
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).count()
            encoder.tables[c] = S.numbered(counts.withColumn("count", -F.col("count")), ["count", "value"], "code").select("value", "code")
        elif method not in ("boolean", "ordinal", "skip"):
            raise ValueError(f"unknown encoding: {method}")
    encoder.methods = {c: m for c, m in methods.items() if m != "skip"}
    return encoder


def combinations(df: DataFrame) -> DataFrame:
    """Pair keys, pair frequencies and both-of flags for the columns present."""
    has, out = set(df.columns), {}
    if {"city", "property_type"} <= has:
        out["city_property_interaction"] = F.concat_ws("_", "city", "property_type")
        out["property_frequency_in_city"] = F.count(F.lit(1)).over(Window.partitionBy("city", "property_type"))
    if {"city", "neighborhood"} <= has:
        out["neighborhood_frequency_in_city"] = F.count(F.lit(1)).over(Window.partitionBy("city", "neighborhood"))
    for a, b in (("parking", "elevator"), ("pool", "garden"), ("furnished", "elevator")):
        if {a, b} <= has:
            out[f"{a}_and_{b}"] = boolean_code(F.col(a)) * boolean_code(F.col(b))
    return df.withColumns(out) if out else df


def report(encoder: Encoder) -> DataFrame:
    """``column, method, n_features, n_categories, feature_names`` of a fitted encoder, one row a column."""
    spark = SparkSession.active()
    schema = "column string, method string, n_features int, n_categories long, feature_names array<string>"
    rows = []
    for c, m in encoder.methods.items():
        names = [f"{c}_{v}" for v in encoder.values[c]] if m == "onehot" else [f"{c}_encoded"]
        categories = len(encoder.values[c]) if m == "onehot" else encoder.tables[c].count() if c in encoder.tables else len(vocab.ORDINAL[c]) if m == "ordinal" else None
        rows.append((c, m, len(names), categories, names))
    return spark.createDataFrame(rows, schema)


def report_totals(found: DataFrame) -> DataFrame:
    """``method, n_columns, n_features``: how often each method was used."""
    return found.groupBy("method").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n_features").alias("n_features"))


#: Most frequent words, at least and as a multiple of the terms asked for, that terms are looked for among before all words are.
LEAST_WORDS, WORDS_A_TERM = 400, 8


def _tokens(text: Column) -> Column:
    """Words of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def _words(text: Column, stop_words: Sequence[str]) -> Column:
    """Words without stop words."""
    return F.filter(_tokens(text), lambda w: ~w.isin(*stop_words))


def _terms(words: Column, among: Sequence[str] | None = None) -> Column:
    """Words and pairs of neighbours; only those made of words of ``among`` if given. ``words`` is a column of the table, so that it is worked out once."""
    known = (lambda w: F.lit(True)) if among is None else (lambda w: w.isin(*among))
    following = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(words, following, lambda a, b: F.when(b.isNotNull() & known(a) & known(b), F.concat(a, F.lit(" "), b)))
    return F.concat(words if among is None else F.filter(words, known), F.filter(pairs, lambda p: p.isNotNull()))


def _top_terms(rows: DataFrame, among: Sequence[str] | None, n: int, features: int, least: int, most: float) -> list:
    """``term, df, n`` of the most frequent terms of ``rows._s``, of those in enough and not too many texts."""
    rows = rows.select(_terms(F.col("_s"), among).alias("t"))
    # A text's terms, and behind them each of them once more.
    # The array is made inside the explosion: a filter inferred for a column would be pushed down and repeat all that the column is made of.
    rows = rows.select(F.size("t").alias("k"), F.posexplode(F.concat("t", F.array_distinct("t"))).alias("at", "term"))
    counts = rows.groupBy("term").agg(F.count_if(F.col("at") >= F.col("k")).alias("df"), F.count_if(F.col("at") < F.col("k")).alias("n"))
    return counts.where((F.col("df") >= least) & (F.col("df") <= most * n)).orderBy(F.desc("n"), "term").limit(features).collect()


def tfidf_terms(df: DataFrame, text_col: str, features: int = 50, least: int = 5, most: float = 0.95, stop_words: Sequence[str] | None = None) -> list[tuple[str, float]]:
    """Terms with their idf, in order: those in at least ``least`` and at most ``most`` of the texts, the ``features`` most frequent of them.

    A pair is no more frequent than either of its words. So words are counted first, by
    partial sums, and terms are counted only among the most frequent ones; if the last
    term found is not more frequent than any word left out, all terms are counted. idf
    is ``ln((1 + n) / (1 + df)) + 1``.
    """
    if features < 1:
        return []
    stop = STOP_WORDS if stop_words is None else stop_words
    n = df.count()
    words = df.select(F.explode(_tokens(F.col(text_col))).alias("term")).where(~F.col("term").isin(*stop)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    among = max(LEAST_WORDS, WORDS_A_TERM * features)
    first = words.orderBy(F.desc("n"), "term").limit(among + 1).collect()
    rows = df.select(_words(F.col(text_col), stop).alias("_s"))
    top = _top_terms(rows, [r["term"] for r in first[:among]], n, features, least, most) if first else []
    if len(first) > among and (len(top) < features or top[-1]["n"] <= first[among]["n"]):
        top = _top_terms(rows, None, n, features, least, most)
    return sorted((r["term"], math.log((1 + n) / (1 + r["df"])) + 1) for r in top)


def _weights(df: DataFrame, text_col: str, terms: list[tuple[str, float]], stop_words: Sequence[str] | None) -> DataFrame:
    """``df`` with ``_w``: the normalised weight of every term, worked out within the row."""
    names = [t for t, _ in terms]
    rows = df.withColumn("_s", _words(F.col(text_col), STOP_WORDS if stop_words is None else stop_words))
    # Terms as numbers from 1; 0 is any other term.
    rows = rows.withColumn("_t", F.transform(_terms(F.col("_s"), sorted({w for t in names for w in t.split(" ")})), lambda x: F.array_position(F.array(*[F.lit(t) for t in names]), x)))
    weight = lambda k, idf: (F.size("_t") - F.size(F.array_remove("_t", F.lit(k).cast("long")))) * F.lit(idf)
    raw = rows.withColumn("_w", F.array(*[weight(k, idf) for k, (_, idf) in enumerate(terms, 1)]).cast("array<double>"))
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, x: a + x * x))
    return raw.withColumn("_n", norm).withColumn("_w", F.transform("_w", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0))).drop("_s", "_t", "_n")


def tfidf(df: DataFrame, id_col: str, text_col: str, features: int = 50, least: int = 5, most: float = 0.95, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``id, term, weight``: L2-normalised TF-IDF of one- and two-word terms, one row for each term that a text has."""
    terms = tfidf_terms(df, text_col, features, least, most, stop_words)
    if not terms:
        return df.select(F.col(id_col).alias("id"), F.lit("").alias("term"), F.lit(0.0).alias("weight")).where("false")
    names = F.array(*[F.lit(t) for t, _ in terms])
    rows = _weights(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", terms, stop_words)
    return rows.select("id", F.explode(F.arrays_zip(names.alias("term"), F.col("_w").alias("weight"))).alias("x")).select("id", "x.term", "x.weight").where("weight > 0")


def text_columns(df: DataFrame, columns: Sequence[str] = ("title_cleaned", "description_cleaned"), least_length: float = 10, **options) -> DataFrame:
    """A column ``<column>_tfidf_<i>`` for each term; columns whose texts have fewer than ``least_length`` characters on average are left out."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    length = df.agg(*[F.avg(F.length(F.coalesce(F.col(c), F.lit("")))).alias(c) for c in present]).first()
    for c in present:
        terms = tfidf_terms(df, c, **options) if (length[c] or 0) >= least_length else []
        if terms:
            df = _weights(df, c, terms, options.get("stop_words"))
            df = df.withColumns({f"{c}_tfidf_{i}": F.col("_w")[i] for i in range(len(terms))}).drop("_w")
    return df


# English words left out of terms by default; ``stop_words`` takes any other list.
STOP_WORDS = (
    "a about above after again against all also although always am among an and any anyone anything are around as at be became because become been before being below between both but by"
    " can cannot could did do does done down during each either else even ever every everyone everything everywhere few for from further get give go had has have he her here hers herself him himself his how however"
    " i if in into is it its itself last least less made many may me might mine more most much must my myself neither never next no nobody none nor not nothing now nowhere"
    " of off often on once one only onto or other others otherwise our ours ourselves out over own per same see seem seemed several she should since so some someone something sometimes still such"
    " than that the their them themselves then there therefore these they this those though through thus to together too toward under until up upon us very was we well were what when where whether which while who whole whom whose why will with within without would yet you your yours yourself"
).split()
