"""Statistics as Column builders."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hearthline.plans.tables import cut


#: Rank error of the sketches that bracket quantiles is one in so many rows; so many rows of a bracket are fetched.
ACCURACY, FETCHED = 10_000, 200_000


def over(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def pct_rank(value: Column | str, *keys: str) -> Column:
    """Average rank of ties over the number of non-NULL values; NULL for NULL."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*keys).orderBy(v.asc_nulls_last())
    ties = Window.partitionBy(*keys, v)
    rank = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return F.when(v.isNotNull(), rank / F.count(v).over(Window.partitionBy(*keys)))


def pct_rank_global(df: DataFrame, value: str, out: str, base: DataFrame | None = None) -> DataFrame:
    """``pct_rank`` over the whole table without sorting all rows in one task."""
    return pct_rank_in(df, value, (), out, base)


def pct_rank_in(df: DataFrame, value: str, keys: Sequence[str], out: str, base: DataFrame | None = None) -> DataFrame:
    """``pct_rank`` within ``keys``, in which no group is sorted in one task.

    Rows meet in counts of distinct values; these are ranked by ranges of their group,
    whose totals are summed up first. ``base`` may give the values from a smaller plan.
    """
    base = df if base is None else base
    names = [f"_k{i}" for i in range(len(keys))]
    rows = base.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    counts = rows.groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_n"))
    # Bounds are fixed by quantiles, so both uses of the ranges agree.
    cuts = rows.groupBy(*names).agg(F.percentile_approx("_v", [i / 64 for i in range(1, 64)], 1000).alias("_c"))
    same = lambda left, right: reduce(Column.__and__, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names], F.lit(True))
    bounded = counts.alias("a").join(cuts.alias("b") if names else F.broadcast(cuts).alias("b"), same("a", "b"))
    bucket = F.size(F.filter(F.coalesce("_c", F.array().cast("array<double>")), lambda x: x < F.col("_v")))
    counts = bounded.select(*[F.col(f"a.{n}") for n in names], "_v", "_n", bucket.alias("_b"))
    totals = counts.groupBy(*names, "_b").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*names, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(*names)).alias("_all"))
    run = Window.partitionBy(*names, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_run", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    ranked = ranked.alias("a").join(totals.alias("b") if names else F.broadcast(totals).alias("b"), same("a", "b") & (F.col("a._b") == F.col("b._b")))
    place = (F.col("_before") + F.col("_run") + (F.col("_n") + 1) / 2) / F.col("_all")
    ranks = ranked.select(*[F.col(f"a.{n}") for n in names], "_v", place.alias("_place"))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], F.col(value) == F.col("_v"))
    return df.join(ranks, on, "left").withColumn(out, F.col("_place")).drop("_v", "_place", *names)


def rolling(value: str, order: Sequence[str], keys: Sequence[str], rows: int = 10, least: int = 3) -> tuple[Column, Column]:
    """Mean and sample deviation of the last ``rows`` rows, NULL below ``least`` values."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    enough = F.count(value).over(w) >= least
    return F.when(enough, F.avg(value).over(w)), F.when(enough, F.stddev_samp(value).over(w))


def right_closed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the bin ``(low, high]``; NULL outside all of them."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        inside = (value > lo) & (value <= hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    if out is None:
        raise ValueError("no bins")
    return out


def quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, interpolated linearly between ranks; None for columns without values.

    No task holds a column: sketches bracket each quantile, and rows inside a bracket
    are bracketed again until few are left, whose distinct values are counted. Each
    step is one aggregate for all columns and returns a bounded number of rows.
    """
    columns = [c for c in wanted if wanted[c]]
    if not columns:
        return {c: [] for c in wanted}
    value = {c: F.col(f"`{c}`").cast("double") for c in columns}
    first = df.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    size = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    # A bracket for each rank: its bounds, and the rows of the column in it and below it.
    at = {(c, p): p * (size[c] - 1) for c in columns for p in wanted[c] if size[c]}
    ranks = sorted({(c, r) for (c, _), x in at.items() for r in (math.floor(x), math.ceil(x))}, key=str)
    low: dict[tuple[str, int], float | None] = dict.fromkeys(ranks)
    high: dict[tuple[str, int], float | None] = dict.fromkeys(ranks)
    inside, below = {t: size[t[0]] for t in ranks}, dict.fromkeys(ranks, 0)

    def within(t: tuple[str, int]) -> Column:
        v = value[t[0]]
        return reduce(Column.__and__, [v >= F.lit(low[t])] * (low[t] is not None) + [v <= F.lit(high[t])] * (high[t] is not None), v.isNotNull())

    margin, closed = dict.fromkeys(ranks, 2 / ACCURACY), set()
    while wide := [t for t in ranks if inside[t] > FETCHED and t not in closed]:
        # The two ranks next to a quantile share a bracket, and ranks in one bracket a sketch.
        share = lambda t, r, d: min(1.0, max(0.0, (r - below[t]) / max(1, inside[t] - 1) + d * margin[t]))
        mate = lambda t, d: t[1] + d * ((t[0], t[1] + d) in inside and (low[t], high[t]) == (low[t[0], t[1] + d], high[t[0], t[1] + d]))
        sketches: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
        for t in wide:
            sketches[t[0], low[t], high[t]].append(t)
        cuts = df.agg(*[F.percentile_approx(F.when(within(ts[0]), value[ts[0][0]]), [share(t, mate(t, d), d) for t in ts for d in (-1, 1)], ACCURACY).alias(f"q{i}") for i, ts in enumerate(sketches.values())]).first()
        before = {t: (low[t], high[t]) for t in wide}
        for i, ts in enumerate(sketches.values()):
            for j, t in enumerate(ts):
                low[t], high[t] = cuts[f"q{i}"][2 * j : 2 * j + 2]
        bracket = lambda t: (t[0], low[t], high[t])
        sample = {bracket(t): t for t in wide}
        number = {k: i for i, k in enumerate(sample)}
        counts = df.agg(*[x for k, t in sample.items() for x in (F.count_if(within(t)).alias(f"m{number[k]}"), F.count_if(value[t[0]] < F.lit(low[t])).alias(f"b{number[k]}"))]).first()
        at_bracket = {t: number[bracket(t)] for t in wide}
        for t in wide:
            m, b = counts[f"m{at_bracket[t]}"], counts[f"b{at_bracket[t]}"]
            if not b <= t[1] < b + m:  # the sketch was off by more than its margin
                (low[t], high[t]), margin[t] = before[t], 4 * margin[t]
                continue
            if m == inside[t] or low[t] == high[t]:  # ties fill the bracket
                closed.add(t)
            inside[t], below[t] = m, b
    spans: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
    for t in ranks:
        spans[t[0], low[t], high[t], below[t]].append(t)
    cells = F.array(*[F.when(within(ts[0]), F.struct(F.lit(i).alias("i"), value[k[0]].alias("v"))) for i, (k, ts) in enumerate(spans.items())])
    rows = df.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n")).collect() if spans else []
    found: dict[tuple[str, int], float] = {}
    for i, (key, ts) in enumerate(spans.items()):
        run, values = key[3], sorted(((r["v"], r["n"]) for r in rows if r["i"] == i), key=lambda x: (math.isnan(x[0]), x[0]))
        for v, n in values:
            found |= {t: v for t in ts if run <= t[1] < run + n}
            run += n
    out: dict[str, list[float | None]] = {}
    for c in wanted:
        out[c] = []
        for p in wanted[c]:
            if (c, p) not in at:
                out[c].append(None)
                continue
            x = at[c, p]
            a, b = found[c, math.floor(x)], found[c, math.ceil(x)]
            out[c].append(a if a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b)
    return out


def medians(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``key, out``: the exact median of each group, NULL keys left out.

    A group is bracketed by a sketch and only the values in its bracket are ordered, so
    a hot group does not gather in a task.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    near = [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY]
    cuts = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", near, ACCURACY).alias("_q"))
    inside = F.when(F.col("_v") >= F.col("_q")[0], F.col("_v"))
    counted = rows.join(cuts, "_k").where(F.col("_v") <= F.col("_q")[1]).groupBy("_k", "_n", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_k").orderBy(F.col("_v").asc_nulls_first()))
    middle = (F.col("_n") - 1) / 2
    holds = lambda rank: (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
    ranked = counted.withColumn("_upto", upto)
    both = [F.max(F.when(holds(r), F.col("_v"))) for r in (F.floor(middle), F.ceil(middle))]
    return ranked.groupBy("_k").agg(((both[0] + both[1]) / 2).alias(out)).withColumnRenamed("_k", key)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """The most frequent value of each text column, the smallest of several; None without any."""
    if not columns:
        return {}
    cells = F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v"))) for i, c in enumerate(columns)])
    counts = df.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    best = {r["i"]: r["m"]["v"] for r in counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m")).collect()}
    return {c: best.get(i) for i, c in enumerate(columns)}


def quantile_bins(df: DataFrame, value: str, out: str, q: int = 10, base: DataFrame | None = None) -> DataFrame:
    """Quantile bin numbers with repeated edges dropped; ``base`` may give the values from a smaller plan."""
    found = quantiles(df if base is None else base, {value: [i / q for i in range(q + 1)]})[value]
    return df.withColumn(out, bin_number(F.col(value), found))


def bin_number(value: Column, found: Sequence[float | None]) -> Column:
    """The number of the bin between distinct ``found`` quantiles; the first bin holds its lower edge."""
    edges = sorted({x for x in found if x is not None})
    above = reduce(Column.__add__, [(value > F.lit(x)).cast("int") for x in edges], F.lit(0))
    return F.when(value.isNotNull(), F.greatest(F.lit(0), above - 1)).cast("int")


def numbered(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """Rows numbered from 0 in the order of distinct keys, by range partitions and their totals."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, whatever the number of rows.
    starts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(out, (F.col("_start") + row).cast("int")).drop("_part", "_start", "_at")


def places_by_hash(df: DataFrame, keys: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """``_place`` from 1 in the order of a hash of the id within ``keys``, and ``_size`` of the group.

    A group is cut by the leading bits of the hash, whose counts are summed up first, so
    a hot group is sorted in some thousands of parts.
    """
    rows = df.withColumn("_h", F.xxhash64(id_col, F.lit(seed))).withColumn("_b", F.shiftright("_h", 52))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_size"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_b") == F.col("_kb"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", id_col))
    placed = rows.join(counts, same).withColumn("_place", F.col("_before") + inside)
    return placed.drop("_h", "_b", "_kb", "_before", *[f"_k{i}" for i in range(len(keys))])


def zscore_in(value: str, *keys: str) -> Column:
    """Distance from the group mean in sample deviations; NULL where these are 0."""
    w = Window.partitionBy(*keys)
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL for a denominator of 0."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
