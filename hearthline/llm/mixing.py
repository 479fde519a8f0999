"""Mix sources to target weights with hash thresholds and no sort.

Each row has a fixed hash. Per source, the words are summed by hash bucket; the
bucket in which the running sum passes the budget is the boundary, and only its
rows are summed again by the next bits of the hash, level by level. The levels
together make one threshold per source, and a row is taken when its hash lies
below it. A larger budget has a larger threshold, so the samples are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.stats import numbered
from hearthline.llm.common import as_row, from_row, lookup, materialise, word_count

BITS = 10
LEVELS = 3
#: Source tables of up to so many bytes are broadcast; of larger ones, only the hot sources.
BROADCAST_BYTES = 4 << 20


def source_targets(sources: DataFrame, max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets of ``source, source_size``: shares by weight, at most ``max_repeats`` of a source.

    Sources by code point, NULL last, take the weights in turn. Sources that their share
    would repeat too often are capped and the rest is shared again, until none is above:
    each round is one sum over the sources, and the level only rises.

    Edge cases: a source of size 0 has target 0; without words all targets are 0; a NULL
    source is a source; an empty table gives an empty result; sources are distinct.
    """
    turn = F.pmod(F.col("_turn"), F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int"))
    ranked = numbered(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], "_turn")
    ranked = materialise(ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(max_repeats))).alias("cap")))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("w")
        held, free = ranked.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w")))).first()
        if not free:  # every source is capped
            break
        higher = (total - float(held or 0)) / free
        if higher <= level:
            break
        level = higher
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def _key(source: Column) -> Column:
    """A source as a key that is never NULL."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join the one row of ``sources`` to each of ``rows``, both by ``key``; ``n`` is a source's number of rows."""
    size = sources.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(sources), "key")
    return lookup(rows, sources, "key", "n", "h")


def _columns(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """``key, text_hash, h``: the source, and the leading hash bits as an integer below 2**(BITS * LEVELS)."""
    text_hash = F.xxhash64(F.col(f"`{text_col}`"))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text_hash), 64 - BITS * LEVELS)
    return [_key(F.col(f"`{source_col}`")).alias("key"), text_hash.alias("text_hash"), h.alias("h")]


def _thresholds(rows: DataFrame, max_repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """``key, source_size, n, target, passes, low`` by source: full passes, and the hash below which a row is taken once more."""
    sums = materialise(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    name = F.when(F.col("key") != "", F.substr("key", F.lit(2)))
    targets = source_targets(sums.select(name.alias("source"), "source_size"), max_repeats, weights)
    state = materialise(
        targets.select(_key(F.col("source")).alias("key"), "target")
        .join(sums, "key")
        .withColumn("passes", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("low", F.lit(0).cast("long"))  # rows below `low` are in; `rest` counts what is left from there
    )
    names = ["key", "source_size", "n", "target", "passes"]
    for level in range(1, LEVELS + 1):
        span = 1 << (BITS * (LEVELS - level))
        within = (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + span * (1 << BITS))
        inside = _with_sources(rows, state.select("key", "n", "low", "rest")).where(within)
        sums = inside.groupBy("key", F.shiftright(F.col("h") - F.col("low"), BITS * (LEVELS - level)).alias("b")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        running = Window.partitionBy("key").orderBy("b")  # at most 2**BITS rows of a source
        upto = sums.withColumn("upto", F.sum("words").over(running))
        # The buckets that fit whole; the one after them is the boundary.
        fits = F.col("upto") <= F.col("rest")
        edges = upto.groupBy("key").agg(F.max(F.when(fits, F.col("b"))).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("used"), F.min(F.when(~fits, F.struct("b", "words"))).alias("edge"))
        left = F.col("rest") - F.coalesce("used", F.lit(0))
        bucket = F.coalesce(F.col("edge.b"), F.col("last") + 1, F.lit(0))
        if level == LEVELS:  # the boundary cell goes in if that comes nearer to the budget
            bucket = bucket + F.when(2 * left >= F.col("edge.words"), 1).otherwise(0)
        state = materialise(state.join(edges, "key", "left").select(*names, left.alias("rest"), (F.col("low") + bucket * span).alias("low")))
    return state.drop("rest")


def _repeats(max_repeats: int) -> Column:
    return (F.col("passes") + F.when((F.col("h") < F.col("low")) & (F.col("passes") < max_repeats), 1).otherwise(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = 3,
    weights: tuple[int, ...] = (1, 2, 3),
    seed: int = 17,
) -> DataFrame:
    """How many of each row's words a mix at the target weights takes.

    Returns ``id_col, size, source_size, target, taken, repeats, text_hash``. A
    source whose target is ``k`` times its size and a rest takes every row ``k``
    times, and the rest from the rows whose hash lies below the threshold.

    Edge cases: NULL source is a source of its own, last in order; NULL and empty
    texts have size 0 and take 0; rows that repeat id and text share their hash and
    are taken together; NULL ids hash by text alone; an empty table gives an empty
    result; other columns are not read.
    """
    rows = materialise(docs.select(F.col(f"`{id_col}`").alias("id"), word_count(F.col(f"`{text_col}`")).alias("size"), *_columns(id_col, text_col, source_col, seed)))
    repeats = _repeats(max_repeats)
    return _with_sources(rows, _thresholds(rows, max_repeats, weights)).select(
        F.col("id").alias(id_col),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("size") * repeats).alias("taken"),
        repeats.alias("repeats"),
        "text_hash",
    )


def take_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = 3,
    weights: tuple[int, ...] = (1, 2, 3),
    seed: int = 17,
) -> DataFrame:
    """The mix itself: every row as often as ``mix_sources`` takes it, with all its columns.

    Each row meets its source's threshold alone, so texts are not shuffled.

    Edge cases: as for ``mix_sources``; rows without words are in the mix once for each
    full pass of their source; rows that repeat id and text are taken alike; column names
    may clash with any used here; an empty table stays empty.
    """
    columns = _columns(id_col, text_col, source_col, seed)
    sized = materialise(docs.select(word_count(F.col(f"`{text_col}`")).alias("size"), *columns).select("key", "size", "h"))
    rows = docs.select(as_row(docs), *columns).drop("text_hash")
    found = _with_sources(rows, _thresholds(sized, max_repeats, weights)).withColumn("_r", _repeats(max_repeats)).where("_r > 0")
    return from_row(found.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_r").cast("int")))), docs)
