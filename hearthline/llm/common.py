"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.plans.tables import cut as materialise  # noqa: F401  used by the operators
from hearthline.sources.readers import read_table

#: The characters of ``[\x20\x09-\x0D]``, the only ones that count as white space here.
BLANKS = " \t\n\x0b\f\r"
#: Words in the sense of the corpus operators.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one in so many rows is hot; so there are fewer hot keys than this.
HOT_KEYS = 10_000
#: Bits of a broadcast bitmap: 2**MAX_BITS of them are half a million rows of 16 bytes.
MIN_BITS, MAX_BITS = 12, 25
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for costly functions of its rows: one in fewer pieces than there are cores is dealt over them."""
    return read_table(spark, f"{folder}/{name}.parquet")


def without_blanks(text: Column) -> Column:
    """Delete every blank; NULL counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in BLANKS:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name can clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def from_row(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` out of ``_row``."""
    return df.select(*[F.col("_row").getField(c).alias(c) for c in like.columns])


def lookup(rows: DataFrame, keyed: DataFrame, key: str | tuple[str, ...], weight: str, spread: str) -> DataFrame:
    """Left join of ``rows`` with the one row that ``keyed`` has for a key, in which no hot key fills a task.

    ``weight`` says how many rows a key has. Fewer than HOT_KEYS keys can have more
    than one in HOT_KEYS of all rows; these are broadcast, and their rows, like those
    without a key, are dealt by the column ``spread`` instead of meeting in one task.
    """
    keys = (key,) if isinstance(key, str) else key
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    values = F.struct(*[c for c in keyed.columns if c not in keys])
    is_hot = F.col(weight) * HOT_KEYS > F.lit(total)
    hot = keyed.where(is_hot).select(*[F.col(k).alias(f"_h{k}") for k in keys], values.alias("_hot"))
    # The remainder is always 0, but not a constant that the optimiser could fold out of the join's keys.
    cold = keyed.where(~is_hot).select(*[F.col(k).alias(f"_c{k}") for k in keys], F.pmod(F.hash(*keys), F.lit(1)).alias("_cs"), values.alias("_cold"))
    same = lambda side: functools.reduce(Column.__and__, [F.col(k) == F.col(f"_{side}{k}") for k in keys])
    alone = functools.reduce(Column.__or__, [F.col(k).isNull() for k in keys], F.col("_hot").isNotNull())
    salted = rows.join(F.broadcast(hot), same("h"), "left").withColumn("_salt", F.when(alone, 1 + F.pmod(F.hash(spread), F.lit(1 << 20))).otherwise(0))
    both = salted.join(cold, same("c") & (F.col("_salt") == F.col("_cs")), "left")
    found = F.coalesce("_hot", "_cold")
    return both.select(*rows.columns, *[found.getField(c).alias(c) for c in keyed.columns if c not in keys])


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` in batches of BATCH_ROWS rows at the most, so that long texts do not fill workers and buffers.

    The session's batch size is lowered if it is larger, which changes no result. A task
    gives its Arrow memory back when it ends, as workers are used again by later stages.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy, schema)


def bitmap_bits(keys: int) -> int:
    """Bits of a bitmap that is at most an eighth full, up to the largest allowed."""
    return min(MAX_BITS, max(MIN_BITS, (8 * keys).bit_length()))


def _slot(key: str, bits: int) -> tuple[Column, Column]:
    """Word and bit of a 64-bit key in a bitmap of 2**bits bits."""
    at = F.col(key).bitwiseAND((1 << bits) - 1)
    return F.shiftright(at, 6), at.bitwiseAND(63).cast("int")


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``word, bits``: at most 2**(bits - 6) rows, whatever the number of keys."""
    word, _ = _slot(key, bits)
    return keys.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 AS int))")).alias("bits"))


def possible(rows: DataFrame, keys: DataFrame, key: str, bits: int, within: bool = True) -> DataFrame:
    """The rows whose key may be among ``keys`` (or, not ``within``, surely is not), without a shuffle of the rows.

    A bitmap that is too small for many keys lets more rows pass as possible, never fewer.
    """
    word, _ = _slot(key, bits)
    marked = rows.withColumn("_w", word).join(F.broadcast(bitmap(keys, key, bits).withColumnRenamed("word", "_w")), "_w", "left")
    hit = F.coalesce(F.expr(f"(shiftright(bits, cast({key} & 63 AS int)) & 1) = 1"), F.lit(False))
    return marked.where(hit if within else ~hit).drop("_w", "bits")


def binaries(column: pa.Array, dtype: type) -> list[np.ndarray]:
    """The values of a binary column as arrays that share its memory."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [raw[a:b].view(dtype) for a, b in zip(at[:-1], at[1:], strict=True)]


def grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple[int, ...], list[tuple[pa.RecordBatch, int, int]]]]:
    """Runs of rows that agree in the first ``width`` long columns, as parts ``batch, from, to``.

    The rows come sorted by those columns; a run may go on in the next batch.
    """
    at: tuple[int, ...] | None = None
    parts: list[tuple[pa.RecordBatch, int, int]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)])
        starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            here = tuple(keys[:, a].tolist())
            if here != at:
                if parts:
                    yield at, parts
                at, parts = here, []
            parts.append((batch, int(a), int(b)))
    if parts:
        yield at, parts
