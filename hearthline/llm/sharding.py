"""Contiguous shards of near-equal bytes by global prefix sums.

The rows are range-partitioned by id once. Every partition contributes one
total, the exclusive prefix sums of those totals give each partition its global
offset, and a running sum inside the partition gives each row its byte range.
Shards are the rows between equal byte targets, so each shard is a contiguous
id range and no shard is off by more than one row's bytes at either end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import materialise


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign each row to one of ``shards`` contiguous byte-balanced shards.

    Returns ``id_col, size, text_crc32, shard, slot, start_byte``. ``size`` is
    the UTF-8 length plus one. A row belongs to the shard in whose byte range
    its midpoint falls; ``slot`` numbers a shard's rows from 0 in id order.

    Edge cases: NULL text has size 1 and CRC 0, as the empty text; NULL ids come
    first; repeated ids and repeated rows are ordered by size and CRC and stay
    separate rows; an empty table gives an empty result; other columns of the
    input, whatever their names, are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    sized = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("_size"),
        F.crc32(text).alias("_crc"),
    )
    order = ["_id", "_size", "_crc"]
    # Range bounds are sampled, so the numbering is fixed by a checkpoint before it is read twice.
    ranged = materialise(
        sized.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_at")
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # One row per partition: its count is set by the partitioning, not by the number of documents.
    offsets = (
        ranged.groupBy("_part")
        .agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
            F.sum("_bytes").over(everything).alias("_total"),
        )
    )
    running = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("_before", F.coalesce(F.sum("_size").over(running), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .select(
            "_id",
            "_size",
            "_crc",
            (F.col("_byte0") + F.col("_before")).alias("_start"),
            (F.col("_row0") + F.col("_row")).alias("_index"),
            F.least(
                F.floor((2 * (F.col("_byte0") + F.col("_before")) + F.col("_size")).cast("double") * shards / (2 * F.col("_total"))),
                F.lit(shards - 1),
            ).cast("int").alias("_shard"),
        )
    )
    # At most one row per shard.
    first = placed.groupBy("_shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(first), "_shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        (F.col("_index") - F.col("_first")).alias("slot"),
        F.col("_start").alias("start_byte"),
    )
