"""Exact duplicates through an extendible-hash index, in DataFrame operations only.

A text's key is the leading 60 bits of the SHA-256 of its normal form. Leading bits
of the key address a directory, which starts with one entry and doubles while a
bucket holds more distinct keys than its capacity; buckets that fit keep a smaller
local depth and are shared by several entries. As a bucket is a range of keys, the
index is a set of files by key range, written by the tasks that own the buckets.

Texts whose keys several rows share are routed by the directory to the owners of
their buckets. There, texts with equal keys form a chain, whose links are told apart
by their bytes, and each link knows its copies. Every row then looks up its link in
its bucket's chains. A hot text is reduced to one row per task before it is routed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import HOT_KEYS, as_row, bitmap_bits, from_row, lookup, materialise, possible, without_blanks

#: The finest directory: at most 2**MAX_DEPTH entries, which bounds what the driver and a broadcast hold. Buckets of that depth overflow.
MAX_DEPTH = 16
KEY_BITS = 60
#: Distinct keys of a bucket.
CAPACITY = 4096


def split_directory(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """Double a directory until no bucket is overfull, or to ``depth`` at the most.

    ``counts`` has the keys under each prefix of ``depth`` bits. Returns one
    ``(entry, bucket, local_depth)`` for each of the ``2**global_depth`` entries,
    which are given at ``depth`` bits; a bucket is named by its first entry.
    """
    sums = [[0] * (1 << d) for d in range(depth + 1)]
    for prefix, n in counts.items():
        for d in range(depth + 1):
            sums[d][prefix >> (depth - d)] += n
    entries: list[tuple[int, int, int]] = []
    pending = [(0, 0)]
    while pending:
        d, prefix = pending.pop()
        if sums[d][prefix] > capacity and d < depth:
            pending += [(d + 1, 2 * prefix + 1), (d + 1, 2 * prefix)]
            continue
        span = depth - d
        entries += [(e, prefix << span, d) for e in range(prefix << span, (prefix + 1) << span)]
    return entries


def key_of(sha: Column) -> Column:
    """The leading KEY_BITS bits of a digest."""
    return F.conv(F.substring(F.hex(F.substring(sha, 1, 8)), 1, KEY_BITS // 4), 16, 10).cast("long")


def _entry(depth: int) -> Column:
    return F.shiftright("h", KEY_BITS - depth).cast("int")


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory over distinct keys ``h``, ``entry, bucket, depth``, and its global depth.

    A key with many copies counts once, so a hot text cannot overfill a bucket.
    """
    # One row per directory entry at the most.
    counts = {r[0]: r[1] for r in keys.groupBy(_entry(MAX_DEPTH).alias("p")).count().collect()}
    entries = split_directory(counts, MAX_DEPTH, capacity)
    depth = max(d for _, _, d in entries)
    unused = MAX_DEPTH - depth
    rows = [(e >> unused, b, d) for e, b, d in entries if not e & ((1 << unused) - 1)]
    return keys.sparkSession.createDataFrame(rows, "entry int, bucket int, depth int"), depth


def in_buckets(rows: DataFrame, directory: tuple[DataFrame, int]) -> DataFrame:
    """Look each key up in the directory, which has 2**MAX_DEPTH entries at the most."""
    entries, depth = directory
    return rows.join(F.broadcast(entries), _entry(depth) == F.col("entry")).drop("entry")


def chains_of(texts: DataFrame, shared: DataFrame, directory: tuple[DataFrame, int]) -> DataFrame:
    """``bucket, h, link, sha, keep, size``: the distinct texts of every key, numbered along its chain, with their copies.

    ``texts`` has ``id, len, h, norm`` and ``shared`` the rows ``n`` of a key. The
    longest row is kept, then the smallest id; NULL ids sort below every other.
    """
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(shared.where(F.col("n") * HOT_KEYS > total).select("h", F.lit(True).alias("hot")))  # fewer than HOT_KEYS keys
    # An outer join, as the optimiser would move a semi or anti join, and with it the digests, below the bitmap.
    marked = texts.join(hot, "h", "left")
    own = F.struct("len", F.negative(F.col("id").cast("decimal(20,0)")).alias("neg"))
    cold = marked.where("hot is null").select("h", "norm", own.alias("best"), F.lit(1).cast("long").alias("size"))
    many = marked.where("hot").groupBy("h", "norm").agg(F.max(own).alias("best"), F.count(F.lit(1)).alias("size"))
    owners = in_buckets(cold.unionByName(many), directory).repartition("bucket")
    # Within its owner: equal bytes are one link; the grouping needs no further exchange.
    links = owners.groupBy("bucket", "h", "norm").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    chain = Window.partitionBy("bucket", "h").orderBy("sha")  # the texts that collide in one key
    linked = links.select("bucket", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.negative(F.col("best.neg")).cast("long").alias("keep"), "size")
    return linked.withColumn("link", F.row_number().over(chain))


def classified(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """``id, sha, tag, bucket, depth, keep, size`` of every row; ``tag`` is a cheap hash of the text as it is."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("tag", F.xxhash64("text"))
    normal = without_blanks(F.col("text")).alias("norm")
    digest = F.unhex(F.sha2("norm", 256)).alias("sha")
    rows = source.select("id", "tag", normal).select("id", "tag", digest).withColumn("h", key_of(F.col("sha")))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    keys = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    directory = build_directory(keys.select("h"), capacity)
    # The index file set: each file is one owner's buckets, sorted by key.
    index = materialise(in_buckets(keys, directory).repartition("bucket").sortWithinPartitions("bucket", "h"))
    shared = index.where("n > 1").select("h", "n")
    bits = bitmap_bits(shared.count())
    # Only keys with several rows can hold copies or collisions; nearly all other texts are neither normalised again nor moved.
    tags = materialise(possible(rows, shared, "h", bits).select("tag").distinct())
    texts = possible(source, tags, "tag", bitmap_bits(tags.count()))
    texts = texts.select("id", F.coalesce(F.char_length("text"), F.lit(0)).alias("len"), normal)
    chains = materialise(chains_of(texts.withColumn("h", key_of(F.unhex(F.sha2("norm", 256)))), shared, directory))
    names = ["id", "sha", "tag", "bucket", "depth", "keep", "size"]
    alone = in_buckets(possible(rows, shared, "h", bits, within=False), directory)
    alone = alone.withColumns({"keep": F.col("id"), "size": F.lit(1).cast("long")}).select(*names)
    several = in_buckets(possible(rows, shared, "h", bits), directory)
    several = lookup(several, chains.select("bucket", "sha", "keep", "size"), ("bucket", "sha"), "size", "row").select(*names)
    return alone.unionByName(several)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Group rows whose texts are equal once all of ``[\\x20\\x09-\\x0D]`` is deleted.

    Returns ``id_col, keep_id, group_size, kept, text_sha256, bucket, depth``, one row
    per input row; ``bucket`` is the first entry of the bucket in the finest directory and
    ``depth`` its local depth. The row that stays has the most code points in the original
    text, then the smallest id.

    Edge cases: NULL text counts as the empty text, and all such rows form one
    group; a NULL id loses every tie; rows that repeat an id with an equal text
    are one group in which the surviving id marks each of its copies as kept; an
    empty table gives an empty result; other columns are not read.
    """
    return classified(docs, id_col, text_col, capacity).select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "depth",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_duplicates`` keeps, with all their columns.

    Edge cases: as there; rows that repeat both id and text all carry the surviving
    id, and one of them stays; column names may clash with any used here.
    """
    groups = materialise(classified(docs, id_col, text_col).where("size > 1").select("id", "sha", "tag", "keep"))
    text = F.col(f"`{text_col}`")
    named = docs.select(as_row(docs), F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("tag"))
    tags = materialise(groups.select("tag").distinct())
    bits = bitmap_bits(tags.count())
    # A row of a group of its own bypasses the join; of the others, those with the id and text that stay are found.
    alone = possible(named, tags, "tag", bits, within=False)
    maybe = possible(named, tags, "tag", bits).select("_row", "_id", without_blanks(F.col("_text")).alias("_norm"))
    maybe = maybe.select("_row", "_id", F.unhex(F.sha2("_norm", 256)).alias("_sha"))
    # One entry a text; texts without one are groups of their own.
    again = F.count_if(F.col("id").eqNullSafe(F.col("keep"))) > 1
    entry = materialise(groups.groupBy(F.col("sha").alias("_sha")).agg(F.first("keep").alias("keep"), again.alias("again"), F.count(F.lit(1)).alias("n")))
    found = lookup(maybe, entry, "_sha", "n", "_id")
    once = found.where("n is null or (not again and _id <=> keep)").select("_row")
    twice = found.where("again and _id <=> keep").dropDuplicates(["_sha"]).select("_row")
    return from_row(alone.select("_row").unionByName(once).unionByName(twice), docs)
