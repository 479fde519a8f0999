"""Near duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its five-word shingles. The sketch has a fixed number of
coordinates. In each round every shingle is hashed to one coordinate and a value,
and a coordinate keeps its smallest (round, value); as the last rounds visit each
coordinate in turn, all are filled, and the sketch's estimate is concentrated as if
its coordinates were independent. Bands of coordinates are the bucket keys.

Equal sets are one node. Sketches and full sets of the nodes that share a bucket are
carried into cells, buckets or blocks of large ones, in which pairs of different
components are compared: estimates first, then the full sets, each pair in the first
band that both share. A cell joins what it links and returns one row for each
component that it merges, never its pairs. A few bands are compared first, so that
the later ones carry only buckets that still hold several components. Large buckets
are at last compared block by block wherever components still differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import arrow, as_row, binaries, bitmap_bits, from_row, grouped, lookup, materialise, possible
from hearthline.llm.components import links_of_repeated_ids, relabelled, with_smallest_id

SHINGLE = 5
#: 48 bands of 6: a pair of similarity 0.75 shares no band with probability 0.00008, one of 0.1 shares one with 0.00005.
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Estimates this far below the limit are still verified: 3.5 standard deviations of BINS coordinates at 0.75.
MARGIN = 0.09
#: Coordinates are kept by this many bits of their hash; unequal ones agree by chance with probability 1/256, which only adds candidates.
COORDINATE = np.uint8
#: Rows and bytes of full sets in a block, about, and the bands that are compared first.
BLOCK, BLOCK_BYTES, FIRST_BANDS = 1024, 8 << 20, 6

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole UTF-8 text.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` splits at ``[\\x20\\x09-\\x0D]``
    alone. Fewer words than a shingle has make one element, none make the empty set.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _MUL + h[k : k + n]
    return np.unique(_mix(out))


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The filled coordinates of a non-empty set."""
    n, t, empty = len(elements), bins, np.iinfo(np.uint64).max
    out = np.full(t, empty, np.uint64)
    at = 0
    while at < t:
        # So many rounds at once as fill nearly all coordinates; later rounds never replace earlier ones.
        rounds = np.arange(at, min(t, at + max(1, int(np.ceil(t * np.log(t) / n)))), dtype=np.uint64)
        g = _mix(elements[None, :] ^ _mix(rounds + np.uint64(1))[:, None])
        where = ((g >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        value = (rounds[:, None] << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, where.ravel().astype(np.int64), value.ravel())
        at += len(rounds)
        if out.max() != empty:
            return out
    for b in np.flatnonzero(out == empty):  # round t + b looks at coordinate b alone
        g = _mix(elements ^ _mix(np.array([t + b + 1], np.uint64)))
        out[b] = (np.uint64(t + b) << np.uint64(32)) | (g.min() & np.uint64(0xFFFFFFFF))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, tag, n, key, coords``: row number, hash of id and text, set size, digest of the set and sketch (NULL if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, keys, coords = [], [], []
                for text in batch.column(2):
                    s = shingle_set(text.as_py())
                    sizes.append(len(s))
                    keys.append(digest(s))
                    coords.append((_mix(sketch(s)) >> np.uint64(56)).astype(COORDINATE).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(coords, pa.binary())],
                    names=["id", "tag", "n", "key", "coords"],
                )

    found = arrow(_texts(docs, id_col, text_col), run, "id long, tag long, n long, key binary, coords binary")
    return found.withColumn("row", F.monotonically_increasing_id())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, name = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    return docs.select(name.alias("id"), F.xxhash64(name, text).alias("tag"), text.cast("binary").alias("text"))


def digest(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def full_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, n, coords, elements`` for ``members``, whose texts alone are read again into sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                sets = [shingle_set(t.as_py()) for t in whole.column(2).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "elements"])

    texts = possible(_texts(docs, id_col, text_col), members.select("tag"), "tag", bitmap_bits(members.count()))
    # Repeated rows, and texts that the bitmap let pass, meet in a partial aggregate.
    sets = arrow(texts, run, "key binary, elements binary").groupBy("key").agg(F.first("elements").alias("elements"))
    return members.join(sets, "key").select("node", "n", "coords", "elements")


_CELL = ["bkey", "xp", "x", "yp", "y"]
_ROW = "bkey long, xp long, x long, yp long, y long, band long, pure long, block long, comp long, node long"


class Cell:
    """The rows of one cell: components, set sizes, sketches, and full sets if they were carried along."""

    def __init__(self, here: tuple[int, ...], parts: list[list]):
        self.band, self.pure, self.block, self.comp, self.node, self.n, self.grid = (np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*[p[:7] for p in parts], strict=True))
        self.sets = [s for p in parts for s in p[7]]
        _, xp, x, yp, y = here
        self.left = np.flatnonzero((self.pure == xp) & (self.block == x))
        self.right = self.left if (xp, x) == (yp, y) else np.flatnonzero((self.pure == yp) & (self.block == y))
        self.label = np.unique(self.comp, return_inverse=True)[1]

    def partners(self, i: int, percent: int, least: int) -> np.ndarray:
        """Rows of other components that ``i`` first meets in this band and whose size and sketch come near the limit."""
        other = self.right[self.right > i] if self.left is self.right else self.right
        other = other[self.label[other] != self.label[i]]
        other = other[(100 * self.n[other] >= percent * self.n[i]) & (100 * self.n[i] >= percent * self.n[other])]
        if not len(other):
            return other
        agree = self.grid[other] == self.grid[i]
        near = np.flatnonzero(agree.sum(1) >= least)
        return other[near[agree[near].reshape(len(near), BANDS, ROWS).all(2).argmax(1) == self.band[i]]]

    def linked(self, i: int, other: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``other`` whose full sets are similar to that of ``i``; elements in common are counted for all at once."""
        mine, theirs = self.sets[i], np.concatenate([self.sets[j] for j in other])
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(self.n[other])[:-1]]), dtype=np.int64)
        return other[100 * common >= percent * (self.n[i] + self.n[other] - common)]


def _cells(rows: DataFrame, solve: Callable[[Cell], np.ndarray | None], keep: bool, schema: str) -> DataFrame:
    """``solve`` on each cell that holds two components. With ``keep`` it names rows to return, else it returns rows."""
    full = "elements" in rows.columns
    rows = rows.select(*_CELL, "band", "pure", "block", "comp", "node", "n", "coords", *(["elements"] if full else []))
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, columns = None, []

        def decoded(batch: pa.RecordBatch) -> list:
            nonlocal last, columns
            if batch is not last:
                grid = np.frombuffer(b"".join(batch.column(11).to_pylist()), COORDINATE).reshape(-1, BINS)
                columns = [*[batch.column(k).to_numpy() for k in range(5, 11)], grid, binaries(batch.column(12), np.uint64) if full else []]
                last = batch
            return columns

        out: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found = np.concatenate(out) if out else np.zeros((0, len(names)), np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(len(names))], names=names)

        for here, parts in grouped(batches, len(_CELL)):
            if sum(b - a for _, a, b in parts) < 2:
                continue
            cell = Cell(here, [[c[a:b] for c in decoded(batch)] for batch, a, b in parts])
            if cell.label.any() and (found := solve(cell)) is not None:
                if keep:
                    same = np.broadcast_to(np.array(here), (len(found), len(here)))
                    found = np.concatenate([same, np.stack([c[found] for c in (cell.band, cell.pure, cell.block, cell.comp, cell.node)], 1)], 1)
                out.append(found)
                if len(out) > 2000 or len(found) > 2000:
                    yield flush()
        yield flush()

    return arrow(rows.repartition(*_CELL).sortWithinPartitions(*_CELL), run, schema)


def _least(percent: int) -> int:
    return int(np.ceil(BINS * (percent / 100 - MARGIN)))


def promising(cells: DataFrame, percent: int) -> DataFrame:
    """The rows of ``cells`` that have a partner by size and sketch; only their full sets need be moved."""
    least = _least(percent)

    def solve(cell: Cell) -> np.ndarray | None:
        hopeful = np.zeros(len(cell.comp), bool)
        for i in cell.left:
            other = cell.partners(i, percent, least)
            if len(other):
                hopeful[i] = hopeful[other] = True
        return np.flatnonzero(hopeful) if hopeful.any() else None

    return _cells(cells, solve, True, _ROW)


def merges(cells: DataFrame, percent: int) -> DataFrame:
    """``a, b``: components ``a`` that cells join to their smallest component ``b``.

    ``cells`` has ``bkey, xp, x, yp, y, band, pure, block, comp, node, n, coords,
    elements``, where rows of block ``(xp, x)`` meet those of block ``(yp, y)``.
    """
    least = _least(percent)

    def solve(cell: Cell) -> np.ndarray | None:
        merged = False
        for i in cell.left:
            other = cell.partners(i, percent, least)
            for k in np.unique(cell.label[cell.linked(i, other, percent)]) if len(other) else ():
                cell.label[cell.label == k] = cell.label[i]
                merged = True
        if not merged:
            return None
        low: dict[int, int] = {}
        for c, k in zip(cell.comp.tolist(), cell.label.tolist(), strict=True):
            low[k] = min(low.get(k, c), c)
        pairs = {(c, low[k]) for c, k in zip(cell.comp.tolist(), cell.label.tolist(), strict=True) if c != low[k]}
        return np.array(sorted(pairs), np.int64).reshape(-1, 2)

    return _cells(cells, solve, False, "a long, b long")


def _blocks(rows: Column, elements: Column) -> Column:
    """Into how many blocks so many rows and set elements are cut."""
    return F.ceil(F.greatest(rows / BLOCK, elements * 8 / BLOCK_BYTES)).cast("long")


def _in_blocks(placed: DataFrame) -> DataFrame:
    """Cells of one block each; a node's block is another one in every bucket, so large groups mix."""
    own = F.pmod(F.xxhash64("node", "bkey"), _blocks(F.col("m"), F.col("words")))
    none = F.lit(-1).cast("long")
    return placed.withColumn("block", own).withColumns({"pure": none, "xp": none, "yp": none, "x": F.col("block"), "y": F.col("block")})


def _block_pairs(placed: DataFrame) -> DataFrame:
    """Cells of two blocks each. Components that fill blocks have blocks of their own, which never meet each other."""
    size = [F.sum("c").alias("c"), F.sum("words").alias("words")]
    parts = placed.groupBy("bkey", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("words"))
    fills = F.greatest(F.col("c") / BLOCK, F.col("words") * 8 / BLOCK_BYTES) >= 1
    parts = parts.withColumn("pure", F.when(fills, F.col("comp")).otherwise(-1)).groupBy("bkey", "pure").agg(*size)
    # One entry for each component that fills a block, so far fewer than a bucket has rows.
    kinds = parts.groupBy("bkey").agg(F.collect_list(F.struct("pure", _blocks(F.col("c"), F.col("words")).alias("blocks"))).alias("kinds"), F.sum("c").alias("rows"))
    known = lookup(placed, kinds, "bkey", "rows", "node")
    is_pure = F.exists("kinds", lambda k: k["pure"] == F.col("comp"))
    known = known.withColumn("pure", F.when(is_pure, F.col("comp")).otherwise(-1))
    blocks = F.filter("kinds", lambda k: k["pure"] == F.col("pure"))[0]["blocks"]
    known = known.withColumn("block", F.pmod(F.xxhash64("node", "bkey"), blocks))
    others = F.filter("kinds", lambda k: (k["pure"] == -1) | (k["pure"] != F.col("pure")))
    each = F.flatten(F.transform(others, lambda k: F.transform(F.sequence(F.lit(0).cast("long"), k["blocks"] - 1), lambda b: F.struct(k["pure"].alias("p"), b.alias("b")))))
    met = known.withColumn("with", F.explode(each)).withColumn("own", F.struct(F.col("pure").alias("p"), F.col("block").alias("b")))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    return met.withColumns({"xp": low["p"], "x": low["b"], "yp": high["p"], "y": high["b"]})


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``row, id, tag, n, component`` for every row; ``tag`` is the hash of id and text."""
    sig = materialise(signatures(docs, id_col, text_col))
    classes = materialise(sig.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    # One row of each class goes on; only those whose set may have copies need a look at their class.
    shared = classes.where("weight > 1").select(F.xxhash64("key").alias("kh"))
    bits = bitmap_bits(shared.count())
    keyed = sig.where("key is not null").withColumn("kh", F.xxhash64("key"))
    chosen = possible(classes.select(F.col("node").alias("row"), F.xxhash64("key").alias("kh")), shared, "kh", bits).select("row")
    nodes = possible(keyed, shared, "kh", bits, within=False).unionByName(possible(keyed, shared, "kh", bits).join(chosen, "row", "left_semi"))
    nodes = nodes.select(F.col("row").alias("node"), "tag", "key", "n", "coords")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substr("coords", b * ROWS + 1, F.lit(ROWS)), b))
    spread = nodes.select("node", "n", F.posexplode(band).alias("band", "bkey"))
    full = materialise(spread.groupBy("bkey").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("words")).where("m > 1"))
    rows = possible(spread, full, "bkey", bitmap_bits(full.count()))
    rows = materialise(lookup(rows, full, "bkey", "m", "node").where("m is not null").withColumn("band", F.col("band").cast("long")))
    named = rows.select("node").distinct()
    members = materialise(possible(nodes, named, "node", bitmap_bits(named.count())).join(named, "node", "left_semi"))
    content = materialise(full_sets(docs, members, id_col, text_col))

    comp = members.select("node", F.col("node").alias("comp"))
    by_id = links_of_repeated_ids(sig, classes)
    if by_id is not None:
        ends = by_id.select(F.col("a").alias("node")).union(by_id.select("b")).union(members.select("node")).distinct()
        comp = relabelled(ends.select("node", F.col("node").alias("comp")), by_id)
    several = _blocks(F.col("m"), F.col("words")) > 1
    rounds = [(F.col("band") < FIRST_BANDS, _in_blocks), (F.col("band") >= FIRST_BANDS, _in_blocks), (several, _block_pairs)]
    for turn, (part, cells) in enumerate(rounds):
        if not turn and by_id is None:
            placed = rows.where(part).withColumn("comp", F.col("node"))
        else:
            placed = materialise(rows.where(part).join(comp, "node"))
            spanning = placed.groupBy("bkey").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("w")).where("lo < hi").select("bkey", "w")
            spanning = materialise(spanning)
            if spanning.isEmpty():
                continue
            placed = lookup(placed, spanning, "bkey", "w", "node").where("w is not null")
        # Later rounds meet few links: sketches first, then the full sets of those rows that came near.
        found = cells(placed).drop("n")
        if turn:
            found = materialise(promising(found.join(members.select("node", "n", "coords"), "node"), percent))
            near = found.select("node").distinct()
            sets = possible(content, near, "node", bitmap_bits(near.count()))
        else:
            sets = content
        links = materialise(merges(found.join(sets, "node"), percent).distinct())
        if not links.isEmpty():
            comp = relabelled(comp, links)

    classes = materialise(with_smallest_id(classes, comp).select("key", "component", "weight"))
    rows = sig.select("row", "id", "tag", "n", "key")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return lookup(rows, classes, "key", "weight", "row").select("row", "id", "tag", "n", component.alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Components of documents linked by a shingle similarity of at least ``percent``.

    Returns ``id_col, n_shingles, component_id, kept``, one row per input row;
    ``component_id`` is the smallest id reachable and ``kept`` marks that row.

    Edge cases: NULL, empty and blank texts have no shingles and are their own
    component; fewer than five words are one shingle; rows with a NULL id link like
    any others, and have a NULL component if no id is reachable; rows that repeat an
    id are linked, whatever their texts; an empty table gives an empty result; other
    columns are not read.
    """
    return labelled(docs, id_col, text_col, percent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id.

    Edge cases: as for ``near_duplicates``; of rows that repeat the id that stays, the
    one with the least hash of its text does, and any one of those that repeat the text too;
    rows of a NULL id stay where no id is reachable; column names may clash with any
    used here; an empty table stays empty.
    """
    rows = materialise(labelled(docs, id_col, text_col, percent).select("id", "tag", F.col("id").eqNullSafe(F.col("component")).alias("kept")))
    again = materialise(rows.where("kept and id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("tag").alias("tag")).where("c > 1").select("id", "tag"))
    gone = rows.where("not kept").select("id", "tag").distinct()
    gone = materialise(gone.unionByName(rows.where("kept").join(again.select("id"), "id").select("id", "tag").distinct()))
    bits = bitmap_bits(gone.count())
    name, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    named = docs.select(as_row(docs), name.alias("_id"), F.xxhash64(name, text).alias("_tag"))
    tags = gone.select(F.col("tag").alias("_tag"))
    # Only rows that may go are moved.
    alone = possible(named, tags, "_tag", bits, within=False)
    maybe = possible(named, tags, "_tag", bits)
    stay = maybe.join(gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tag") == F.col("tag")), "left_anti")
    one = maybe.join(again, (F.col("_id") == F.col("id")) & (F.col("_tag") == F.col("tag"))).dropDuplicates(["_id"])
    return from_row(alone.select("_row").unionByName(stay.select("_row")).unionByName(one.select("_row")), docs)
