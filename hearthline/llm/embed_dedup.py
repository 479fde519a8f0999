"""Near-duplicate embeddings by cross-polytope hashing with multiprobe and exact verification.

A hash function rotates the normalised vector by three rounds of random signs and a
fast Hadamard transform, and takes the largest coordinate with its sign. A table's
key joins several functions. A vector is stored under its own key and also visits
the keys it came closest to; a pair is a candidate where one's own key is among the
other's visits. Buckets are cut into blocks of bounded size, block pairs are
multiplied in double precision, and each pair is counted in the first table that
shows it. A block pair returns one row per vector, never its pairs.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import arrow, bitmap_bits, grouped, lookup, materialise, possible
from hearthline.llm.components import connected_components, links_of_repeated_ids, with_smallest_id

#: Keys visited in a table, own key first, and rows of a block.
VISITS, BLOCK = 4, 2048
#: Tables for 1, 2, 3, ... functions a key, at which fewer than one pair in a thousand at cosine 0.95
#: was missed on random pairs of 64 dimensions.
TABLES = (6, 8, 12, 18, 30)


@functools.lru_cache(maxsize=16)
def _signs(dim: int, functions: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0]), (functions, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(x.shape)
        h *= 2
    return x / math.sqrt(n)


def visits(unit: np.ndarray, tables: int, width: int, seed: int = 11) -> np.ndarray:
    """Keys (n, tables, VISITS) of unit vectors; a table's keys are distinct from those of other tables."""
    n, d = unit.shape
    dim = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, dim))
    x[:, :d] = unit
    signs = _signs(dim, tables * width, seed)
    best = np.zeros((n, tables, width, 2), np.int64)
    loss = np.zeros((n, tables, width))
    for f in range(tables * width):
        y = x
        for r in range(3):
            y = hadamard(y * signs[f, r])
        size = np.abs(y)
        top = np.argpartition(-size, 1, axis=1)[:, :2]
        a, b = np.take_along_axis(size, top, 1).T
        top = np.where((a >= b)[:, None], top, top[:, ::-1])
        t, k = divmod(f, width)
        best[:, t, k] = 2 * top + (np.take_along_axis(y, top, 1) < 0)
        loss[:, t, k] = np.abs(a - b)
    # Visit the second choice of the functions in which it came closest.
    order = np.argsort(loss, axis=2, kind="stable")
    out = np.zeros((n, tables, VISITS), np.int64)
    rows, cols = np.arange(n)[:, None], np.arange(tables)[None, :]
    for v in range(VISITS):
        pick = np.zeros((n, tables, width), np.int64)
        # Visit v takes the second choice where v has a bit, among the two functions of least loss; one function has two visits.
        for bit in range(2):
            if v >> bit & 1 and bit < width:
                pick[rows, cols, order[:, :, bit]] = 1
        chosen = np.take_along_axis(best, pick[..., None], 3)[..., 0]
        key = np.broadcast_to(cols + 1, (n, tables)).astype(np.int64)
        for k in range(width):
            key = key * (2 * dim + 1) + chosen[:, :, k]
        out[:, :, v] = key
    return out


def _links(ids, unit, keys, own, bucket, left, right, least) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block pair that reach ``least`` and are shown here first, in parts of bounded size."""
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        i, j = np.nonzero(unit[part] @ unit[right].T >= least)
        i, j = part[i], right[j]
        ok = (own[i] | own[j]) & ((i < j) if left is right else True)
        i, j = i[ok], j[ok]
        lo, hi = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        open_, first = np.arange(len(lo)), np.zeros(len(lo), bool)
        for t in range(keys.shape[1]):
            if not len(open_):
                break
            kl, kh = keys[lo[open_], t], keys[hi[open_], t]
            # The pair's place in this table: the smaller id's own key if the other visits it, else the larger id's.
            at_lo, at_hi = (kh == kl[:, :1]).any(1), (kl == kh[:, :1]).any(1)
            place = np.where(at_lo, kl[:, 0], kh[:, 0])
            shown = at_lo | at_hi
            first[open_[shown & (place == bucket)]] = True
            open_ = open_[~shown]
        yield lo[first], hi[first]


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, seed: int = 11) -> DataFrame:
    """Links of cosine at least ``least`` and the components they make.

    Returns ``id_col, n_links, component_id, kept``, one row per input row;
    ``n_links`` counts the other rows linked directly.

    Edge cases: vectors that are NULL, empty or zero, or hold NULL or non-finite
    components link with nothing; vectors of different lengths do not link; equal
    vectors are one node whose copies link to each other; rows with a NULL id link
    and count like any others, and have a NULL component if no id is reachable; rows
    that repeat an id count their own links and share a component; an empty table
    gives an empty result; other columns are not read.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kept = [], []
            for v in batch.column(1):
                raw = v.as_py()
                x = np.array(raw, np.float64) if raw and None not in raw else np.zeros(0)
                ok = len(x) > 0 and np.isfinite(x).all() and (x != 0).any()
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if ok else None)
                kept.append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(kept, pa.binary())], names=["id", "key", "vec"])

    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = materialise(arrow(named, digest, "id long, key binary, vec binary").withColumn("row", F.monotonically_increasing_id()))
    # A class of equal vectors is one node, named by a row and not by an id, which may be NULL or repeated.
    classes = rows.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"))
    classes = materialise(classes)
    size, length = classes.agg(F.count(F.lit(1)), F.max(F.octet_length("vec"))).first()
    dim = max(2, 1 << max(1, ((length or 16) // 8 - 1).bit_length()))
    # So many functions that unrelated vectors seldom meet: keys grow with the number of vectors.
    width = min(len(TABLES), max(1, math.ceil(math.log(max(2, size)) / math.log(2 * dim))))
    tables = TABLES[width - 1]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raw = [np.frombuffer(v.as_py(), np.float64) for v in batch.column(2)]
                keys = np.zeros((len(raw), tables, VISITS), np.int64)
                for d in {len(x) for x in raw}:
                    of = [k for k, x in enumerate(raw) if len(x) == d]
                    unit = normal(np.stack([raw[k] for k in of]))
                    keys[of] = visits(unit, tables, width, seed) * 4096 + d % 4096
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=["node", "weight", "vec", "keys"])

    placed = materialise(arrow(classes.select("node", "weight", "vec"), hashed, "node long, weight long, vec binary, keys binary"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each distinct key visited; ``own`` where it is the vector's own."""
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, tables, VISITS)
                first = np.ones(keys.shape, bool)
                for v in range(1, VISITS):
                    first[:, :, v] = (keys[:, :, v : v + 1] != keys[:, :, :v]).all(2)
                row, _, visit = np.nonzero(first)
                yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array((visit == 0).astype(np.int64)), batch.column(0).take(pa.array(row))], names=["bucket", "own", "node"])

    # Nodes alone are sorted into buckets; vectors follow only where an own key meets another vector.
    entries = materialise(arrow(placed.select("node", "keys"), spread, "bucket long, own long, node long"))
    full = materialise(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("o")).where("n > 1 and o > 0").select("bucket", "n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    met = lookup(possible(entries, full, "bucket", bitmap_bits(full.count())), full, "bucket", "n", "node").where("n is not null")
    order = ["bucket", "a", "b"]
    cells = (
        met.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("node", "bucket", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "block", "own")
        .join(placed, "node")
        .select(*order, "block", "own", "node", "weight", "vec", "keys")
        .repartition(*order)
        .sortWithinPartitions(*order)
    )

    def solve(bucket: int, a: int, b: int, group: pa.Table) -> np.ndarray:
        block, own, ids, weight = (group.column(k).to_numpy() for k in range(3, 7))
        own = own.astype(bool)
        raw, keys = group.column(7).to_pylist(), np.frombuffer(b"".join(group.column(8).to_pylist()), np.int64).reshape(-1, tables, VISITS)
        long = max(map(len, raw)) // 8
        # Vectors of different lengths seldom share a bucket; they never link.
        sizes = np.array([len(v) // 8 for v in raw])
        links = []
        for d in np.unique(sizes):
            unit = np.zeros((len(raw), long))
            of = np.flatnonzero(sizes == d)
            unit[of, :d] = normal(np.stack([np.frombuffer(raw[k], np.float64) for k in of]))
            left = of[block[of] == a]
            right = left if a == b else of[block[of] == b]
            links += list(_links(ids, unit, keys, own, bucket, left, right, least))
        lo, hi = (np.concatenate([f[k] for f in links] or [np.zeros(0, int)]).astype(int) for k in (0, 1))
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, lo, weight[hi])
        np.add.at(count, hi, weight[lo])
        label = ids.copy()
        while len(lo):  # the smallest node reachable inside this cell
            old = label.copy()
            np.minimum.at(label, lo, old[hi])
            np.minimum.at(label, hi, old[lo])
            if (label == old).all():
                break
        linked = np.flatnonzero(count)
        return np.stack([ids[linked], count[linked], label[linked]], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], names=["node", "links", "label"])

        for here, parts in grouped(batches, 3):
            if sum(b - a for _, a, b in parts) > 1:
                out.append(solve(*here, pa.Table.from_batches([batch.slice(a, b - a) for batch, a, b in parts])))
                if len(out) > 2000 or len(out[-1]) > 1000:
                    yield flush()
        yield flush()

    links = materialise(arrow(cells, run, "node long, links long, label long").groupBy("node", "label").agg(F.sum("links").alias("links")))
    by_id = links_of_repeated_ids(rows, classes)
    edges = links.select(F.col("node").alias("a"), F.col("label").alias("b"))
    comp = connected_components(edges if by_id is None else edges.union(by_id))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = materialise(with_smallest_id(classes.select("key", "node", "rep", "weight"), comp).join(counted, "node", "left").drop("rep", "node"))
    named = lookup(rows.select("row", "id", "key"), known, "key", "weight", "row")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return named.select(
        F.col("id").alias(id_col),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def normal(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, scaled first by the largest component, so that no sum of squares overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
