"""Toxicity scores from gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled rows by log odds.
Each text becomes a short vector: lexicon densities, how near lexicon words stand
to second-person words, and rates of capitals, punctuation and obfuscation. Trees
are fitted on histogram bins of these, and an isotonic step function maps their sum
to a probability. Lexicon, trees and calibration are fitted on disjoint rows.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import arrow, as_row, from_row, materialise

#: Bounds of the fit: about so many labelled rows are sampled, and so many lexicon candidates and entries are held.
SAMPLE_ROWS, CANDIDATES, LEXICON = 24_000, 20_000, 3_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
_LONGEST_FIRST, _TRAILING = PREFIXES[::-1], ".,;:!?"
#: Tokens whose codes are remembered, and texts that are worked on together.
MEMORY, SLICE = 100_000, 256
# Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vuestro vuestra vos".split())
# Characters that commonly stand for letters.
LOOKALIKES = str.maketrans("013457@$!|+", "oieastasiit")
NEAR = 3
N_FEATURES = 20

_EDGE = re.compile(r"^\W+|\W+$")
_LONG = re.compile(r"(.)\1\1")
_MIXED = re.compile(r"[^\W\d_][\d@$!|*+.\-_]+[^\W\d_]")
_INNER = re.compile(r"[\W_]+")
#: Bytes of the marks whose runs are counted.
_MARKS = np.isin(np.arange(256), list(b"!?.*$#%&"))

# Bits of a token's code; the lexicon entry is above them.
PERSON, CAPS, OBFUSCATED, STRETCHED, VEILED, WHOLE, BITS = 1, 2, 4, 8, 16, 32, 6


def forms(token: str) -> list[str]:
    """What a token is looked up by: the bare lower-case word, then its beginnings."""
    word = _EDGE.sub("", token.lower())
    return [word, *[f"{word[:n]}-" for n in PREFIXES if len(word) > n]] if word else []


class Codes(dict):
    """Codes of tokens by a lexicon, worked out once for each token."""

    def __init__(self, entries: dict[str, int]):
        super().__init__()
        self.entries = entries

    def __missing__(self, token: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        # Nearly all tokens are letters with a mark or two after them, which need no pattern.
        core = token.rstrip(_TRAILING)
        plain_word = core.isalpha()
        word = core.lower() if plain_word else _EDGE.sub("", token.lower())
        code = 0
        if word:
            code |= PERSON * (word in SECOND_PERSON)
            code |= CAPS * (len(word) > 2 and token.isupper())
            mixed = not plain_word and _MIXED.search(token) is not None
            code |= OBFUSCATED * mixed
            code |= STRETCHED * (_LONG.search(word) is not None)
            entry = self.entries.get(word)
            if entry is not None:
                code |= WHOLE
            else:
                entry = next((e for n in _LONGEST_FIRST if len(word) > n and (e := self.entries.get(f"{word[:n]}-")) is not None), None)
            if entry is None and (mixed or code & STRETCHED):
                plain = _INNER.sub("", word.translate(LOOKALIKES))
                entry = self.entries.get(plain, self.entries.get(_LONG.sub(r"\1", plain)))
                code |= VEILED * (entry is not None)
            if entry is not None:
                code |= (entry + 1) << BITS
        self[token] = code
        return code


def features(texts: list[str], codes: Codes, weights: np.ndarray) -> np.ndarray:
    """The feature vectors of whole texts, one row each; empty texts give zeros.

    All texts are worked on as one run of words and one of bytes. Counts are differences
    of running sums; sums of weights are taken segment by segment, so that a text's row
    does not depend on its neighbours.
    """
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    code = np.fromiter(map(codes.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(n.sum()))
    ends = np.cumsum(n)
    starts = ends - n
    count = lambda x: (run := np.concatenate([[0], np.cumsum(x)]))[ends] - run[starts]
    d = np.maximum(n, 1)
    entry = (code >> BITS) - 1
    at = np.flatnonzero(entry >= 0)
    hits = count(entry >= 0)
    if len(at):
        of = np.repeat(np.arange(len(texts)), n)[at]
        rows = np.unique(of)
        first = np.searchsorted(of, rows)
        w, whole = weights[entry[at]].astype(np.float64), (code[at] & WHOLE) > 0
        total = np.zeros(len(texts))
        total[rows] = np.add.reduceat(w, first)
        out[:, 0], out[:, 1] = hits / d, total / d
        out[rows, 2] = np.maximum.reduceat(w, first)
        out[:, 3] = np.bincount(np.unique(of * np.int64(len(weights)) + entry[at]) // len(weights), minlength=len(texts))
        out[:, 7] = np.bincount(of, whole, len(texts))
        out[:, 4] = out[:, 7] / d
        out[rows, 5] = np.maximum.reduceat(np.where(whole, w, 0.0), first)
        out[:, 6] = np.log1p(total)
        out[:, 8] = np.bincount(of, (code[at] & VEILED) > 0, len(texts)) / d
        person = np.concatenate([[0], np.cumsum(code & PERSON)])
        near = person[np.minimum(at + NEAR + 1, ends[of])] > person[np.maximum(at - NEAR, starts[of])]
        out[:, 9] = np.bincount(of, near, len(texts)) / np.maximum(hits, 1)
        out[:, 10] = hits / np.maximum(1.0, np.sqrt(n))
    for k, bit in enumerate((PERSON, CAPS, OBFUSCATED, STRETCHED)):
        out[:, 11 + k] = count((code & bit) > 0) / d
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\0".join([b"", *raw, b""]), np.uint8)  # a separator before and after each text
    size = np.array([len(r) for r in raw], np.int64)
    starts = 1 + np.cumsum(size + 1) - (size + 1)
    ends = starts + size
    upper, lower = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
    out[:, 15] = upper / np.maximum(1, upper + lower)
    out[:, 16], out[:, 17] = count(data == 33) / d, count(data == 63) / d
    mark = _MARKS[data]
    runs = np.zeros(len(data), bool)
    runs[1:-1] = mark[1:-1] & mark[2:] & ~mark[:-2]
    out[:, 18] = count(runs) / d
    out[:, 19] = np.log1p(n)
    out[n == 0] = 0
    return out


@dataclass
class Trees:
    """Depth-limited trees on histogram bins; logistic loss."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    shrink: float = 1.0
    cuts: list[np.ndarray] = field(default_factory=list)
    prior: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 48))) for j in range(x.shape[1])]
        b, width = self.bins(x), 64
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            inner = (1 << self.depth) - 1
            split, cut = np.full(inner, -1), np.zeros(inner, int)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                best = np.full(many, 1e-6)
                at = node - first
                for j in range(x.shape[1]):
                    slot = at * width + b[:, j]
                    gs = np.cumsum(np.bincount(slot, g, many * width).reshape(many, width), 1)
                    hs = np.cumsum(np.bincount(slot, h, many * width).reshape(many, width), 1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.shrink) + (gt - gs) ** 2 / (ht - hs + self.shrink) - gt**2 / (ht + self.shrink)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(many), k]
                    up = top > best
                    best[up] = top[up]
                    split[first + np.flatnonzero(up)] = j
                    cut[first + np.flatnonzero(up)] = k[up]
                node = self._step(node, b, split, cut)
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value = self.rate * gs / (hs + self.shrink)
            self.trees.append((split, cut, value))
            raw += value[leaf]
        return self

    @staticmethod
    def _step(node: np.ndarray, b: np.ndarray, split: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """A node without a split sends all rows left."""
        j = split[node]
        return 2 * node + 1 + ((j >= 0) & (b[np.arange(len(b)), np.maximum(j, 0)] > cut[node]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(x):
            return out
        b = self.bins(x)
        for split, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = self._step(node, b, split, cut)
            out += value[node - len(split)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots of a non-decreasing function of ``raw``; tied values are one block."""
    at, inverse = np.unique(raw, return_inverse=True)
    n, s = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []
    for a, m, t in zip(at, n, s, strict=True):
        blocks.append([a, a, m, t])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            _, hi, m2, t2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + m2, blocks[-1][3] + t2]
    # A block's rate is drawn a little to one half, so that no score is exactly 0 or 1.
    xs = [v for b in blocks for v in (b[0], b[1])]
    ys = [(b[3] + 0.01) / (b[2] + 0.02) for b in blocks for _ in range(2)]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


@dataclass
class Model:
    entries: dict[str, int]
    weights: np.ndarray
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees.trees:
            return np.full(len(x), self.knots[1][0])
        raw = self.trees.raw(x)
        # The small second part keeps the trees' order inside a block.
        return np.clip(0.998 * np.interp(raw, *self.knots) + 0.002 / (1 + np.exp(-raw)), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


FOLDS = 4


def _tokens(sample: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """Rows ``token, fold, n``: texts of each fold that hold a token (one of ``only``, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for t, fold in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                names = {n for w in set(t.as_py().split()) for n in forms(w)}
                seen.update((n, fold) for n in (names if only is None else names & only))
        keys = list(seen)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.int32()), pa.array([seen[k] for k in part], pa.int64())], names=["token", "fold", "n"])

    return arrow(sample.select("text", "fold"), run, "token string, fold int, n long").groupBy("token", "fold").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    entries: dict[str, int]
    weights: np.ndarray

    @classmethod
    def of(cls, ones: dict[str, float], zeros: dict[str, float], n1: float, n0: float) -> Lexicon:
        """The tokens with the highest lower bounds of their log odds."""
        odds = {}
        for t, k in ones.items():
            if k >= max(3, n1 // 200):
                z = zeros.get(t, 0)
                odds[t] = np.log((k + 0.5) / (n1 + 1)) - np.log((z + 0.5) / (n0 + 1)) - np.sqrt(1 / (k + 0.5) + 1 / (z + 0.5))
        best = sorted((t for t in odds if odds[t] > 1), key=lambda t: (-odds[t], t))[:LEXICON]
        return cls({t: i for i, t in enumerate(best)}, np.array([odds[t] for t in best] or [0.0], np.float32))


def _vectors(sample: DataFrame, lexicons: list[Lexicon]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, labels and part of the fitting sample, whose size is bounded; each row by its own fold's lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [Codes(x.entries) for x in lexicons]
        for batch in batches:
            folds = batch.column(1).to_pylist()
            texts, x = batch.column(0).to_pylist(), np.zeros((batch.num_rows, N_FEATURES), np.float32)
            for f in set(folds):
                rows = [i for i, g in enumerate(folds) if g == f]
                x[rows] = features([texts[i] for i in rows], codes[f], lexicons[f].weights)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2), batch.column(3)], names=["x", "toxic", "part"])

    got = arrow(sample.select("text", "fold", "toxic", "part"), run, "x binary, toxic int, part int").toArrow()
    order = sorted(zip(*[got.column(i).to_pylist() for i in range(3)], strict=True))  # the same whatever the partitions
    x = np.frombuffer(b"".join(r[0] for r in order), np.float32).reshape(-1, N_FEATURES)
    return x, np.array([r[1] for r in order], float), np.array([r[2] for r in order], int)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows that are not held out, about ``sample_rows`` of them chosen by a hash of the id.

    The trees see each row through a lexicon learned without the row's fold; the
    calibration uses rows that the trees have not seen. Rows with a NULL label or id
    are not used. Without rows of both labels the model gives every text the same
    score, the share of toxic labels (0 without any).
    """
    known = labels.select(F.col(f"`{id_col}`").alias("lid"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("lid is not null and toxic in (0, 1)").where(~held_out(F.col("lid")))
    known = known.groupBy("lid").agg(F.max("toxic").alias("toxic"))
    share = F.pmod(F.xxhash64("lid", F.lit(5)), F.lit(1_000_000))
    chosen = known.where(share < int(1_000_000 * min(1.0, sample_rows / max(1, known.count()))))
    h = F.xxhash64("id", F.lit(6))
    sample = materialise(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), F.col("id") == F.col("lid"))  # about sample_rows small rows
        .select("text", "toxic", F.pmod(h, F.lit(FOLDS)).cast("int").alias("fold"), (F.pmod(F.shiftright(h, 20), F.lit(5)) == 0).cast("int").alias("part"))
    )
    size = {(r["toxic"], r["fold"]): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = ([size.get((k, f), 0) for f in range(FOLDS)] for k in (1, 0))
    toxic = materialise(_tokens(sample.where("toxic = 1"), None))
    top = toxic.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, sum(n1) // 200)).orderBy(F.desc("n"), "token").limit(CANDIDATES)
    names = frozenset(r["token"] for r in top.collect())

    def table_of(rows: DataFrame) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for r in rows.collect():
            out.setdefault(r["token"], [0] * FOLDS)[r["fold"]] = r["n"]
        return out

    ones = table_of(toxic.join(F.broadcast(top.select("token")), "token", "left_semi"))
    zeros = table_of(_tokens(sample.where("toxic = 0"), names))
    apart = lambda counts, f: {t: sum(c) - c[f] for t, c in counts.items()}
    folds = [Lexicon.of(apart(ones, f), apart(zeros, f), sum(n1) - n1[f], sum(n0) - n0[f]) for f in range(FOLDS)]
    whole = Lexicon.of({t: sum(c) for t, c in ones.items()}, {t: sum(c) for t, c in zeros.items()}, sum(n1), sum(n0))
    x, y, part = _vectors(sample, folds)
    if len(set(y)) < 2:
        rate = float(y.mean()) if len(y) else 0.0
        return Model(whole.entries, whole.weights, Trees(cuts=[np.zeros(0)] * N_FEATURES), (np.array([-1.0, 1.0]), np.array([rate, rate])))
    on, off = part == 0, part == 1
    if len(set(y[on])) < 2 or len(set(y[off])) < 2:  # too few for separate parts
        on = off = part >= 0
    trees = Trees().fit(x[on], y[on])
    return Model(whole.entries, whole.weights, trees, isotonic(trees.raw(x[off]), y[off]))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the calibrated probability that each whole text is toxic.

    Edge cases: NULL text counts as empty, and empty texts get the score of a vector
    of zeros; texts of any length are read whole; equal texts get equal scores; an
    input column named ``score_col`` is replaced; an empty table gives an empty result.
    """
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c != score_col])
    at = kept.columns.index(text_col)
    return _scored(kept, model, lambda batch: batch.column(at), score_col)


def _scored(rows: DataFrame, model: Model, texts_of: Callable[[pa.RecordBatch], pa.Array], score_col: str) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(model.entries)
        for batch in batches:
            texts = texts_of(batch)
            parts = [features([t or "" for t in texts.slice(at, SLICE).to_pylist()], codes, model.weights) for at in range(0, batch.num_rows, SLICE)]
            s = model.score(np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, score_col])

    return arrow(rows, run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with their columns.

    Edge cases: as for ``score``; NULL and empty texts are judged by their score too;
    repeated rows share their fate; without labels, or with one label only, every score
    is the share of toxic labels, so all rows stay or all go; a table of labels with
    other columns may clash with any name; column names may clash with any used here.
    """
    model, at = fit(docs, labels, id_col, text_col), docs.columns.index(text_col)
    carried = _scored(docs.select(as_row(docs)), model, lambda batch: pa.compute.struct_field(batch.column(0), [at]), "score")
    return from_row(carried.where(F.col("score") < threshold), docs)
