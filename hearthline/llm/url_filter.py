"""URL verdicts from rules, and from naive Bayes over segmented host and path tokens.

Concatenated names are split by the most probable sequence of words under a unigram
model (Viterbi). The unigram scores follow Zipf's law over the ranks of the
whole-word entries of a public vocabulary file, which has a fixed size.

Pages carry no labels, so naive Bayes is fitted in two steps that keep labels apart
from evidence. First, pages whose tokens hold a seed word are the blocked examples,
and the model is fitted to their other tokens only, the seeds masked. Then this model
weighs every page by those other tokens, and the final counts, seeds included, are
taken with its probabilities. A seed counts for as much as the company it keeps: one
that stands among harmless tokens loses its weight, and tokens that go with blocked
pages gain it. Tokens are hashed to a fixed number of slots, so the model has the
same size for any crawl.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import arrow

DEFAULT_VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Far more than the words of the vocabulary, so that few tokens share a slot.
SLOTS = 1 << 18
LONGEST = 24
MEMORY = 100_000
# Seed words of the blocked class.
SEEDS = frozenset("spam viagra cialis pills pharmacy casino poker gambling betting porn xxx adult escort sexy payday loans jackpot replica warez torrent crack keygen malware phishing scam".split())
#: Tokens of a typical page mix that each class is given beforehand, and the unit in which a page's probability is counted.
PRIOR_TOKENS, UNIT = 200.0, 1000
#: Log odds above which a page is blocked.
CUT = 0.0


@dataclass(frozen=True)
class Rule:
    """Holds for a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: ASCII lower-cased host after ``://``; both empty for NULL or without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, after


def rule_columns(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else NULL; ties go to the earlier rule."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


@functools.lru_cache(maxsize=4)
def load_words(path: str = DEFAULT_VOCABULARY) -> dict[str, float]:
    """Log scores of the whole words of a vocabulary file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if w.endswith("</w>")]
    words = [w for w in words if w.isalpha() and w.isascii() and (len(w) > 1 or w in "ai")]
    words += sorted(SEEDS - set(words))
    total = math.log(sum(1 / (r + 2.7) for r in range(len(words))))
    return {w: -math.log(r + 2.7) - total for r, w in enumerate(words)}


class Segmenter:
    def __init__(self, words: dict[str, float]):
        self.words = words
        self.unknown = min(words.values(), default=-10.0)
        self.memory: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        """The best words of a run of letters; an unknown stretch costs more by each letter."""
        got = self.memory.get(name)
        if got is not None:
            return got
        best, back = [0.0], [0]
        for e in range(1, len(name) + 1):
            top, at = -math.inf, e - 1
            for s in range(max(0, e - LONGEST), e):
                p = self.words.get(name[s:e])
                x = best[s] + (p if p is not None else self.unknown - 2.5 * (e - s))
                if x > top:
                    top, at = x, s
            best.append(top)
            back.append(at)
        out, e = [], len(name)
        while e:
            out.append(name[back[e] : e])
            e = back[e]
        if len(self.memory) > MEMORY:
            self.memory.clear()
        self.memory[name] = out[::-1]
        return out[::-1]

    def words_of(self, part: str) -> list[str]:
        """Segmented words of ASCII letters, other letters run by run, and digits by their number."""
        out = []
        for run in _RUNS.findall(part.lower()):
            if run.isascii() and run.isalpha():
                out += self.split(run)
            else:
                out.append(f"#{min(len(run), 9)}" if run.isdigit() else run)
        return out

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host (``h:``) and of the path (``p:``), the ending (``t:``) and the number of hyphens (``n:``)."""
        labels = host.split(".")
        out = [f"h:{w}" for label in labels[:-1] or labels for w in self.words_of(label)]
        out += [f"t:{labels[-1]}", f"n:{min(host.count('-'), 4)}"]
        return out + [f"p:{w}" for w in self.words_of(unquote(path, errors="replace"))]


_RUNS = re.compile(r"[^\W\d_]+|[0-9]+")


def is_seed(token: str) -> bool:
    return token[2:] in SEEDS


def slot(token: str) -> int:
    return zlib.crc32(token.encode()) % SLOTS


def _split_pages(pages: DataFrame, id_col: str, url_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    host, path = split_url(F.col(f"`{url_col}`"))
    parts = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return parts.withColumn("rule", name).withColumn("ruled", verdict)


@dataclass(frozen=True)
class Model:
    """Log likelihood ratios of the slots, and the prior log odds."""

    ratio: np.ndarray
    prior: float

    def odds(self, tokens: list[str]) -> float:
        return self.prior + float(self.ratio[[slot(t) for t in tokens]].sum())

    def chance(self, tokens: list[str]) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.odds(tokens)))))


def model_of(counts: np.ndarray, pages: np.ndarray) -> Model:
    """From counts (allowed, blocked) by slot and by page; a class without evidence is like the whole, so slots stay neutral."""
    whole = counts.sum(0)
    given = PRIOR_TOKENS * whole / max(1e-9, float(whole.sum()))
    used = whole > 0
    like = np.log(np.where(used, counts + given, 1.0)) - np.log(counts.sum(1, keepdims=True) + PRIOR_TOKENS)
    return Model(np.where(used, like[1] - like[0], 0.0), float(np.log((pages[1] + 0.5) / (pages[0] + 0.5))))


def _counts(parts: DataFrame, words: dict[str, float], blocked: Callable[[list[str]], float], masked: bool) -> Model:
    """A model of all pages, each counted for both classes by its chance of being ``blocked``; every occurrence of a token counts.

    What comes back has at most two numbers per slot, summed in integers so that reruns agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(words)
        counts, pages = np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = seg.tokens(host, path)
                one = round(UNIT * blocked(tokens))
                at = [slot(t) for t in tokens if not (masked and is_seed(t))]
                for c, n in ((0, UNIT - one), (1, one)):
                    pages[c] += n
                    if n:
                        np.add.at(counts[c], at, n)
        c, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(counts[c, k])], names=["c", "k", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([-1, -1], pa.int32()), pa.array(pages)], names=["c", "k", "n"])

    sums = arrow(parts.where("host <> ''").select("host", "path"), run, "c int, k int, n long").groupBy("c", "k").agg(F.sum("n").alias("n")).toArrow()
    c, k, n = (sums.column(i).to_numpy() for i in range(3))
    counts, pages = np.zeros((2, SLOTS)), np.zeros(2)
    counts[c[k >= 0], k[k >= 0]] = n[k >= 0] / UNIT
    pages[c[k < 0]] = n[k < 0] / UNIT
    return model_of(counts, pages)


def fit(parts: DataFrame, words: dict[str, float]) -> Model:
    """The model over all pages: labels by seeds and evidence without them first, then all tokens by that evidence."""
    masked = _counts(parts, words, lambda tokens: float(any(map(is_seed, tokens))), masked=True)
    return _counts(parts, words, lambda tokens: masked.chance([t for t in tokens if not is_seed(t)]), masked=False)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """A verdict for every url: ``id_col, host, path, rule, verdict, score``.

    The longest rule that fits decides; without one, a page is blocked when its log
    odds by naive Bayes are above zero. ``score`` holds the log odds of every page.

    Edge cases: a NULL or empty url, or one without ``://``, has empty host and path,
    fits no rule with a host and is allowed with score 0; repeated rows are judged
    alike; long urls are read whole; pages without any seed word leave all allowed
    that no rule blocks; an empty table gives an empty result; other columns are not
    read.
    """
    words = load_words(vocabulary)
    parts = _split_pages(pages, id_col, url_col, rules)
    model = fit(parts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(words)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            odds = [model.odds(seg.tokens(h, p)) if h else 0.0 for h, p in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64())], names=[*batch.schema.names, "score"])

    kind = pages.schema[id_col].dataType.simpleString()
    scored = arrow(parts, run, f"id {kind}, host string, path string, rule string, ruled string, score double")
    verdict = F.coalesce("ruled", F.when(F.col("score") > CUT, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
