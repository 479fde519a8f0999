"""Secrets in texts, found through a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams that every
match must contain. Documents are indexed in segments: a segment's postings map
every trigram that a rule asks for to a bitmap of its documents. The queries
intersect and unite bitmaps, and only the documents left over are matched against
the expression itself. A rule without a mandatory trigram scans all documents.
Segments are independent, so the texts are read once and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import arrow
from hearthline.llm.trigrams import trigram_query, trigrams_of

#: A segment has at most so many bytes of text (or one document).
SEGMENT_BYTES = 4_000_000


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters; matches that fail are dropped after matching."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    base: bool = False


# The base rules' patterns.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 0, 32, True),
)
# Published formats of further credentials.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]{20,}"),
    Rule("basic_url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", re.A),
)
RULES = BASE_RULES + MORE_RULES


class Segment:
    """Postings of the wanted trigrams over some documents (bytes with A-Z lower-cased)."""

    def __init__(self, texts: list[bytes], wanted: dict[str, int]):
        self.n = len(texts)
        self.wanted = wanted
        data = np.frombuffer(b"\0\0\0".join(texts).lower() + b"\0\0\0", np.uint8)
        table = _table(tuple(wanted))
        # Two steps keep the work on whole texts small: the first two bytes rule out most positions.
        first = table.pairs[(data[:-2].astype(np.uint16) << 8) | data[1:-1]]
        at = np.flatnonzero(first)
        code = (data[at].astype(np.int64) << 16) | (data[at + 1].astype(np.int64) << 8) | data[at + 2]
        slot = np.searchsorted(table.codes, code)
        hit = table.codes[np.minimum(slot, len(table.codes) - 1)] == code
        at, slot = at[hit], slot[hit]
        ends = np.cumsum([len(t) + 3 for t in texts])
        doc = np.searchsorted(ends, at, side="right")
        self.postings = np.zeros((len(wanted), self.n), bool)
        self.postings[table.order[slot], doc] = True

    def ask(self, query) -> np.ndarray:
        if query is None:
            return np.ones(self.n, bool)
        if isinstance(query, str):
            return self.postings[self.wanted[query]]
        rows = [self.ask(q) for q in query[1]]
        return np.logical_and.reduce(rows) if query[0] == "and" else np.logical_or.reduce(rows)


class _Table:
    def __init__(self, wanted: tuple[str, ...]):
        codes = np.array([int.from_bytes(w.encode("latin-1"), "big") for w in wanted], np.int64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.pairs = np.zeros(1 << 16, bool)
        self.pairs[codes >> 8] = True


_tables: dict[tuple[str, ...], _Table] = {}


def _table(wanted: tuple[str, ...]) -> _Table:
    if wanted not in _tables:
        _tables[wanted] = _Table(wanted)
    return _tables[wanted]


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _compiled(rule: Rule) -> re.Pattern:
    if rule.pattern == r"[0-9a-f]+":  # a run is matched whole, so short runs need not be made into matches
        return re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % max(1, rule.least))
    return re.compile(rule.pattern, rule.flags)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All spans of all rules: ``id_col, spans`` with ``spans`` an array of ``kind, start, end, base``.

    Positions are code points, ends exclusive, of whole matches; spans are ordered
    by start, then in the order of the rules. Matches of one rule do not overlap,
    those of different rules may.

    Edge cases: NULL and empty texts have no spans; a NULL id is passed on; repeated
    rows are scanned alike; a text longer than a segment is a segment of its own; an
    empty table gives an empty result; other columns are not read.
    """
    asked = [(r, trigram_query(r.pattern, r.flags)) for r in rules]
    names = sorted(set().union(*[trigrams_of(q) for _, q in asked]))
    if not all(n.isascii() for n in names):
        raise ValueError("rules must be ASCII")
    wanted = {w: i for i, w in enumerate(names)}

    def segment(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        index = Segment(texts, wanted) if wanted else None
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        decoded: dict[int, str] = {}
        for k, (rule, query) in enumerate(asked):
            compiled = _compiled(rule)
            for i in np.flatnonzero(index.ask(query)) if index else range(len(texts)):
                text = decoded.get(i)
                if text is None:
                    text = decoded[i] = texts[i].decode("utf-8", "replace")
                found[i] += [(a, k, b) for a, b in matches(rule, compiled, text)]
        flat = [(rules[k].kind, a, b, rules[k].base) for f in found for a, k, b in sorted(f)]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        kinds, starts, ends, base = (list(x) for x in zip(*flat, strict=True)) if flat else ([], [], [], [])
        structs = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(base, pa.bool_())], names=["kind", "start", "end", "base"])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), structs)], names=["id", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            texts, at, total = [], 0, 0
            for i in range(batch.num_rows):
                t = column[i].as_py() or b""
                if texts and total + len(t) > SEGMENT_BYTES:
                    yield segment(ids.slice(at, i - at), texts)
                    texts, at, total = [], i, 0
                texts.append(t)
                total += len(t)
            if texts:
                yield segment(ids.slice(at), texts)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    spans = arrow(rows, run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    return spans.withColumnRenamed("id", id_col)


def span_text(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, a hash of the base spans and all spans as text.

    Rows without spans have counts of 0, the hash of the empty text and the empty text;
    an empty table gives an empty result.
    """
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
