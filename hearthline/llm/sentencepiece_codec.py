"""SentencePiece unigram encoding and decoding over a double-array trie.

The vocabulary file gives pieces in rank order; a piece of rank ``r`` has the log
score ``-log(r + ZIPF_SHIFT)`` less a common constant (Zipf's law), since the
public file holds ranks rather than probabilities. Encoding takes the path of the
highest score through all pieces of the text (Viterbi). No piece holds a white
space marker after another character, so the text is cut before each run of
markers without changing the best path, and each distinct chunk is solved once.
Short chunks of a batch are solved together: every step of the search is one
NumPy operation over all of them.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hearthline.llm.common import arrow

MARK = "▁"
ZIPF_SHIFT = 2.7
#: Longer chunks (in bytes) are solved one at a time.
VECTOR_BYTES = 64
#: Distinct chunks a worker remembers before it starts afresh, and characters per slice: both bound memory only.
MEMORY, SLICE_CHARS = 150_000, 1_500_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class DoubleArray:
    """A byte trie in two arrays: the child of ``s`` by byte ``c`` is ``t = base[s] + c + 1`` where ``check[t] == s``."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, v in words.items():
            node = 0
            for c in word:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = v
        size = 2 * len(children) + 1024
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        taken, free, roomy, top = bytearray(size), 257, 257, 257  # below 257 only some bytes could use a slot
        taken[0] = 1
        todo = [(0, 0)]
        while todo:
            node, slot = todo.pop()
            self.value[slot] = value[node]
            kids = sorted(children[node])
            if not kids:
                continue
            while taken[free]:
                free += 1
            # Only children fill the holes; families start where holes have not yet been tried in vain.
            at = begun = max(free if len(kids) == 1 else roomy, kids[0] + 1)
            while any(taken[at + c - kids[0]] for c in kids):
                at += 1
                if at + 600 > len(taken):
                    taken += bytearray(len(taken))
            if at - begun > 64:
                roomy = max(roomy, at - 64)
            base = at - kids[0] - 1
            self.base[slot] = base
            if len(taken) > len(self.base):
                more = len(taken) - len(self.base)
                self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
                self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
                self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])
            for c in kids:
                t = base + c + 1
                taken[t] = 1
                self.check[t] = slot
                todo.append((children[node][c], t))
            top = max(top, base + kids[-1] + 1)
            if top + 600 > len(taken):
                taken += bytearray(len(taken))
        end = top + 258  # so that a step by any byte stays inside
        if end > len(self.base):
            more = end - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
            self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])
        self.base, self.check, self.value = self.base[:end].copy(), self.check[:end].copy(), self.value[:end].copy()


class Codec:
    """Encoder and decoder of one vocabulary; small enough (a few MB) to go with the task."""

    def __init__(self, pieces: list[tuple[str, float, str]], dummy_prefix: bool = True):
        """``pieces``: text, score as stored, and kind (``normal``, ``byte``, ``control``, ``unknown``), by id."""
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal"]
        ranked = sorted(normal, key=lambda x: (-x[2], x[0]))
        raw = {i: -math.log(r + ZIPF_SHIFT) for r, (i, _, _) in enumerate(ranked)}
        level = math.log(sum(math.exp(x) for x in raw.values())) if raw else 0.0
        self.score = np.zeros(len(pieces), np.float32)
        for i, x in raw.items():
            self.score[i] = x - level
        self.unknown_score = np.float32((min(self.score[i] for i in raw) if raw else 0.0) - 10)
        if any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("a piece holds a white space marker after another character")
        # A blank stands for the marker, so that a marker in the text itself stays apart and falls back to bytes.
        self.trie = DoubleArray({p.replace(MARK, " ").encode(): i for i, p, _ in normal})
        self.byte_id = np.full(256, -1, np.int32)
        surface: list[bytes] = [b""] * len(pieces)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_id[int(p[3:5], 16)] = i
                surface[i] = bytes([int(p[3:5], 16)])
            elif kind == "normal":
                surface[i] = p.replace(MARK, " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        self.length = np.array([len(x) for x in surface], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(surface) or b"\0", np.uint8)
        self.dummy_prefix = dummy_prefix
        # A line feed within no piece ends a chunk, too.
        feed = any("\n" in p for _, p, _ in normal)
        self.pattern = r" *[^ ]+| +" if feed else r"\n| *[^ \n]+| +"

    # -- encoding ---------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return re.findall(self.pattern, " " + text if self.dummy_prefix else text)

    def solve_one(self, chunk: str) -> list[int]:
        data = chunk.encode("utf-8", "surrogatepass")
        n, base, check, value = len(data), self.trie.base, self.trie.check, self.trie.value
        best = np.full(n + 1, -np.inf, np.float32)
        best[0] = 0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        s = 0
        while s < n:
            wide = 1 if data[s] < 0x80 else 2 if data[s] < 0xE0 else 3 if data[s] < 0xF0 else 4
            here, node, single = best[s], 0, False
            for e in range(s, n):
                t = int(base[node]) + data[e] + 1
                if check[t] != node:
                    break
                node = t
                if (v := int(value[t])) >= 0:
                    single |= e + 1 - s == wide
                    if (x := here + self.score[v]) > best[e + 1]:
                        best[e + 1], back[e + 1] = x, (s, v)
            if not single and (x := here + self.unknown_score) > best[s + wide]:
                best[s + wide], back[s + wide] = x, (s, -1)
            s += wide
        out: list[int] = []
        while n > 0:
            s, v = back[n]
            out += [v] if v >= 0 else [int(self.byte_id[b]) for b in reversed(data[s:n])]
            n = s
        return out[::-1]

    def solve_many(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of short chunks: all ids in turn, and how many each chunk has."""
        n, lens = len(data), np.array([len(x) for x in data], np.int64)
        wide = int(lens.max())
        grid = np.zeros((n, wide + 4), np.uint8)
        grid[np.arange(wide + 4)[None, :] < lens[:, None]] = np.frombuffer(b"".join(data), np.uint8)
        best = np.full((n, wide + 5), -np.inf, np.float32)
        best[:, 0] = 0
        came = np.zeros((n, wide + 5), np.int32)
        piece = np.full((n, wide + 5), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(wide):
            lead = grid[:, s]
            rows = np.flatnonzero((s < lens) & ((lead & 0xC0) != 0x80))
            if not len(rows):
                continue
            first = lead[rows]
            size = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            single = np.zeros(len(rows), bool)
            live, node = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for e in range(s, wide):
                r = rows[live]
                t = base[node] + grid[r, e] + 1
                ok = (check[t] == node) & (e < lens[r])
                live, node = live[ok], t[ok]
                if not len(live):
                    break
                v = value[node]
                if len(hit := np.flatnonzero(v >= 0)):
                    at, ids = live[hit], v[hit]
                    single[at] |= size[at] == e + 1 - s
                    r = rows[at]
                    x = best[r, s] + self.score[ids]
                    up = x > best[r, e + 1]
                    r, x, ids = r[up], x[up], ids[up]
                    best[r, e + 1], came[r, e + 1], piece[r, e + 1] = x, s, ids
            if len(lone := np.flatnonzero(~single)):
                r, end = rows[lone], s + size[lone]
                x = best[r, s] + self.unknown_score
                up = x > best[r, end]
                r, end = r[up], end[up]
                best[r, end], came[r, end], piece[r, end] = x[up], s, -1
        out = np.zeros((n, wide), np.int32)
        put, end, rows = np.full(n, wide, np.int64), lens.copy(), np.arange(n)
        while len(rows := rows[end[rows] > 0]):
            e = end[rows]
            s, v = came[rows, e], piece[rows, e]
            known = v >= 0
            put[rows[known]] -= 1
            out[rows[known], put[rows[known]]] = v[known]
            if not known.all():
                lost, le, ls = rows[~known], e[~known], s[~known]
                for j in range(4):
                    if not len(go := np.flatnonzero(le - j > ls)):
                        break
                    put[lost[go]] -= 1
                    out[lost[go], put[lost[go]]] = self.byte_id[grid[lost[go], le[go] - 1 - j]]
            end[rows] = s
        return out[np.arange(wide)[None, :] >= put[:, None]], wide - put

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.solve_one(c)]

    # -- decoding ---------------------------------------------------------

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id lists ``ids[offsets[k]:offsets[k + 1]]``; ids outside the vocabulary are an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length)):
            raise ValueError("id outside the vocabulary")
        lens = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        raw = self.flat[np.repeat(self.start[ids] - ends[:-1], lens) + np.arange(ends[-1])].tobytes()
        out = []
        for a, b in zip(ends[offsets[:-1]], ends[offsets[1:]], strict=True):
            if self.dummy_prefix and raw[a : a + 1] == b" ":
                a += 1
            out.append(raw[a:b].decode("utf-8", "replace"))
        return out


class Memo:
    """Solved chunks of one worker, kept as one flat id array."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, chunks: list[str]) -> None:
        data = [c.encode("utf-8", "surrogatepass") for c in chunks]
        order = sorted(range(len(data)), key=lambda i: len(data[i]))
        known, at = len(self.index), 0
        sizes, flats = [], []
        while at < len(order):
            most = len(data[order[at]])
            if most > VECTOR_BYTES:
                ids = self.codec.solve_one(chunks[order[at]])
                flats.append(np.array(ids, np.int32))
                sizes.append([len(ids)])
                at += 1
                continue
            upto = at
            while upto < len(order) and upto - at < 20_000 and len(data[order[upto]]) <= min(most + 2, VECTOR_BYTES):
                upto += 1
            ids, n = self.codec.solve_many([data[i] for i in order[at:upto]])
            flats.append(ids)
            sizes.append(n)
            at = upto
        size = np.concatenate(sizes).astype(np.int64)
        start = len(self.ids) + np.cumsum(size) - size
        self.index.update({chunks[i]: known + k for k, i in enumerate(order)})
        self.start = np.concatenate([self.start, start])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *flats])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and the offsets of each text in them."""
        parts = [self.codec.chunks(t) for t in texts]
        flat = [c for p in parts for c in p]
        if len(self.index) > MEMORY:
            self.clear()
        if new := [c for c in dict.fromkeys(flat) if c not in self.index]:
            self.learn(new)
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        counts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return ids, ends[counts]


@functools.lru_cache(maxsize=4)
def load_codec(path: str = DEFAULT_MODEL) -> Codec:
    """Read a vocabulary file on the driver; the codec is sent with the tasks."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.IsByte(i) else "unknown" if sp.IsUnknown(i) else "control" if sp.IsControl(i) or sp.IsUnused(i) else "normal"
    return Codec([(sp.IdToPiece(i), sp.GetScore(i), kind(i)) for i in range(sp.GetPieceSize())])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has about SLICE_CHARS characters, one row at least."""
    lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(lens):
        if total and total + n > SLICE_CHARS:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def encode(docs: DataFrame, text_col: str = "text", model: str = DEFAULT_MODEL, ids_col: str = "ids", verify: bool = False, keep_text: bool = True) -> DataFrame:
    """Add the piece ids of each text as ``ids_col``, and ``n_tokens``; with ``verify``, ``exact`` too.

    Without ``keep_text`` the texts, which the ids stand for, are not returned.
    ``exact`` tells whether decoding the ids gives the text again. White space other
    than the blank, and any character without a piece, is written as its UTF-8 bytes.

    Edge cases: NULL text gives NULL ids, 0 tokens and NULL ``exact``; the empty text
    gives no ids; a marker character in the text falls back to bytes, so it comes back
    as itself; texts of any length are encoded whole; repeated rows stay; input columns
    named as an output column are replaced; an empty table gives an empty result.
    """
    codec = load_codec(model)
    out = [ids_col, "n_tokens", *(["exact"] if verify else [])]
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in out])
    back = [f.name for f in kept.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*[kept.schema[c] for c in back], T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.IntegerType()), *([T.StructField("exact", T.BooleanType())] if verify else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(codec)
        for whole in batches:
            for batch in _slices(whole, text_col):
                column = batch.column(text_col)
                texts = column.to_pylist()
                missing = np.array([t is None for t in texts], bool)
                ids, offsets = memo.encode([t or "" for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(missing, False)) if missing.any() else pa.array(offsets.astype(np.int32)), pa.array(ids))
                columns = [*[batch.column(c) for c in back], lists, pa.array(np.diff(offsets).astype(np.int32))]
                if verify:
                    decoded = codec.decode_many(ids, offsets)
                    columns.append(pa.array([None if t is None else t == b for t, b in zip(texts, decoded, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*back, *out])

    return arrow(kept, run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = DEFAULT_MODEL, text_col: str = "decoded") -> DataFrame:
    """Add the text of each id list as ``text_col``.

    Edge cases: NULL ids give NULL; an empty list gives the empty text; bytes that
    are no UTF-8 give replacement characters; control pieces give nothing; an id
    outside the vocabulary is an error; a column named ``text_col`` is replaced.
    """
    codec = load_codec(model)
    kept = encoded.select(*[f"`{c}`" for c in encoded.columns if c != text_col])
    schema = T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column(ids_col)
                lens = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ids = pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = codec.decode_many(ids, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64))
                valid = lists.is_valid().to_pylist()
                column = pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, text_col])

    return arrow(kept, run, schema)
