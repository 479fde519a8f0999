"""Personal data replaced by keyed surrogates of the same type and shape.

Entities are found by pattern and check digit. Each distinct value, wherever it
occurs, gets one surrogate drawn from a keyed hash of type, value and attempt:
letters stay letters of their script and case, digits stay digits, names keep their
gender, numbers keep their check digit. A surrogate that another value already has,
or that occurs as a value itself, is drawn again for all but one of the claimants
until no collision is left, so distinct values stay distinct and equal ones equal.

A name is known by a title before it. Its given name and surname are values of their
own, so all forms of a name agree whatever the title. Pairs of capitalised words that
are the full name of somebody titled anywhere in the corpus are names too, and so
are, within a text, single capitalised words that are part of a name found there.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import arrow, bitmap_bits, lookup, materialise, possible

DEFAULT_KEY = b"hearthline demonstration key"
#: Replacements of up to so many bytes in all are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 4 << 20

# Entity patterns.
PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9_][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])")),
)
# Titles, and surrogate names by gender.
FEMALE_TITLES = frozenset("mrs ms miss frau madame señora sra signora госпожа κυρία".split())
MALE_TITLES = frozenset("mr herr monsieur señor sr signor господин κύριος".split())
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora Sr Sra Signor Signora Доктор Господин Госпожа Профессор Κύριος Κυρία".split()
FEMALE = "Anna Clara Elena Emma Eva Hanna Ida Irene Julia Laura Lena Lucia Maria Marta Nina Nora Olga Paula Rita Rosa Sara Silvia Sofia Teresa Vera".split()
MALE = "Adam Alan Boris Carl David Emil Erik Felix Georg Hugo Ivan Jan Karl Leo Luis Marco Max Nico Oscar Otto Paul Peter Simon Tomas Viktor".split()
SURNAMES = "Adler Bauer Becker Blanc Bosch Costa Dubois Fischer Fontana Garcia Haas Horn Keller Klein Lang Lopez Maier Marin Martin Meyer Moreau Navarro Petit Ramos Richter Romano Roux Santos Schmid Serra Torres Vogel Wagner Weber Winter Wolf".split()


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


_NAME = re.compile(rf"(?<!\w)({'|'.join(TITLES)})\.? ([^\W\d_]{{2,}})(?: ([^\W\d_]{{2,}}))?(?!\w)")
_PAIR = re.compile(r"(?<!\w)(?=([^\W\d_]{2,}) ([^\W\d_]{2,})(?!\w))")
_SINGLE = re.compile(r"(?<!\w)[^\W\d_]{2,}(?!\w)")
#: A mention: its span, its type, and the spans, types and values of the parts to be replaced.
Mention = tuple[int, int, str, list[tuple[int, int, str, str]]]


def _may_have(kind: str, text: str) -> bool:
    """A plain substring test that every text with such an entity passes."""
    return "@" in text if kind == "email" else any(d in text for d in "0123456789")


def titled(text: str) -> list[tuple[int, list[tuple[int, int, str, str]]]]:
    """Names after a title: the title's gender (1 female, -1 male, else 0) and the parts."""
    out = []
    for m in _NAME.finditer(text) if any(t in text for t in TITLES) else ():
        title = m[1].lower()
        gender = (title in FEMALE_TITLES) - (title in MALE_TITLES)
        if not m[2][0].isupper():
            continue
        spans = [m.span(2)] + ([m.span(3)] if m[3] and m[3][0].isupper() else [])
        kinds = ("surname",) if len(spans) == 1 else ("given", "surname")
        out.append((gender, [(a, b, k, text[a:b].casefold()) for (a, b), k in zip(spans, kinds, strict=True)]))
    return out


def capitalised_pairs(text: str) -> set[tuple[str, str]]:
    """Neighbouring capitalised words, which are names if somebody titled has that full name."""
    return {(m[1].casefold(), m[2].casefold()) for m in _PAIR.finditer(text) if m[1][0].isupper() and m[2][0].isupper()}


def find(text: str, pairs: frozenset[tuple[str, str]] = frozenset()) -> list[Mention]:
    """Mentions in order; where two overlap, the type listed first stays, and names come last.

    ``pairs`` are the known full names among the text's capitalised pairs.
    """
    out: list[Mention] = []
    taken = bytearray()

    def add(kind: str, parts: list[tuple[int, int, str, str]]) -> None:
        nonlocal taken
        a, b = parts[0][0], parts[-1][1]
        taken = taken or bytearray(len(text))
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, kind, parts))

    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text) if _may_have(kind, text) else ():
            if kind != "card" or 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                add(kind, [(*m.span(), kind, canonical(kind, m[0]))])
    for _, parts in titled(text):
        add("name", parts)
    if pairs:
        for m in _PAIR.finditer(text):
            pair = m[1].casefold(), m[2].casefold()
            if pair in pairs and m[1][0].isupper() and m[2][0].isupper():
                add("name", [(*m.span(1), "given", pair[0]), (*m.span(2), "surname", pair[1])])
    known = {v: k for _, _, kind, parts in out if kind == "name" for _, _, k, v in reversed(parts)}
    if known:
        for m in _SINGLE.finditer(text):
            kind = known.get(m[0].casefold())
            if kind and m[0][0].isupper():
                add("name", [(*m.span(), kind, m[0].casefold())])
    return sorted(out)


def canonical(kind: str, value: str) -> str:
    """The form in which mentions of one entity agree."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "iban", "phone", "ssn"):
        return re.sub(r"[ .()-]", "", value)
    return value


class Stream:
    """Bytes of a keyed hash in counter mode."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.at, self.left = key, "\0".join(parts).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        while len(self.left) < 4:
            self.left += hashlib.blake2b(self.seed + self.at.to_bytes(8, "big"), key=self.key[:64], digest_size=64).digest()
            self.at += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x * n >> 32


def like(ch: str, s: Stream) -> str:
    """Another character of the same kind, script and case; others stay."""
    if ch.isascii():
        if ch.isdigit():
            return str(s.below(10))
        if ch.isalpha():
            x = chr(97 + s.below(26))
            return x.upper() if ch.isupper() else x
        return ch
    if not ch.isalpha():
        return ch
    # Letters of the same block of 32 code points with the same category, of which there is at least this one.
    first = ord(ch) & ~31
    kin = [chr(c) for c in range(first, first + 32) if unicodedata.category(chr(c)) == unicodedata.category(ch)]
    return kin[s.below(len(kin))]


def _check_card(digits: str) -> str:
    return next(d for d in "0123456789" if luhn(digits[:-1] + d))


def surrogate(kind: str, value: str, attempt: int, gender: int, key: bytes) -> str:
    """The replacement of a canonical value; ``gender`` is that of a given name, 1 female, -1 male."""
    s = Stream(key, kind, value, str(attempt))
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return "".join(like(c, s) for c in local) + "@" + "".join(like(c, s) for c in host) + "." + top
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "card":
        # The leading digit names the issuer's type and stays; the check digit holds where it held.
        out = value[0] + "".join(like(c, s) for c in value[1:])
        return out[:-1] + _check_card(out) if luhn(value) else out
    if kind == "iban":
        body = "".join(like(c, s) for c in value[4:])
        digits = lambda t: "".join(str(int(c, 36)) for c in t)
        return value[:2] + f"{98 - int(digits(body + value[:2] + '00')) % 97:02d}" + body
    if kind == "phone":
        # The country code stays: with a plus sign, up to two digits.
        keep = 2 if value.startswith("+1") else 3 if value.startswith("+") else 0
        return value[:keep] + "".join(like(c, s) for c in value[keep:])
    if kind in ("given", "surname"):
        if not all(c.isascii() or "LATIN" in unicodedata.name(c, "") for c in value):
            return "".join(like(c, s) for c in value)
        names = SURNAMES if kind == "surname" else FEMALE if gender > 0 else MALE if gender < 0 else FEMALE + MALE
        name = names[s.below(len(names))]
        # Lists are short; later attempts add letters.
        return (name + "".join(chr(97 + s.below(26)) for _ in range(1 + attempt // 2)) if attempt else name).casefold()
    return "".join(like(c, s) for c in value)


def dress(kind: str, original: str, replacement: str) -> str:
    """Write a canonical surrogate in the original's format."""
    if kind == "email":
        if len(original) != len(replacement):
            return replacement
        return "".join(r.upper() if o.isupper() else r for o, r in zip(original, replacement, strict=True))
    if kind in ("card", "iban", "phone", "ssn"):
        chars = iter(replacement)
        return "".join(c if c in " .()-" else next(chars) for c in original)
    if kind in ("given", "surname"):
        return replacement.upper() if original.isupper() else replacement[0].upper() + replacement[1:]
    return replacement


def _found(texts: DataFrame) -> DataFrame:
    """``h, kind, value, gender``: the distinct entities of every text ``h, text`` that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, kinds, values, genders = [], [], [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py()
                found = dict.fromkeys([(k, v) for *_, parts in find(text) for *_, k, v in parts], 0)
                for g, parts in titled(text) if found else ():
                    for *_, k, v in parts:
                        if k == "given" and (k, v) in found:
                            found[k, v] += g
                for (k, v), g in found.items():
                    hs.append(h)
                    kinds.append(k)
                    values.append(v)
                    genders.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(genders, pa.int64())], names=["h", "kind", "value", "gender"])

    return arrow(texts, run, "h long, kind string, value string, gender long")


def _full_names(texts: DataFrame, only_titled: bool) -> DataFrame:
    """``h, given, surname``: titled full names of every text, or all its capitalised pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                hs, names = [], []
                for h, t in zip(whole.column(0).slice(at, 512).to_pylist(), whole.column(1).slice(at, 512), strict=True):
                    text = t.as_py()
                    found = {(p[0][3], p[1][3]) for _, p in titled(text) if len(p) == 2} if only_titled else capitalised_pairs(text)
                    hs += [h] * len(found)
                    names += found
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.string())], names=["h", "given", "surname"])

    return arrow(texts, run, "h long, given string, surname string")


def surrogates(values: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """``kind, value, replacement`` for distinct ``kind, value, gender``, without collisions.

    Each round draws again only for values in a collision; the smallest of several
    claimants of a surrogate keeps it, unless it is a value that occurs. An empty table
    gives an empty result; NULL kinds or values are not expected.
    """

    def draw(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k, v, g, n = (batch.column(i).to_pylist() for i in range(4))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k[i], v[i], n[i], g[i], key) for i in range(len(k))], pa.string())], names=[*batch.schema.names, "replacement"])

        return arrow(rows, run, "kind string, value string, gender long, attempt int, replacement string")

    values = values.select("kind", "value", "gender")
    done = materialise(draw(values.withColumn("attempt", F.lit(0))))
    while True:
        claims = done.groupBy("kind", "replacement").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n"))
        claims = claims.join(values.select("kind", F.col("value").alias("replacement"), F.lit(True).alias("taken")), ["kind", "replacement"], "left").where("n > 1 or taken")
        again = materialise(done.join(claims, ["kind", "replacement"]).where("taken or value <> first").select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt")))
        if again.isEmpty():
            return done.select("kind", "value", "replacement")
        done = materialise(done.join(again.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(draw(again)))


def _entities(texts: DataFrame) -> DataFrame:
    """``h, kind, value, gender`` of all texts, those of known full names without a title included (kind ``pair`` marks them)."""
    found = materialise(_found(texts).groupBy("h", "kind", "value").agg(F.max("gender").alias("gender")))
    if found.where("kind = 'given'").isEmpty():
        return found
    hashed = lambda df: df.withColumn("p", F.xxhash64("given", "surname"))
    of_names = possible(texts, found.where("kind = 'given'").select("h").distinct(), "h", bitmap_bits(found.where("kind = 'given'").count()))
    known = materialise(hashed(_full_names(of_names, True).select("given", "surname").distinct()))
    pairs = possible(hashed(_full_names(texts, False)), known, "p", bitmap_bits(known.count())).distinct()
    # A full name is as often as it is met in texts, and its hot ones are dealt apart.
    counted = materialise(pairs.join(known, ["p", "given", "surname"]))
    none = F.lit(0).cast("long").alias("gender")
    parts = [counted.select("h", F.lit(k).alias("kind"), F.col(k).alias("value"), none) for k in ("given", "surname")]
    pair = counted.select("h", F.lit("pair").alias("kind"), F.concat_ws(" ", "given", "surname").alias("value"), none)
    return materialise(found.unionByName(parts[0]).unionByName(parts[1]).unionByName(pair).groupBy("h", "kind", "value").agg(F.sum("gender").alias("gender")))


def replace_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """The rows with every detected entity replaced: ``id_col, text_col, n_entities, kinds``.

    ``kinds`` counts the replaced mentions by type. Mentions of one value, in any
    text and format, get the same surrogate.

    Edge cases: NULL text stays NULL and the empty text empty, with no entities; NULL
    ids are passed on; repeated rows give equal results; texts of any length are read
    whole; where patterns overlap, the type listed first counts; a given name with
    titles of both genders goes by the more frequent one; an empty table gives an
    empty result; other columns are not read.
    """
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").alias("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text, F.xxhash64(text).alias("h"))
    entities = _entities(rows.where("text is not null").select("h", "text"))
    values = entities.where("kind <> 'pair'").groupBy("kind", "value").agg(F.signum(F.sum("gender")).cast("long").alias("gender"))
    drawn = surrogates(values, key).withColumnRenamed("replacement", "to")
    # One row per distinct text with entities: the replacements it needs. A value in many texts is dealt by text.
    uses = materialise(drawn.join(entities.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("w")), ["kind", "value"]))
    given = lookup(entities.drop("gender"), uses, ("kind", "value"), "w", "h")
    needed = materialise(given.groupBy("h").agg(F.collect_list(F.struct("kind", "value", "to")).alias("map")))
    texts, size = needed.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json("map")))).first()
    bits = bitmap_bits(texts)
    # Texts without entities bypass the join; two texts of one hash share a map, which has the values of both.
    plain = possible(rows, needed.select("h"), "h", bits, within=False).select("id", "text", F.lit(0).alias("n_entities"), F.create_map().cast("map<string,int>").alias("kinds"))
    maybe = possible(rows, needed.select("h"), "h", bits)
    joined = maybe.join(F.broadcast(needed) if (size or 0) <= BROADCAST_BYTES else needed, "h", "left").select("id", "text", "map")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                done = [replaced(t, m) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                texts, kinds = [d[0] for d in done], [list(d[1].items()) for d in done]
                totals = [sum(d[1].values()) for d in done]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int32()), pa.array(kinds, pa.map_(pa.string(), pa.int32()))], names=["id", "text", "n_entities", "kinds"])

    out = arrow(joined, run, f"id {kind_of_id}, text string, n_entities int, kinds map<string,int>")
    return plain.unionByName(out).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities", "kinds")


def replaced(text: str | None, entries: list[dict] | None) -> tuple[str | None, dict[str, int]]:
    """A text with its mentions replaced by ``entries`` (kind, value, to), and their number by type."""
    if text is None or not entries:
        return text, {}
    to = {(e["kind"], e["value"]): e["to"] for e in entries}
    pairs = frozenset(tuple(v.split(" ")) for k, v in to if k == "pair")
    out, at, count = [], 0, Counter()
    for *_, kind, parts in find(text, pairs):
        count[kind] += 1
        for a, b, k, v in parts:
            out += [text[at:a], dress(k, text[a:b], to[k, v])]
            at = b
    return "".join([*out, text[at:]]), dict(count)
