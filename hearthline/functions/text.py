"""Text cleaning as Column builders. NULL and blank inputs give NULL unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline import vocab

#: Letters, marks, digits and the underscore; the same characters in every engine.
WORD = r"\p{L}\p{M}\p{N}_"
# Accented letters and what they become without the accent.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(F.regexp_replace(c, r"\s+", " ")) != "", c)


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def remove_accents(c: Column) -> Column:
    """Drop accents of Latin letters; combining marks of other scripts stay."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), "[̀-ͯ]", "")


def title_case(c: Column) -> Column:
    """Upper-case the first letter after any non-letter, lower-case the others."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000_000)))), "")


def _has_any(c: Column, words: list[str]) -> Column:
    out = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(c, F.lit(w))
    return out


def _scan(c: Column, variants: list[tuple[str, str]], both_ways: bool) -> Column:
    """Exact match first, then the first variant, in order, that is part of the text (or the other way)."""
    exact = F.create_map(*[F.lit(x) for pair in dict(variants).items() for x in pair])[c]
    part = None
    for variant, standard in variants:
        hit = F.contains(c, F.lit(variant))
        if both_ways:
            hit = hit | F.contains(F.lit(variant), c)
        part = F.when(hit, standard) if part is None else part.when(hit, standard)
    return F.coalesce(exact, part, c)


def clean_city(c: Column) -> Column:
    t = F.regexp_replace(remove_accents(F.lower(F.trim(c))), rf"[^{WORD}\s-]", "")
    t = F.nullif(collapse(t), F.lit(""))
    return _scan(t, vocab.CITY_VARIANTS, both_ways=True)


def clean_property_type(c: Column) -> Column:
    t = F.regexp_replace(remove_accents(F.lower(F.trim(c))), rf"[^{WORD}\s]", " ")
    t = F.nullif(collapse(t), F.lit(""))
    return _scan(t, vocab.TYPE_VARIANTS, both_ways=False)


def clean_neighborhood(c: Column) -> Column:
    t = remove_accents(F.trim(c))
    t = F.regexp_replace(t, r"(?i)^(hay|quartier|zone|secteur)\s+", "")
    t = F.regexp_replace(t, r"(?i)\s+(hay|quartier|zone|secteur)$", "")
    t = F.regexp_replace(t, rf"[^{WORD}\s-]", "")
    return F.nullif(title_case(collapse(t)), F.lit(""))


# Promotional phrases deleted from titles, with explicit word edges.
_EDGE_A, _EDGE_B = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
PROMOTIONS = [
    (rf"(?iu){_EDGE_A}(?:urgent|urgente){_EDGE_B}", "$1$2"),
    (rf"(?iu){_EDGE_A}(?:prix négociable|négociable){_EDGE_B}", "$1$2"),
    (rf"(?iu){_EDGE_A}(?:occasion|affaire){_EDGE_B}", "$1$2"),
    (rf"(?iu){_EDGE_A}(?:contactez|appelez|tel|tél)(?:$|[^\p{{L}}\p{{N}}_\n][^\n]*|(?=\n))", "$1"),
    (rf"(?iu){_EDGE_A}(?:whatsapp|whatapp)(?:$|[^\p{{L}}\p{{N}}_\n][^\n]*|(?=\n))", "$1"),
    (r"[0-9]{10,}", ""),
]


def clean_title(c: Column) -> Column:
    t = F.trim(c)
    for pattern, to in ((r"!{2,}", "!"), (r"\?{2,}", "?"), (r"\.{2,}", "..."), *PROMOTIONS):
        t = F.regexp_replace(t, pattern, to)
    return F.nullif(title_case(collapse(t)), F.lit(""))


def clean_description(c: Column) -> Column:
    t = F.trim(c)
    for pattern, to in (
        (r"<[^>]+>", ""),
        (r"!{3,}", "!!!"),
        (r"\?{3,}", "???"),
        (r"\.{4,}", "..."),
        (rf"(^|[^{WORD}])[0-9]{{10,}}($|[^{WORD}])", "$1[PHONE]$2"),
        (rf"(^|[^{WORD}])[{WORD}][{WORD}.%+-]*@[{WORD}.-]+\.[A-Za-z|]{{2,}}", "$1[EMAIL]"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.nullif(collapse(t), F.lit(""))


def clean_address(c: Column) -> Column:
    t = remove_accents(F.trim(c))
    for word, to in (("avenue", "av"), ("boulevard", "bd"), ("place", "pl"), ("quartier", "qt")):
        t = F.regexp_replace(t, rf"(?i)(^|[^{WORD}]){word}($|[^{WORD}])", f"$1{to}$2")
    t = F.regexp_replace(t, rf"[^{WORD}\s,.-]", "")
    return F.nullif(collapse(t), F.lit(""))


def description_features(c: Column) -> Column:
    """A struct of booleans, one for each feature; all NULL for NULL."""
    t = F.lower(c)
    return F.struct(*[_has_any(t, words).alias(name) for name, words in vocab.FEATURE_WORDS.items()])


def standard_boolean(c: Column) -> Column:
    t = F.trim(F.lower(c.cast("string")))
    return F.when(_has_any(t, vocab.TRUE_WORDS), True).when(_has_any(t, vocab.FALSE_WORDS), False)


def standard_condition(c: Column) -> Column:
    t = F.nullif(remove_accents(F.trim(F.lower(c))), F.lit(""))
    out = F.when(t.isNull(), F.lit(None))
    for name, words in vocab.CONDITION_WORDS:
        out = out.when(_has_any(t, words), name)
    return out.otherwise(t)


def standard_floor(c: Column) -> Column:
    t = F.nullif(F.trim(F.lower(c.cast("string"))), F.lit(""))
    number = F.nullif(F.regexp_extract(t, r"([0-9]+)", 1), F.lit(""))
    out = F.when(number.isNotNull(), F.concat(F.lit("floor_"), F.coalesce(F.nullif(F.regexp_replace(number, "^0+", ""), F.lit("")), F.lit("0"))))
    for name, words in vocab.FLOOR_WORDS:
        out = out.when(_has_any(t, words), name)
    return out.otherwise(t)


def match_title(c: Column, platforms: tuple[str, ...] = ()) -> Column:
    """The form of a title that duplicates are compared by; '' for NULL."""
    t = F.lower(F.coalesce(c, F.lit("")))
    patterns = [(r"^(vente|à vendre|for sale|sale)\s*", ""), (r"\s*(urgent|opportunity|occasion)[^\n]*$", "")]
    if platforms:
        patterns.append((rf"\s*-\s*({'|'.join(platforms)})[^\n]*$", ""))
    patterns += [(r"\s*\([^)]*\)\s*", ""), (rf"[^{WORD}\s]", " ")]
    for pattern, to in patterns:
        t = F.regexp_replace(t, pattern, to)
    return collapse(t)


def word_count(c: Column) -> Column:
    """White-space separated words; 0 for NULL."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def keyword_flags(c: Column, prefix: str = "title_has_") -> list[Column]:
    t = F.lower(F.coalesce(c, F.lit("")))
    return [F.contains(t, F.lit(w)).cast("int").alias(f"{prefix}{w}") for w in vocab.TITLE_WORDS]


def sentiment(c: Column) -> tuple[Column, Column]:
    """Counts of positive and of negative words, also inside other words."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.regexp_count(t, F.lit("|".join(vocab.POSITIVE_WORDS))), F.regexp_count(t, F.lit("|".join(vocab.NEGATIVE_WORDS)))


def decimals(c: Column) -> Column:
    """Digits after the decimal point of a number's text."""
    return F.length(F.substring_index(c.cast("string"), ".", -1))


def full_address(neighborhood: Column, city: Column, country: str = "Morocco") -> Column:
    """Parts that are present, comma-joined; '' without a city."""
    return F.when(city.isNull(), "").otherwise(F.concat_ws(", ", neighborhood, city, F.lit(country)))
