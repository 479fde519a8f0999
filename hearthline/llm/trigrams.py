"""Boolean trigram queries of regular expressions.

For every node of a parsed expression four facts are kept: the exact strings it
can match (while they are few), the strings a match can start and end with, and a
query that every match fulfils. A query is None (no condition), a trigram, or
``("and" | "or", frozenset)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    import re._parser as parser  # Python 3.11 and later
except ImportError:  # pragma: no cover
    import sre_parse as parser

#: More strings than these are turned into a query and forgotten.
FEW, SHORT = 24, 16


def conj(*queries):
    parts = set()
    for q in queries:
        if q is None:
            continue
        parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return None if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def disj(*queries):
    if any(q is None for q in queries) or not queries:
        return None
    parts = set()
    for q in queries:
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def grams(strings: frozenset[str]):
    """What holds for a text that contains one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return disj(*[conj(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


@dataclass
class Facts:
    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: object = None


ANY = Facts(None, frozenset([""]), frozenset([""]))
EMPTY = Facts(frozenset([""]), frozenset([""]), frozenset([""]))


def simplify(f: Facts) -> Facts:
    if f.exact is not None and (len(f.exact) > FEW or any(len(s) > SHORT for s in f.exact)):
        f = Facts(None, f.exact, f.exact, conj(f.query, grams(f.exact)))
    if f.exact is None:
        query = conj(f.query, grams(f.prefix), grams(f.suffix))
        cut = lambda xs, of: next(ys for n in (2, 1, 0) if len(ys := frozenset(of(x, n) for x in xs)) <= FEW)
        f = Facts(None, cut(f.prefix, lambda x, n: x[:n]), cut(f.suffix, lambda x, n: x[len(x) - n :] if len(x) > n else x), query)
    return f


def then(a: Facts, b: Facts) -> Facts:
    cross = lambda xs, ys: frozenset(x + y for x in xs for y in ys)
    if a.exact is not None and b.exact is not None:
        both = cross(a.exact, b.exact)
        return simplify(Facts(both, both, both, conj(a.query, b.query)))
    prefix = cross(a.exact, b.prefix) if a.exact is not None else a.prefix
    suffix = cross(a.suffix, b.exact) if b.exact is not None else b.suffix
    # What spans the seam.
    seam = grams(cross(a.exact if a.exact is not None else a.suffix, b.exact if b.exact is not None else b.prefix))
    return simplify(Facts(None, prefix, suffix, conj(a.query, b.query, seam)))


def either(fs: list[Facts]) -> Facts:
    union = lambda xs: frozenset().union(*xs)
    query = lambda f: conj(f.query, grams(f.exact)) if f.exact is not None else f.query
    if all(f.exact is not None and f.query is None for f in fs):
        all_of = union(f.exact for f in fs)
        return simplify(Facts(all_of, all_of, all_of))
    return simplify(Facts(None, union(f.exact if f.exact is not None else f.prefix for f in fs), union(f.exact if f.exact is not None else f.suffix for f in fs), disj(*[query(f) for f in fs])))


def facts(tree) -> Facts:
    out = EMPTY
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            c = frozenset([chr(arg).lower()])
            f = Facts(c, c, c)
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            chars = set()
            for o, a in arg:
                lo, hi = (a, a) if str(o) == "LITERAL" else a
                chars |= {chr(x).lower() for x in range(lo, min(hi, lo + 300) + 1)}
            c = frozenset(chars)
            f = Facts(c, c, c) if len(c) <= FEW // 2 else ANY
        elif name == "SUBPATTERN":
            f = facts(arg[-1])
        elif name == "BRANCH":
            f = either([facts(x) for x in arg[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            one = facts(inner)
            if low == 0:
                f = either([EMPTY, one]) if high == 1 else ANY
            else:
                f = EMPTY
                for _ in range(min(low, 4)):
                    f = then(f, one)
                if high != low or low > 4:
                    f = Facts(None, f.exact if f.exact is not None else f.prefix, f.exact if f.exact is not None else f.suffix, f.query)
                    f = simplify(f)
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            f = EMPTY
        else:
            f = ANY
        out = then(out, f)
    return out


def trigram_query(pattern: str, flags: int = 0):
    """A query, on text with A-Z lower-cased, that every match of ``pattern`` fulfils; None if there is no such trigram."""
    f = facts(parser.parse(pattern, flags & ~re.IGNORECASE))
    return conj(f.query, grams(f.exact)) if f.exact is not None else conj(f.query, grams(f.prefix), grams(f.suffix))


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams_of(q) for q in query[1]])
