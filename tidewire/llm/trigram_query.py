"""Boolean trigram queries derived from regular expressions.

A query is a disjunction of sets of trigrams: a text that holds a match of the pattern holds, lower-cased, all trigrams
of one of the sets.  It is derived over the syntax tree: every part has the strings that it can match, if they
are few, otherwise the strings that its matches can begin and end with, and the query that its matches satisfy.
Concatenation joins ends with beginnings, alternation unites, repetition keeps what one turn demands.  Where a set
would grow beyond ``MOST`` strings, the demand is weakened, never strengthened, so no match is lost.

A query that is empty demands nothing: all texts must be searched.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as syntax
from dataclasses import dataclass

Query = frozenset[frozenset[str]]
#: Demands nothing: one set without trigrams.
ALL: Query = frozenset({frozenset()})
#: Strings in a set, sets in a query, and characters of a class that are told apart.
MOST, FEW = 64, 8
#: Turns of a repetition that are written out.
TURNS = 4


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _least(sets: set[frozenset[str]]) -> Query:
    """Sets that demand more than another one add nothing to a disjunction."""
    return frozenset(s for s in sets if not any(other < s for other in sets))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST:
        return min(a, b, key=lambda q: (q == ALL, len(q)))
    return _least({x | y for x in a for y in b})


def _either(a: Query, b: Query) -> Query:
    united = _least({*a, *b})
    return united if len(united) <= MOST else ALL


def _holding(strings: frozenset[str]) -> Query:
    """Demanded where one of the strings must occur."""
    return _least({trigrams(s) for s in strings})


@dataclass(frozen=True)
class _Part:
    """All strings a part can match (None: too many), their beginnings, their ends, and the query of its matches."""

    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    query: Query

    @staticmethod
    def of(strings: frozenset[str]) -> _Part:
        return _Part(strings, strings, strings, _holding(strings))


_NOTHING = _Part.of(frozenset({""}))
_ANYTHING = _Part(None, frozenset({""}), frozenset({""}), ALL)


def _joined(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MOST else None


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None:
        whole = _joined(a.exact, b.exact)
        if whole is not None:
            return _Part.of(whole)
    query = _both(a.query, b.query)
    across = _joined(frozenset(x[-2:] for x in a.ends), frozenset(y[:2] for y in b.begins))
    if across is not None:
        query = _both(query, _holding(across))
    begins = a.begins if a.exact is None else _joined(a.exact, b.begins) or a.begins
    ends = b.ends if b.exact is None else _joined(a.ends, b.exact) or b.ends
    return _Part(None, begins, ends, query)


def _or(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST:
        return _Part.of(a.exact | b.exact)
    unknown = frozenset({""})
    begins, ends = a.begins | b.begins, a.ends | b.ends
    return _Part(
        None, begins if len(begins) <= MOST else unknown, ends if len(ends) <= MOST else unknown, _either(a.query, b.query)
    )


def _class(items: list) -> _Part:
    found: set[str] = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            found.add(chr(value).lower())
        elif kind is kinds.RANGE and value[1] - value[0] < 128:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:  # a negation or a named class
            return _ANYTHING
    return _Part.of(frozenset(found)) if len(found) <= FEW else _ANYTHING


def _repeated(least: int, most: int, one: _Part) -> _Part:
    if least == 0:
        return _or(_NOTHING, one) if most == 1 else _ANYTHING
    out = one
    for _ in range(min(least, TURNS) - 1):
        out = _then(out, one)
    if most == least <= TURNS:
        return out
    # More turns of the same part may follow; the last one ends the whole.
    out = _then(out, _ANYTHING)
    return _Part(None, out.begins, one.ends, out.query)


def _sequence(tree) -> _Part:
    out = _NOTHING
    for kind, value in tree:
        out = _then(out, _part(kind, value))
    return out


def _part(kind, value) -> _Part:
    if kind is kinds.LITERAL:
        return _Part.of(frozenset({chr(value).lower()}))
    if kind is kinds.IN:
        return _class(value)
    if kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
        return _NOTHING
    if kind is kinds.SUBPATTERN:
        return _sequence(value[-1])
    if kind is kinds.BRANCH:
        first, *others = map(_sequence, value[1])
        for other in others:
            first = _or(first, other)
        return first
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        least, most, inner = value
        return _repeated(least, most, _sequence(inner))
    return _ANYTHING


def derived(pattern: str) -> tuple[frozenset[str], ...]:
    """The query of a pattern, its sets in a fixed order; empty if it demands nothing.

    The end of the text may be written ``\\z``, as Java and RE2 do.  A pattern must not use flags.
    """
    query = _sequence(syntax.parse(pattern.replace(r"\z", r"\Z"))).query
    return tuple(sorted(query, key=sorted)) if frozenset() not in query else ()
