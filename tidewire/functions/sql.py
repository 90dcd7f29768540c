"""Putting SQL expressions together."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

_counter = itertools.count()


def fresh(prefix: str = "v") -> str:
    """A name no other expression uses."""
    return f"{prefix}{next(_counter)}_"


def lit(text: str) -> str:
    """A SQL string literal."""
    out = []
    for ch in text:
        if ch in "\\'":
            out.append("\\" + ch)
        elif ord(ch) < 0x20 or 0x7F <= ord(ch) < 0xA1:
            out.append(f"\\u{ord(ch):04x}")
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind a computed value to a name inside one expression.

    The value appears once in the plan and is computed once per row, however
    often ``body`` uses it.
    """
    name = fresh()
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def each(array: str, body: Callable[[str], str]) -> str:
    name = fresh()
    return f"transform({array}, {name} -> {body(name)})"


def keep(array: str, test: Callable[[str], str]) -> str:
    name = fresh()
    return f"filter({array}, {name} -> {test(name)})"


def fold(array: str, start: str, step: Callable[[str, str], str]) -> str:
    acc, item = fresh("a"), fresh()
    return f"aggregate({array}, {start}, ({acc}, {item}) -> {step(acc, item)})"


def captures(c: str, pattern: str, groups: int) -> str:
    """All groups of the first match as an array in one pass, NULL without a match.

    ``pattern`` must match the whole text, so wrap one that is searched for.
    """
    by = "\x02" + "\x01".join(f"${n + 1}" for n in range(groups))
    return let(
        f"regexp_replace({c}, {lit(pattern)}, {lit(by)})",
        lambda r: f"if(startswith({r}, {lit(chr(2))}), split(substr({r}, 2), {lit(chr(1))}, -1), NULL)",
    )


def found(pattern: str) -> str:
    """Make a pattern match the whole of any text in which it occurs."""
    flags, rest = re.match(r"(\(\?[a-zA-Z]+\))?(.*)", pattern, re.DOTALL).groups()
    return f"(?s){flags or ''}^.*?{rest}.*$"


def case(*pairs: tuple[str, str], default: str | None = None) -> str:
    whens = " ".join(f"WHEN {test} THEN {value}" for test, value in pairs)
    return f"(CASE {whens} ELSE {default} END)" if default is not None else f"(CASE {whens} END)"


def constant_map(values: dict, types: str) -> str:
    """A map literal; the optimizer folds the one JSON text into it."""
    return f"from_json({lit(json.dumps(values, ensure_ascii=False))}, 'map<{types}>')"


def sql_function(builder: Callable[..., str]) -> Callable:
    """Let a builder of SQL text also work on Columns."""

    @wraps(builder)
    def call(*args, **options):
        columns = [a for a in args if isinstance(a, Column)]
        if not columns:
            return builder(*args, **options)
        row = fresh("r")
        fields = iter(range(len(columns)))
        names = [f"{row}.c{next(fields)}" if isinstance(a, Column) else a for a in args]
        packed = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
        body = F.expr(f"{row} -> {builder(*names, **options)}")
        return F.call_function("transform", F.array(packed), body)[0]

    return call
