"""The text scan SQL functions cannot express, as an Arrow-batched helper.

It works on one document at a time and only returns what was found; all further
work on the results is done with Column expressions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

_LINK = pa.struct(
    [("label", pa.string()), ("target", pa.string()), ("first", pa.int64()), ("after", pa.int64()),
     ("lead", pa.string()), ("tail", pa.string())]
)
_SPARK_LINK = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("target", T.StringType()),
            T.StructField("first", T.LongType()),
            T.StructField("after", T.LongType()),
            T.StructField("lead", T.StringType()),
            T.StructField("tail", T.StringType()),
        ]
    )
)
_TOKEN = re.compile(r"\\.|[\[\]()]", re.DOTALL)
TAIL = 100


def _pairs(text: str) -> dict[int, int]:
    """Opening position -> closing position of balanced brackets and parentheses.

    Escaped characters neither open nor close anything; an escaped ``[`` can still
    start a link, which then ends where its surroundings end.
    """
    partner: dict[int, int] = {}
    squares: list[tuple[int, bool]] = []
    rounds: list[int] = []
    for token in _TOKEN.finditer(text):
        at, mark = token.start(), token.group()
        if mark == "[":
            squares.append((at, True))
        elif mark == "\\[":
            squares.append((at + 1, False))
        elif mark == "(":
            rounds.append(at)
        elif mark == ")" and rounds:
            partner[rounds.pop()] = at
        elif mark == "]":
            real = False
            while squares and not real:
                opened, real = squares.pop()
                partner[opened] = at
    return partner


def _destination(raw: str) -> str:
    raw = raw.strip()
    if raw[:1] == "<" and ">" in raw:
        return raw[1 : raw.index(">")]
    return re.split(r"\s+[\"']", raw, maxsplit=1)[0]


def _lead(text: str, at: int) -> str:
    """Last word before a link on its line, at most 8 characters of it."""
    end = at
    while end > 0 and text[end - 1] != "\n" and text[end - 1].isspace():
        end -= 1
    begin = end
    while begin > 0 and end - begin < 8 and not text[begin - 1].isspace():
        begin -= 1
    return text[begin:end]


def find_links(text: str) -> list[dict]:
    """Inline links in order; a link inside the label of another one is part of it."""
    partner = _pairs(text)
    found, free_from = [], 0
    for opened in sorted(p for p in partner if text[p] == "["):
        closed = partner[opened]
        if opened < free_from or (opened > 0 and text[opened - 1] == "!"):
            continue
        end = partner.get(closed + 1) if text[closed + 1 : closed + 2] == "(" else None
        if end is None:
            continue
        free_from = end + 1
        found.append(
            {
                "label": text[opened + 1 : closed],
                "target": _destination(text[closed + 2 : end]),
                "first": opened,
                "after": end + 1,
                "lead": _lead(text, opened),
                "tail": text[end + 1 : end + 1 + TAIL],
            }
        )
    return found


@arrow_udf(_SPARK_LINK)
def markdown_links(texts: pa.Array) -> pa.Array:
    return pa.array(
        [find_links(t) if t and "](" in t else [] for t in texts.to_pylist()], pa.list_(_LINK)
    )


# Marked so that the optimizer keeps the scan in one place of the plan and never
# runs it once per use of its result.
markdown_links = markdown_links.asNondeterministic()
