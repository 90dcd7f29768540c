"""Chat formatting by minimum-cost role repair.

A conversation is legal if it is an optional system turn followed by user and assistant turns in turn, user
first.  Each turn is kept, relabelled, merged into the turn before, or set behind an inserted empty turn; dynamic
programming over the automaton of legal turns picks the choices of least cost.  The repaired sequence is
rendered with role markers.

Conversations are cut into segments of ``SEGMENT`` turn numbers, and further where many rows share a number.  A
segment is reduced to a small matrix (least cost from each state on entry to each on exit), the matrices of a
conversation are chained, and each segment is then solved between its fixed states.  So no long conversation is
held by one task; the chain holds one row per segment.  The result is one fragment per turn: fragments of a
conversation, in order, are the rendered conversation.

Defined results: turns are ordered by number, null last, then by a hash of role and text; repeated rows (equal in all
four columns) count once; a null or empty text is an empty turn; roles are compared without case and blanks, common
other names stand for user and assistant, and null or unknown roles cost a relabel whatever they become; a null
conversation id is a conversation of its own; an empty table gives an empty table; other columns are not read.
Of choices with equal cost the first in the order of states is taken.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States are the role of the last turn; the last state is the start.
ROLES = ("system", "user", "assistant")
START = 3
#: Roles that may follow each state.
NEXT = {0: (1,), 1: (2,), 2: (1,), START: (0, 1)}
#: Other names of roles (fixed values).
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant"}
MERGE, RELABEL, INSERT = 1, 2, 3
SEGMENT = 1024
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"
#: Markers in texts are broken up, so that a text cannot end its turn.
MARKER, BROKEN = "<|", "< |"
_INF = np.int64(1 << 40)


def _steps(role: str | None) -> list[tuple[int, int, int, str, int]]:
    """Choices for a turn of a role: (state before, state after, cost, action, inserted role or -1)."""
    out = []
    for before, after in product((0, 1, 2, START), range(3)):
        relabel = 0 if role == ROLES[after] else RELABEL
        named = "relabel" if relabel else "keep"
        if before == after:
            out.append((before, after, MERGE + relabel, "merge", -1))
        if after in NEXT[before]:
            out.append((before, after, relabel, named, -1))
        else:
            out += [(before, after, INSERT + relabel, named, m) for m in NEXT[before] if after in NEXT[m]]
    return out


def _table(role: str | None) -> dict[tuple[int, int], tuple[int, str, int]]:
    """Cheapest choice between two states, the first listed among equals."""
    best: dict[tuple[int, int], tuple[int, str, int]] = {}
    for before, after, cost, action, inserted in _steps(role):
        if (before, after) not in best or cost < best[before, after][0]:
            best[before, after] = (cost, action, inserted)
    return best


CHOICES = {role: _table(role) for role in (*ROLES, None)}


def _matrix(role: str | None) -> np.ndarray:
    out = np.full((4, 4), _INF)
    for (before, after), (cost, _, _) in CHOICES[role].items():
        out[before, after] = cost
    return out


_MATRICES = {role: _matrix(role) for role in CHOICES}


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs of one segment after another."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _INF)


def _known(role) -> str | None:
    name = role.strip().lower() if isinstance(role, str) else None
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def segment_matrix(roles: list) -> np.ndarray:
    out = np.full((4, 4), _INF)
    np.fill_diagonal(out, 0)
    for role in roles:
        out = _times(out, _MATRICES[_known(role)])
    return out


def chained(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """States on entry and exit of each segment of a conversation, for the least cost in all."""
    costs = [np.array([_INF, _INF, _INF, 0])]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), _INF))
    state = int(np.argmin(costs[-1]))
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        entry = int(np.argmin(costs[k] + matrices[k][:, state]))
        out.append((entry, state))
        state = entry
    return out[::-1]


def solved(roles: list, entry: int, exit_: int) -> list[tuple[int, int, str, int]]:
    """(role, cost, action, inserted) for each turn of a segment between its states."""
    known = [_known(role) for role in roles]
    costs = np.full((len(known) + 1, 4), _INF)
    costs[0, entry] = 0
    for i, role in enumerate(known):
        costs[i + 1] = np.minimum((costs[i][:, None] + _MATRICES[role]).min(axis=0), _INF)
    out = []
    state = exit_
    for i in range(len(known) - 1, -1, -1):
        before = int(np.argmin(costs[i] + _MATRICES[known[i]][:, state]))
        out.append((state, *CHOICES[known[i]][before, state]))
        state = before
    return out[::-1]


def _rendered(text, role: int, action: str, inserted: int, first: bool, last: bool) -> str:
    text = (text if isinstance(text, str) else "").replace(MARKER, BROKEN)
    if action == "merge":
        out = "\n" + text
    else:
        out = "" if first else CLOSE
        if inserted >= 0:
            out += OPEN.format(role=ROLES[inserted]) + CLOSE
        out += OPEN.format(role=ROLES[role]) + text
    return out + CLOSE if last else out


_TURNS = "conv_id string, segment long, part long, turn string, role string, text string, hash string"


def repaired(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One fragment per turn: ``conv_id, turn, role, segment, part, place, new_role, action, inserted, cost, rendered``.

    Fragments stand in order of segment, part and place.
    """
    named = conversations.select(
        F.col(id_column).cast("string").alias("conv_id"),
        F.col(turn_column).cast("long").alias("turn"),
        F.col(role_column).cast("string").alias("role"),
        F.col(text_column).cast("string").alias("text"),
    )
    coded = [F.concat_ws(":", F.col(c).isNull().cast("string"), F.coalesce(c, F.lit(""))) for c in ("role", "text")]
    turns = named.withColumn("hash", F.md5(F.concat_ws("|", *coded))).dropDuplicates(["conv_id", "turn", "hash"])
    turns = turns.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit((1 << 62) // SEGMENT)))
    full = turns.groupBy("conv_id", "segment").count().where(F.col("count") > 4 * SEGMENT)
    full = full.select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"))
    finer = F.pmod("turn", F.lit(SEGMENT)) * 4096 + F.conv(F.substring("hash", 1, 3), 16, 10).cast("long")
    crowded = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("segment") == F.col("_s"))
    turns = turns.join(full, crowded, "left").withColumn(
        "part", F.when(F.col("_s").isNotNull(), F.coalesce(finer, F.conv(F.substring("hash", 1, 3), 16, 10).cast("long"))).otherwise(0)
    )
    turns = turns.select("conv_id", "segment", "part", F.col("turn").cast("string").alias("turn"), "role", "text", "hash")
    key = ["conv_id", "segment", "part"]

    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        number = group["turn"].map(lambda x: (1, 0) if x is None or x != x else (0, int(x)))
        return group.assign(_number=number).sort_values(["_number", "hash"])

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        first = group[key].head(1)
        return first.assign(costs=[segment_matrix(ordered(group)["role"].tolist()).ravel().tolist()])

    fields = "conv_id string, segment long, part long"
    matrices = turns.groupBy(*key).applyInPandas(reduce, f"{fields}, costs array<long>")

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["segment", "part"])
        states = chained([np.array(c).reshape(4, 4) for c in group["costs"]])
        place = np.arange(len(group))
        return group[key].assign(
            entry=[a for a, _ in states], exit=[b for _, b in states], first=place == 0, last=place == len(group) - 1
        )

    ends = matrices.groupBy("conv_id").applyInPandas(
        chain, f"{fields}, entry int, exit int, first boolean, last boolean"
    )
    ends = ends.select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), F.col("part").alias("_p"), "entry", "exit", "first", "last")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("segment") == F.col("_s")) & (F.col("part") == F.col("_p"))
    bounded = turns.join(ends, same).drop("_c", "_s", "_p")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = ordered(group)
        head, n = group.iloc[0], len(group)
        found = solved(group["role"].tolist(), int(head["entry"]), int(head["exit"]))
        return pd.DataFrame(
            {
                **{c: group[c].to_numpy() for c in (*key, "turn", "role")},
                "place": np.arange(n),
                "new_role": [ROLES[r] for r, *_ in found],
                "action": [a for _, _, a, _ in found],
                "inserted": [ROLES[m] if m >= 0 else "" for *_, m in found],
                "cost": [c for _, c, _, _ in found],
                "rendered": [
                    _rendered(text, r, a, m, head["first"] and i == 0, head["last"] and i == n - 1)
                    for i, (text, (r, _, a, m)) in enumerate(zip(group["text"], found, strict=True))
                ],
            }
        )

    out = bounded.groupBy(*key).applyInPandas(
        solve,
        f"{fields}, turn string, role string, place long, new_role string, action string, inserted string, cost long,"
        " rendered string",
    )
    kind = conversations.schema[id_column].dataType
    return out.withColumns({"conv_id": F.col("conv_id").cast(kind), "turn": F.col("turn").cast("long")})
