"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with
an assistant turn. Dynamic programming over this automaton chooses for each turn whether it is kept, merged
into the turn before it, or relabelled, and where empty turns go in, at the least total cost; then the
repaired sequence is rendered. Of repairs of equal cost the one that is first in the order of ACTIONS at
the earliest turn is taken.

A conversation may be longer than a task should hold. Its steps are min-plus matrices over the states, so
blocks of turns are condensed alone, blocks are joined (there are at most two open ones for a partition),
and each block is then repaired between its two ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

ROLES = ("system", "user", "assistant")
START = 3
STATES = (0, 1, 2, START)  # the role of the last turn, or START
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
FINAL = 2
ACTIONS = ("keep", "merge", "relabel", "relabel_merge")
#: Merging turns of one role; giving a turn another role; putting in an empty turn.
MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 10**12


def role_number(role: str | None) -> int:
    """0, 1, 2 for the roles; -1 for null and any other name."""
    r = (role or "").strip().lower()
    return ROLES.index(r) if r in ROLES else -1


@lru_cache(maxsize=None)
def _paths(state: int) -> tuple[tuple[int, int, tuple[int, ...]], ...]:
    """(state, cost, roles put in) of what empty turns lead to from a state, the cheapest way to each."""
    best = {state: (0, ())}
    todo = [state]
    while todo:
        s = todo.pop(0)
        for t in NEXT[s]:
            if t not in best:
                best[t] = (best[s][0] + INSERT, best[s][1] + (t,))
                todo.append(t)
    return tuple((t, c, way) for t, (c, way) in best.items())


@lru_cache(maxsize=None)
def moves(state: int, role: int) -> tuple[tuple[int, int, str, tuple[int, ...]], ...]:
    """(cost, next state, action, roles put in before) for a turn of a role, in the order of preference."""
    out = []
    if state != START:
        out.append((MERGE + (RELABEL if role != state else 0), state, "merge" if role == state else "relabel_merge", ()))
    for s, cost, way in _paths(state):
        for t in NEXT[s]:
            out.append((cost + (0 if t == role else RELABEL), t, "keep" if t == role else "relabel", way))
    out.sort(key=lambda m: (ACTIONS.index(m[2]), m[0], m[1], m[3]))
    return tuple(out)


@lru_cache(maxsize=None)
def ending(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost of ending in a state, and the empty turns that it takes."""
    if state == START:
        return 0, ()
    return next((c, way) for t, c, way in _paths(state) if t == FINAL)


def rest_costs(roles: list[int], end: list[int]) -> list[list[int]]:
    """For each turn and state before it, the least cost of this turn and all after it, the state behind the last costing end."""
    out = [end]
    for r in reversed(roles):
        after = out[-1]
        out.append([min(m[0] + after[m[1]] for m in moves(s, r)) for s in STATES])
    return out[::-1]


def matrix(roles: list[int]) -> list[list[int]]:
    """Least costs of a block of turns from each state to each state."""
    columns = [rest_costs(roles, [0 if s == t else FAR for s in STATES])[0] for t in STATES]
    return [[columns[t][s] for t in STATES] for s in STATES]


def choose(roles: list[int], end: list[int], state: int) -> tuple[list[tuple[str, int, tuple[int, ...]]], int]:
    """(action, role, roles put in before) of each turn from a state on, and the state behind the last."""
    rest, out = rest_costs(roles, end), []
    for i, r in enumerate(roles):
        cost, t, action, way = next(m for m in moves(state, r) if m[0] + rest[i + 1][m[1]] == rest[i][state])
        out.append((action, t, way))
        state = t
    return out, state


def _open(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSE = "<|end|>\n"


def escaped(text: str) -> str:
    """A text whose markers are no markers any more: "<|" gets a backslash inside, one more where it has some already,
    so that taking one out again gives the text back."""
    return _MARK.sub(r"<\\\1|", text)


_MARK = re.compile(r"<(\\*)\|")


def rendered(choice: tuple[str, int, tuple[int, ...]], text: str, first: bool) -> str:
    """What a turn adds to the rendering: the end of the turn before it (if it isn't merged into it), empty turns, its text."""
    action, role, way = choice
    text = escaped(text)
    if action in ("merge", "relabel_merge"):
        return "\n" + text
    return ("" if first else CLOSE) + "".join(_open(x) + CLOSE for x in way) + _open(role) + text


def tail(state: int) -> str:
    """What ends a rendering."""
    return CLOSE + "".join(_open(x) + CLOSE for x in ending(state)[1]) if state != START else ""


SCHEMA = "conv_id long, turn long, role string, new_role string, action string, inserted string, rendered string"


def repaired(conversations: DataFrame, shuffle_partitions: int | None = None) -> DataFrame:
    """(conv_id, turn, role, new_role, action, inserted, rendered) of each turn.

    The turns' ``rendered``, joined in the order of turn, role and text, are the conversation's rendering; markers
    inside texts are escaped (escaped()), so a text can't open or close a turn.
    ``inserted``: roles of the empty turns before this one, joined by commas (after it, behind a bar, for the
    last one). Turns with equal numbers stand in the order of role (null before empty) and of the
    text's 64-bit digest, wherever partitions end; a null turn number comes first, a null role is relabelled, a null text is empty. Rows with a null conv_id are one conversation. Repeated
    rows are turns of their own. Other columns are not read.
    """
    spark = conversations.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark)) if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", F.coalesce("role", F.lit("")), F.col("role").isNotNull(), F.xxhash64("text")]  # one order, for parts and within them
    d = d.repartitionByRange(shuffle_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    d = d.sortWithinPartitions(*order, "text").checkpoint()

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, list[tuple]]]:
        """Runs of one conversation in this partition; a run is held, a partition is not."""
        conv, rows = object(), []
        for pdf in batches:
            for c, t, r, x in zip(pdf["conv_id"], pdf["turn"], pdf["role"], pdf["text"]):
                c = None if pd.isna(c) else int(c)
                if c != conv:
                    if rows:
                        yield conv, rows
                    conv, rows = c, []
                rows.append((None if pd.isna(t) else int(t), r, x))
        if rows:
            yield conv, rows

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first and the last run of this partition."""
        from pyspark import TaskContext

        runs = []
        for conv, rows in segments(batches):
            runs[1:] = [(conv, matrix([role_number(r) for _, r, _ in rows]))]
        part = TaskContext.get().partitionId()
        for k, (conv, m) in enumerate(runs):
            yield pd.DataFrame([(part, k, None if conv is None else str(conv), [x for row in m for x in row])], columns=["part", "k", "conv", "m"])

    as_text = d.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text")
    table = as_text.mapInPandas(ends, "part int, k int, conv string, m array<long>").collect()  # two rows for each partition at most
    groups, costs = _joined(sorted(((r["part"], r["k"], r["conv"], r["m"]) for r in table), key=lambda x: x[:2]))

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the runs that share a conversation: the state behind the run, for each state before it."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for conv, rows in segments(batches):
            if (part, conv) in costs:
                roles = [role_number(r) for _, r, _ in rows]
                yield pd.DataFrame([(part, None if conv is None else str(conv), [choose(roles, costs[part, conv], s)[1] for s in STATES])], columns=["part", "conv", "to"])

    behind_of = as_text.mapInPandas(exits, "part int, conv string, to array<int>").collect() if costs else []
    leads = {(r["part"], None if r["conv"] is None else int(r["conv"])): r["to"] for r in behind_of}
    between = {}
    for g in groups:
        state = START
        for i, key in enumerate(g):
            between[key] = (state, costs[key], i == len(g) - 1, i == 0)
            state = leads[key][state]

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, out, size = TaskContext.get().partitionId(), [], 0
        for conv, rows in segments(batches):
            closed = [ending(s)[0] for s in STATES]
            state, end, last, first = between.get((part, conv), (START, closed, True, True))
            roles = [role_number(r) for _, r, _ in rows]
            chosen, behind = choose(roles, end, state)
            for i, ((t, r, x), c) in enumerate(zip(rows, chosen)):
                text = rendered(c, x, first and i == 0)
                put = ",".join(ROLES[w] for w in c[2])
                if last and i == len(rows) - 1:
                    text += tail(behind)
                    put += "|" + ",".join(ROLES[w] for w in ending(behind)[1]) if ending(behind)[1] else ""
                out.append((conv, t, r, ROLES[c[1]], c[0], put, text))
                size += len(text)
                if size > 4_000_000 or len(out) >= 10_000:
                    yield _frame(out)
                    out, size = [], 0
        if out:
            yield _frame(out)

    return as_text.mapInPandas(repair, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "new_role", "action", "inserted", "rendered"])
    for i, c in enumerate(("conv_id", "turn")):
        out[c] = pd.array([r[i] for r in rows], dtype="Int64")
    return out


def _joined(runs: list[tuple[int, int, str | None, list[int]]]) -> tuple[list[list[tuple]], dict]:
    """Runs of conversations that lie in several partitions, and for each run the costs of all that comes after it."""
    groups: list[list[tuple]] = []
    for r in runs:
        if groups and groups[-1][-1][2] == r[2] and groups[-1][-1][0] != r[0]:
            groups[-1].append(r)
        else:
            groups.append([r])
    keys, costs = [], {}
    for g in groups:
        if len(g) < 2:
            continue
        after = [ending(s)[0] for s in STATES]
        keys.append([(part, None if conv is None else int(conv)) for part, _, conv, _ in g])
        for key, (_, _, _, m) in zip(reversed(keys[-1]), reversed(g)):
            costs[key] = after
            after = [min(m[4 * i + j] + after[j] for j in range(4)) for i in range(4)]
    return keys, costs
