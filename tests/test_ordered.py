"""Operators over the order of all rows, on many small partitions, against plain passes; plans without one task."""

import bisect
import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from versewright.operators import ordered


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_numbers(spark, parts):
    rnd = random.Random(parts)
    rows = [("hot" if i % 3 else rnd.choice(["a", None, "z"]), rnd.randrange(50), i) for i in range(700)]
    d = table(spark, rows, "k string, n int, i int")
    got = ordered.numbered(d, [F.col("n").desc(), F.col("i")], parts=parts)
    want = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert [tuple(r) for r in got.orderBy("row_no").collect()] == [(*r, i + 1) for i, r in enumerate(want)]
    assert "SinglePartition" not in plan(got)
    inside = ordered.numbered(d, [F.col("n").asc(), F.col("i")], ["k"], "no", parts)
    seen = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        seen[r[2]] = sum(x[0] == r[0] and (x[1], x[2]) <= (r[1], r[2]) for x in rows)
    assert {r["i"]: r["no"] for r in inside.collect()} == seen and "SinglePartition" not in plan(inside)
    assert ordered.numbered(d.limit(0), [F.col("i")]).collect() == []


@pytest.mark.parametrize("parts", [1, 4, 60])
@pytest.mark.parametrize("inclusive", [True, False])
def test_carried_values(spark, parts, inclusive):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["a", "b", "b", "b", None]), rnd.choice([1, 2, None]), i, rnd.choice([None] * 12 + ["x", "y"])) for i in range(400)]
    got = ordered.carried(table(spark, rows, "k string, j int, i int, v string"), "v", ["k", "j"], [F.col("i")], "last", inclusive, parts)
    held, want = {}, {}
    for k, j, i, v in rows:
        before = held.get((k, j))
        if v is not None and k is not None and j is not None:
            held[k, j] = v
        want[i] = None if k is None or j is None else held.get((k, j)) if inclusive else before
    mine = {r["i"]: r["last"] for r in got.collect()}
    assert mine == want and got.columns == ["k", "j", "i", "v", "last"]


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_floors(spark, parts):
    rnd = random.Random(parts)
    starts = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(0, 900, 9)])) for _ in range(120)]
    rows = [(rnd.choice(["a", "a", "b", "c", None]), 500 if i % 3 == 0 else rnd.choice([None, *range(-5, 1000)]), i) for i in range(600)]
    got = ordered.floored(table(spark, rows, "k string, n long, i int"), "n", table(spark, starts, "k string, s int"), "s", ["k"], parts=parts)
    by = {k: sorted({s for x, s in starts if x == k and s is not None}) for k in "abc"}

    def floor(k, n):
        at = bisect.bisect_right(by[k], n) if k is not None and n is not None else 0
        return by[k][at - 1] if at else None

    assert {r["i"]: r["floor"] for r in got.collect()} == {i: floor(k, n) for k, n, i in rows}
    assert got.columns == ["k", "n", "i", "floor"] and "SinglePartition" not in plan(got)
    every = ordered.floored(table(spark, rows, "k string, n long, i int"), "n", table(spark, starts, "k string, s int"), "s", parts=parts)
    all_ = sorted({s for _, s in starts if s is not None})
    assert {r["i"]: r["floor"] for r in every.collect()} == {i: None if n is None or n < all_[0] else all_[bisect.bisect_right(all_, n) - 1] for _, n, i in rows}
    assert {r["floor"] for r in ordered.floored(table(spark, rows, "k string, n long, i int"), "n", table(spark, starts, "k string, s int").limit(0), "s").collect()} == {None}


@pytest.mark.parametrize("parts", [1, 5, 80])
def test_states_of_an_automaton(spark, parts):
    rnd = random.Random(parts)
    moves = [[rnd.randrange(6) for _ in range(6)] for _ in range(4)]
    rows = [("long" if i % 4 else rnd.choice(["a", "z", None]), i, rnd.choice([0, 1, 2, 3, None])) for i in range(900)]
    step = lambda state, s: (moves[s][state], 10 * state + s)
    got = ordered.scanned(table(spark, rows, "k string, i int, s int"), ["k"], [F.col("i")], "s", step, 6, 2, parts=parts)
    now, want = {}, {}
    for k, i, s in rows:
        state = now.get(k, 2)
        want[i] = None if s is None else 10 * state + s
        now[k] = state if s is None else moves[s][state]
    assert {r["i"]: r["output"] for r in got.collect()} == want and "SinglePartition" not in plan(got)
    alone = ordered.scanned(table(spark, rows, "k string, i int, s int"), [], [F.col("i")], "s", step, 6, 2, parts=parts)
    state = 2
    for r in alone.orderBy("i").collect():
        assert r["output"] == (None if r["s"] is None else 10 * state + r["s"])
        state = state if r["s"] is None else moves[r["s"]][state]
