"""Names in texts against looking for each of them."""

import random

from pyspark.sql import functions as F

from versewright.functions import text as T
from versewright.operators import lookups, matcher

NONE = matcher._NONE


def test_overlapping_and_nested_names():
    rnd = random.Random(2)
    for alphabet in ("ab", "abcé", "aß日😀"):
        names = [("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 9))), rnd.randrange(40)) for _ in range(25)] + [("", 0)]
        texts = ["".join(rnd.choice(alphabet + " x") for _ in range(rnd.randrange(0, 60))) for _ in range(200)] + ["", "a" * 5000, "x" * 3000 + names[0][0], alphabet * 700]
        m = matcher.Matcher(names)
        assert m.ranks(texts).tolist() == [min((r for n, r in names if n and n in t), default=NONE) for t in texts]
        assert m.ranks([]).tolist() == []
    assert matcher.Matcher([]).ranks(["a", ""]).tolist() == [NONE, NONE]


def test_names_over_borders_of_strips():
    name = "needle in the hay"
    m = matcher.Matcher([(name, 3), ("needle", 5)])
    texts = ["-" * k + name for k in range(480, 530)] + ["-" * k + name[:-1] for k in range(480, 530)]
    assert m.ranks(texts).tolist() == [3] * 50 + [5] * 50


def test_batches_and_parts(spark, monkeypatch):
    monkeypatch.setattr(matcher, "AT_ONCE", 50)
    names = [(f"n{i}n", i) for i in range(90)]
    texts = [f"xx n{i}n n{(i * 7) % 90}n" for i in range(90)] * 3
    assert matcher.Matcher(names).ranks(texts).tolist() == [min(i, i * 7 % 90) for i in range(90)] * 3


def test_aliases(spark):
    a = spark.createDataFrame([("SAM", "Samuel", 2), ("1SA", "1 Samuel", 1), ("2SA", "2-samuel", 1), ("KIN", "Kings", 3), ("X", "kings", 0), ("Y", "", 0), ("Z", None, 0), ("AMU", "amu", 1)], "book string, alias string, priority int")
    said = {"Samuel": "SAM", "The first, 1 SAMUEL told": "1SA", "21 Samuel": "1SA", "2 Samuel": "2SA", "Kings": "X", "of kings": "X", "sam uel x": "1SA", "nothing": None, "": None, "am-u": "AMU", "samuel!": "SAM", "x samuel": "AMU"}
    said["sam uel x"] = "AMU"
    d = spark.createDataFrame([(k, 1) for k in said] + [(None, 2), ("Kings", 3)], "t string, book_no int")
    got = [(r["t"], r["book"]) for r in lookups.by_alias(d, F.col("t"), a, T.alias_key).collect()]
    assert sorted(got, key=str) == sorted([*said.items(), (None, None), ("Kings", "X")], key=str)
    assert {r["book"] for r in lookups.by_alias(d, F.col("t"), a.limit(0), T.alias_key).collect()} == {None}
