"""Buckets that many unlike members share: pairs that can't hold aren't made, and no link is lost."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_exact import Sets
from tests.llm.test_linked import APART, near, wanted
from versewright.llm import common, near_dedup
from versewright.llm.shingles import word_hashes


@pytest.fixture
def pairs(monkeypatch):
    """Rows of the tables of pairs that were stored."""
    made, keep = [], common.stored

    def stored(df, name):
        out = keep(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(common, "stored", stored)
    return made


def _words(t):
    return word_hashes(t.lower().split())


def test_common_line(spark, pairs):
    """Texts that are alike in one line only, copies of one text, and copies of it that are nearly too far off."""
    rnd = random.Random(7)
    prose = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    line, base = prose(24), prose(60)
    texts = [line + prose(30) for _ in range(500)]
    for _ in range(120):
        t = list(base)
        for at in rnd.sample(range(60), rnd.choice((1, 2, 6, 7))):
            t[at] = f"n{rnd.randrange(10**6)}"
        texts.append(t)
    rows = dict(enumerate(" ".join(t) for t in texts))
    w, s = {i: _words(t) for i, t in rows.items()}, Sets(rows)
    met, buckets = {i: set(near_dedup.sketch(near_dedup.combined(x, 5)).tolist()) for i, x in w.items()}, Counter()
    for i in rows:
        buckets.update(met[i])
        for j in range(i):
            if met[i] & met[j] and near_dedup.similar(w[i], w[j]):
                s.join(i, j)
    assert max(buckets.values()) > 100  # some bucket holds many of them
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == {i: s.find(i) for i in rows}
    assert pairs[-1] < len(rows)


@pytest.mark.parametrize("n", (1, 4, 40, 300, 3000))
def test_marks_are_a_bound(spark, n):
    """Marks never tell similar texts apart; those of unlike short texts do."""
    rnd = random.Random(n)
    x, y = [], []
    for k in range(60):
        a = [f"w{rnd.randrange(rnd.choice((3, 200, 9000)))}" for _ in range(n)]
        b = list(a)
        for _ in range(int(n * rnd.choice((0, 0.05, 0.1, 0.11, 0.13, 0.25)))):
            at = rnd.randrange(max(1, len(b)))
            b[at : at + 1] = rnd.choice(([], [f"n{rnd.randrange(10**6)}"], b[at : at + 1] * 2))
        x, y = [*x, _words(" ".join(a))], [*y, _words(" ".join(b))]
    rows = [(k, near_dedup.marked(a).tolist(), len(a), near_dedup.marked(b).tolist(), len(b)) for k, (a, b) in enumerate(zip(x, y))]
    t = spark.createDataFrame(rows, "k int, x array<long>, s int, y array<long>, t int")
    far = {r["k"] for r in t.where(near_dedup.far(F.col("x"), F.col("s"), F.col("y"), F.col("t"))).collect()}
    alike = {k for k, (a, b) in enumerate(zip(x, y)) if near_dedup.similar(a, b)}
    assert alike and not far & alike
    assert not 40 <= n <= 300 or far


def test_pairs_come_once(spark, monkeypatch):
    """Ids that meet in many buckets are one pair, however the buckets are dealt out, and marks leave out no more than they say."""
    monkeypatch.setattr(common, "BLOCK", 5)
    rnd = random.Random(2)
    at = {i: rnd.choice((7, 7, 7, rnd.randrange(300))) for i in range(90)}
    buckets = {n: rnd.sample(sorted(at), 45) for n in range(6)}
    root = wanted(buckets, at)
    met = spark.createDataFrame([(n, i, 1, 0, len(m)) for n, m in buckets.items() for i in m], "bucket long, id long, size int, bits long, n long")
    known = spark.createDataFrame(list(root.items()), "id long, root long")
    marks = spark.createDataFrame([(i, x) for i, x in at.items()] * 2, "id long, mark long")
    want = {(i, j) for m in buckets.values() for i in m for j in m if i < j and root.get(i, i) != root.get(j, j)}
    got = [tuple(r) for r in common._across(met, known, APART).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = [tuple(r) for r in common._across(met, known, APART, marks, lambda x, s, y, t: F.abs(x - y) > 40).collect()]
    assert len(some) == len(set(some)) and set(some) == {(i, j) for i, j in want if abs(at[i] - at[j]) <= 40}
    b = met.drop("n")
    nodes = spark.createDataFrame(list(at.items()), "id long, x long")
    out = {r["id"]: r["root"] for r in common.linked(b, nodes, near(1), APART, marks, lambda x, s, y, t: F.abs(x - y) > 1).collect()}
    assert out == root
