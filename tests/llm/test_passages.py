"""Repeated passages inside longer lines and across short ones, against brute force that knows nothing of paragraphs."""

import random
from collections import defaultdict

import pytest

from tests.conftest import SF
from versewright.llm import substring_dedup
from versewright.llm.queries import op1_substring_dedup


def _grams(rows, n):
    """Documents in which each run of n words stands."""
    at = defaultdict(set)
    for i, t in rows:
        w = t.lower().split()
        for p in range(len(w) - n + 1):
            at[tuple(w[p : p + n])].add(i)
    return at


def _shared(rows, n=50):
    """Ids of documents with a run of n words that another document has too."""
    return {i for ids in _grams(rows, n).values() if len(ids) > 1 for i in ids}


def _check(rows, got, recall):
    """Every row stands on words that other documents have; nearly all documents with a long common run have a row."""
    text, five = dict(rows), _grams(rows, 5)
    want, found = _shared(rows), {r["doc_id"] for r in got}
    assert len(want & found) >= recall * len(want), (len(want & found), len(want))
    whole = defaultdict(int)
    for r in got:
        w = text[r["doc_id"]].lower().split()[r["start_word"] : r["start_word"] + r["n_words"]]
        assert len(w) == r["n_words"]
        whole[r["doc_id"]] += len(w)
        common = sum(len(five[tuple(w[p : p + 5])] - {r["doc_id"]}) > 0 for p in range(len(w) - 4))
        assert len(w) < 10 or common >= 0.6 * (len(w) - 4), r
    assert all(n >= 40 for n in whole.values())


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_planted_passages(spark):
    rnd = random.Random(12)
    prose = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows, sizes = [], {}
    for k in range(120):
        n = rnd.choice((51, 55, 60, 72, 80, 100, 150))
        p = prose(n)
        shapes = [" ".join(prose(rnd.randrange(0, 200)) + p + prose(rnd.randrange(0, 200))) for _ in range(2)]  # inside long lines
        shapes.append("\n".join(" ".join(x) for x in (prose(9), *[p[i : i + 12] for i in range(0, n, 12)], prose(7))))  # in lines of 12 words
        for s in rnd.sample(shapes, 2):
            sizes[len(rows)] = n
            rows.append((len(rows), s))
    clean = [(1000 + i, " ".join(prose(300))) for i in range(100)]
    short = prose(40)
    clean += [(2000 + i, " ".join(prose(100) + short + prose(100))) for i in range(20)]  # common to many, but under 50 words
    clean += [(3000 + i, " ".join(["ha"] * 30)) for i in range(20)] + [(4000, " ".join(prose(60) * 3))]  # repeats inside itself only
    got = substring_dedup.repeats(_frame(spark, rows + clean)).collect()
    found = {r["doc_id"] for r in got}
    assert len(found & set(sizes)) >= 0.92 * len(sizes)
    assert {i for i, n in sizes.items() if n >= 60} - found == set()
    assert found.isdisjoint(i for i, _ in clean)
    _check(rows + clean, got, 0.92)
    for r in got:  # no word too many: what a passage has is the planted one, up to a word of chance
        assert r["n_words"] <= sizes[r["doc_id"]] + 1


def test_near_copies_are_bridged(spark):
    rnd = random.Random(5)
    prose = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(40):
        p = prose(120)
        q = [w if i % 40 != 20 else "changed" for i, w in enumerate(p)]  # a word in forty
        rows += [(2 * k, " ".join(prose(50) + p + prose(50))), (2 * k + 1, " ".join(prose(70) + q + prose(20)))]
    got = substring_dedup.repeats(_frame(spark, rows)).collect()
    assert len({r["doc_id"] for r in got}) >= 0.88 * len(rows)
    assert sum(r["n_words"] for r in got) >= 0.7 * 120 * len(rows)


def test_one_kept_place_of_each(spark):
    rnd = random.Random(7)
    prose = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    p = prose(90)
    rows = [(i, " ".join(prose(30 + i) + p + prose(40))) for i in range(9)] + [(None, " ".join(p))]
    d = _frame(spark, rows)
    got = substring_dedup.repeats(d).collect()
    assert [r["doc_id"] for r in got if r["kept"]] == [0] and len(got) == 10
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(d).collect()}
    assert set(p) <= set(cut[0].split()) and all(len(set(p) & set(cut[i].split())) <= 3 for i in [*range(1, 9), None])
    assert 33 + 40 <= len(cut[3].split()) <= 33 + 40 + 3


@pytest.mark.parametrize("n", [150, 1500])
def test_hot_group(spark, n):
    """A passage that many documents have, edited in each: pairs that are compared grow with the members, not their square."""
    from versewright.llm import common

    rnd = random.Random(n)
    p = [f"p{i}" for i in range(100)]
    rows = []
    for i in range(n):
        q = list(p)
        for _ in range(2):
            q[rnd.randrange(100)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join([f"a{rnd.randrange(10**6)}" for _ in range(20)] + q)))
    seen, keep = {}, common.stored

    def stored(df, name):
        t = keep(df, name)
        if name == "pairs":
            seen[name] = seen.get(name, 0) + t.count()
        return t

    common.stored = stored
    try:
        got = substring_dedup.repeats(_frame(spark, rows)).collect()
    finally:
        common.stored = keep
    assert len({r["doc_id"] for r in got}) >= 0.95 * n
    assert seen.get("pairs", 0) <= 12 * n


def test_given_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    _check(rows, op1_substring_dedup(spark, SF).collect(), 0.97)


def test_edges(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, p), (4, p), (None, p), (5, p.upper()), (6, "w1 w2")]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, key int, cluster string")
    got = sorted((str(r["doc_id"]), r["start_word"], r["n_words"], r["kept"]) for r in substring_dedup.repeats(d).collect())
    assert got == [("4", 0, 60, True), ("5", 0, 60, False), ("None", 0, 60, False)]
    out = substring_dedup.without_repeats(d)
    assert out.columns == d.columns and sorted(str(r["text"]) for r in out.collect()) == sorted(map(str, [None, "", " \n\t", p, p, "", "", "w1 w2"]))
    assert substring_dedup.repeats(d.limit(0)).collect() == []
