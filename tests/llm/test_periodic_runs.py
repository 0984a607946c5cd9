"""Periodic runs against all periods of all places, and the query against its contract."""

import hashlib
import random
import re
import zlib

import pytest

from tests.conftest import SF
from versewright.llm import periodic_runs as pr

COLS = "doc_id long, text string, runs int, collapsed int, `start` int"


def brute(w, least=12):
    """Every maximal stretch by every period; of equal stretches the smallest period."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def stay(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def some_texts():
    rnd = random.Random(5)
    out = [[], ["a"] * 11, ["a"] * 12, ["a"] * 300, ["a", "b"] * 6, ["a", "b", "c", "d", "e", "f"] * 2, list("abcdefg") * 2, list("abcdefg") + list("abcdef")]
    a, b = ["x"], ["x", "y"]
    for _ in range(9):
        a, b = b, b + a  # a Fibonacci word has many runs
    out.append(b)
    for _ in range(250):
        w = [rnd.choice("abcd"[: rnd.randrange(1, 5)]) for _ in range(rnd.randrange(0, 90))]
        for _ in range(rnd.randrange(0, 3)):
            at, unit = rnd.randrange(len(w) + 1), [rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 20))]
            w[at:at] = (unit * 6)[: rnd.randrange(1, 5 * len(unit))]
        out.append(w)
    return out


def test_all_runs_of_many_texts():
    texts = some_texts()
    assert sum(len(brute(w)) for w in texts) > 150
    for least in (12, 7, 2):
        got = pr.analyse([" ".join(w) for w in texts], least)
        for w, (runs, words) in zip(texts, got):
            assert runs == brute(w, least) and words == stay(w, runs)


def test_words_outside_the_mask_are_in_no_run():
    w = [f"w{i}" for i in range(40)] + list("abcdefg") * 3 + [f"v{i}" for i in range(40)]
    import numpy as np

    x = np.array([hash(t) % 10**9 for t in w])
    keep = pr.survivors(x, np.zeros(len(w), np.int64), 6)
    assert keep.tolist() == [40 <= i < 61 for i in range(len(w))]


def test_a_collision_is_found(monkeypatch):
    real = pr.mixed
    calls = []
    monkeypatch.setattr(pr, "mixed", lambda h: (calls.append(1), h * 0 if len(calls) <= 3 else real(h))[1])
    import numpy as np

    x = np.array(list(range(20)) + [1, 2, 3] * 8)
    got = pr.find(x, np.array([0]), np.array([len(x)]))
    assert [tuple(r) for r in got.tolist()] == [(20, 44, 3)]


def test_a_long_text_of_one_word_and_of_two_halves():
    n = 60_000
    half = [f"u{i}" for i in range(9_000)]
    (one, kept), (two, words) = pr.analyse([" ".join(["same"] * n), " ".join(half + half)])
    assert one == [(0, n, 1)] and kept == ["same"] and two == [(0, 18_000, 9_000)] and words == half


def test_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from versewright.llm.queries import op11_periodic_runs

    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, SF).collect()}
    assert len(got) == docs.count()
    some = 0
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        if n > 1500 and h % 10:
            continue  # the plain version is square in the words
        runs = brute(w)
        some += bool(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        x = got[r["doc_id"]]
        assert (x["n_runs"], x["start"], x["length"], x["period"]) == (len(runs), *best)
        assert x["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(" ".join(stay(w, runs)).encode()).hexdigest()
    assert some > 20


def test_edges(spark):
    long = "x y z " * 30_000
    rows = [(1, None), (2, ""), (3, "a " * 12), (3, "a " * 12), (None, "b\tc " * 6), (None, None), (4, long), (5, " \n  é😀")]
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], COLS)
    got = pr.digests(pr.periodic_runs(docs)).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]))
    assert by[1] == by[2] == by[5] == [(0, None, None, None, None)] and by[3] == [(1, 0, 12, 1, 12000)] * 2
    assert sorted(by[None], key=str) == [(0, None, None, None, None), (1, 0, 12, 2, 6000)] and by[4] == [(1, 0, 90_000, 3, 30_000_000)]
    assert {r["runs_sha256"] for r in got if r["doc_id"] in (1, 2)} == {nothing} == {r["collapsed_sha256"] for r in got if r["doc_id"] in (1, 2)}
    assert pr.periodic_runs(docs.limit(0)).collect() == []
    assert pr.planted(docs).count() == len(rows)
