"""The audit against every pair and every term, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb

from tests.conftest import SF
from versewright.llm import source_audit as sa
from versewright.llm.queries import op12_source_audit, oracle_sql

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    """rows (text, lang, source): every term of every pair."""
    n, df = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        n[g].update(w)
        df[g[0]].update(set(w))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {a for a, _ in groups}:
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        share = {}
        whole = Counter()
        for g in (x for x in groups if x[0] == lang):
            total = sum(n[g][t] for t in kept)
            share[g[1]] = {t: 1 + 10**9 * (n[g][t] + 2) // (total + 2 * len(kept)) for t in kept}
            whole.update({t: n[g][t] for t in kept})
        all_ = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole.values()) + 2 * len(kept)) for t in kept}
        for a in share:
            pair = sorted((-sum(f(share[a][t], share[b][t]) for t in kept), b.encode(), b) for b in share if b != a)
            out += [(lang, a, "pair", b, -v, i + 1) for i, (v, _, b) in enumerate(pair)]
            term = sorted((-f(share[a][t], all_[t]), t.encode(), t) for t in kept if n[lang, a][t] and share[a][t] > all_[t])
            out += [(lang, a, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(term[:top])]
    return sorted(out)


def rows_of(rnd, n, sources, words):
    return [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 30))), rnd.choice(["en", "de"]), rnd.choice(sources)) for _ in range(n)]


def check(spark, rows, **kw):
    df = spark.createDataFrame([(t, a, b, 0, "x", 1) for t, a, b in rows], "text string, lang string, source string, n int, term string, v int").repartition(3)
    got = sorted(tuple(r) for r in sa.audit(df, **kw).collect())
    assert got == brute(rows, **{{"least_docs": "least", "top": "top"}[k]: v for k, v in kw.items()})
    return got


def test_against_every_pair(spark):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("Ä", "x", "ß", "É", "Q")]
    rows = rows_of(rnd, 400, ["s0"] * 5 + [f"s{i}" for i in range(9)], words + words[:5] * 20)
    rows += [("only here " * 3, "en", "lone")] * 12 + [(None, "en", "silent"), ("", "xx", "a"), ("1 2 3", "xx", "b"), ("few words", "yy", "one"), (None, None, None), ("Zebra", None, "s1"), ("don't STOP_now", "en", None)] + rows[:7]
    got = check(spark, rows)
    assert any(r[2] == "term" and r[1] == "lone" for r in got) and ("xx", "a", "pair", "b", 0, 1) in got and not any(r[0] == "yy" for r in got)


def test_ties_and_few_documents(spark):
    rows = [(" ".join(f"t{c}" for c in "abcdefghijklmnopqrst"), "en", f"s{i % 4}") for i in range(8)] + [("tz tz", "en", "s1")]
    check(spark, rows, least_docs=1, top=3)
    check(spark, rows, least_docs=2, top=25)


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(sa, "TILE", 3)
    monkeypatch.setattr(sa, "TILES", 2)
    rnd = random.Random(8)
    rows = rows_of(rnd, 200, [f"s{i:02}" for i in range(17)], list("abcdefgh"))
    want = {(r[0], r[1], r[3]): r[4] for r in brute(rows) if r[2] == "pair"}
    import pyarrow as pa  # the workers' tiles, without Spark

    lists = [[{"no": i, "p": 10**8 + 7 * i * k, "z": 10**7} for i in range(k, 17, k)] for k in (1, 2, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array([1, 2, 3]), pa.array(lists, pa.list_(pa.struct([("no", pa.int64()), ("p", pa.int64()), ("z", pa.int64())])))], ["lang", "m", "v"])
    total = Counter()
    for part in sa._within(iter([batch, batch])):
        for r in part.to_pylist():
            total[r["a"], r["b"]] += r["value"]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    plain = Counter()
    for m, v in zip((1, 2, 3), lists):
        for x in v:
            for y in v:
                plain[x["no"], y["no"]] += 2 * m * (f(x["p"], y["p"]) - f(x["p"], y["z"]) - f(x["z"], y["p"]) + f(x["z"], y["z"]))
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in plain.items() if v} and want


def test_exact_shares(spark):
    t = spark.createDataFrame([(10**12, 10**13, 10**6), (0, 1, 1), (5, 10**18, 7)], "n long, total long, kept long")
    for r in t.select("*", sa.share(t["n"], t["total"], t["kept"]).alias("p")).collect():
        assert r["p"] == 1 + 10**9 * (r["n"] + 2) // (r["total"] + 2 * r["kept"])


def test_query(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted(tuple(r) for r in op12_source_audit(spark, SF).collect())
    assert got == sorted(db.execute(oracle_sql()["op12_source_audit"]).fetchall()) and len(got) > 500
    assert sa.audit(spark.read.parquet(f"{SF}/documents.parquet").limit(0)).collect() == []
