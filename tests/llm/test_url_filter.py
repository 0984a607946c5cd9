"""Rules, features, training and verdicts against plain versions; held-out hosts; SQL."""

import math
import re

import duckdb
import pytest

from tests.conftest import SF
from versewright.llm import url_filter as u
from versewright.llm.queries import op13_url_filter, oracle_sql

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def hashes(url):
    out = set()
    for part, text in enumerate(parts(url)):
        c = [2, *map(ord, text), 3]
        for n in u.SIZES:
            for i in range(len(c) - n + 1):
                h = 0
                for x in c[i : i + n]:
                    h = h * u.BASE + x
                out.add((h + 10007 * (2 * n + part)) % u.BUCKETS)
    return out


def train(rows):
    rows = sorted(rows)
    x, y = [hashes(a) for a, _ in rows], [b for _, b in rows]
    alike = [[len(a & b) / math.sqrt(len(a) * len(b)) + u.CONSTANT**2 for b in x] for a in x]
    s = [0.0] * len(x)
    for _ in range(u.ROUNDS):
        f = [sum(a * b for a, b in zip(k, s)) for k in alike]
        s = [a + u.STEP * (t - 1 / (1 + math.exp(-z))) for a, t, z in zip(s, y, f)]
    weights = {}
    for a, share in zip(x, s):
        for h in a:
            weights[h] = weights.get(h, 0) + round(share / math.sqrt(len(a)) * u.UNIT)
    return sum(round(a * u.CONSTANT**2 * u.UNIT) for a in s), weights


def judge(url, model):
    host, path = parts(url)
    fit = [r for r in u.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fit:
        h, p, verdict = max(fit, key=lambda r: len(r[0] + r[1]))
        return host, path, h + p, verdict
    x = hashes(url)
    return host, path, None, "block" if sum(model[1].get(h, 0) for h in x) + model[0] * math.sqrt(len(x)) > 0 else "allow"


@pytest.fixture(scope="module")
def model():
    return train(u.labelled_rows())


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/x", "http://com/", "http://a.com", "http://a.com/", "http://acom/", "http://example.com/en/1", "http://www.example.com/en/", "http://x.www.example.com/en/z?q#f",
    "http://WWW.EXAMPLE.COM/EN/", "http://www.example.com/en", "ftp://a.net/es/", "http://net/fr/", "http://a.net/fr", "http://cheap-bets.org/", "http://ÄÖ.é😀.org/ß/😀?x", "a://b://c.net/es/", "http://h.org:80/x//y", "http://h.org?x=/en/", "http://h.org#://net/es/",
    "http://h.org/a\nb", "http://free-casino.net/es/1", "http://free-casino.net/de/1",
]


def test_training_against_a_plain_version(spark, model):
    constant, weights = u.fit(u.labelled(spark))
    assert abs(constant - model[0]) <= 2 * len(u.labelled_rows()) and weights.keys() == model[1].keys()
    assert max(abs(weights[h] - w) for h, w in model[1].items()) <= 2 * len(u.labelled_rows())


def test_verdicts_against_a_plain_version(spark, model):
    rows = [(i, x, "h", 0) for i, x in enumerate(URLS)] + [(None, URLS[-1], "h", 0), (3, URLS[9], "h", 0), (3, URLS[9], "h", 0), (99, "http://long.org/" + "casino/" * 20_000, "h", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, x int")
    got = sorted((tuple(r) for r in u.judged(pages).collect()), key=str)
    assert got == sorted(((i, *judge(x, model)) for i, x, _, _ in rows), key=str)
    assert u.judged(pages.limit(0)).collect() == []


def test_query(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = sorted(tuple(r) for r in op13_url_filter(spark, SF).collect() if r["page_id"] is not None)
    assert [r[:3] + r[4:] for r in got] == [(i, *parts(x), judge(x, model)[3]) for i, x in sorted((r["page_id"], r["url"]) for r in pages.collect())]
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    assert got == sorted(db.execute(oracle_sql()["op13_url_filter"]).fetchall())


def test_held_out_hosts(spark):
    """Names that the labelled table doesn't hold, of the kinds it has; none was used to choose its form or the parameters."""
    bad = ["royal-casino", "pokerstars4", "sport-bets", "diet-pills", "payday-loans", "adult-dating", "porn-tube", "spam-king", "banner-ads", "ip-track", "buy-viagra", "warez-bay", "mega-jackpot", "paid-clicks", "casinoland", "freepoker"]
    good = ["sea-museum", "town-library", "herb-garden", "night-school", "storm-weather", "kitchenware", "oral-history", "opera-theatre", "rocket-science", "rail-travel", "riverboat", "stock-market", "village-green", "newspress", "dumora", "palvenik"]
    t = spark.createDataFrame([(i, f"https://{h}.example.org/de/{i}") for i, h in enumerate(bad + good)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in u.judged(t, rules=()).collect()}
    right = [(got[i] == "block") == (i < len(bad)) for i in range(len(got))]
    print("held out:", sum(right[: len(bad)]), sum(right[len(bad) :]))
    assert sum(right) >= 0.8 * len(right) and sum(right[len(bad) :]) >= 0.9 * len(good), [n for n, ok in zip(bad + good, right) if not ok]


def test_labelled_tables(spark):
    t = spark.createDataFrame([("http://h.org/", None), (None, 1)], "url string, label int")
    assert u.fit(t) == (0, {}) == u.fit(t.limit(0))
    p = spark.createDataFrame([(1, "http://casino.org/")], "page_id long, url string")
    assert [r["verdict"] for r in u.judged(p, table=t).collect()] == ["allow"]
    with pytest.raises(ValueError):
        u.fit(spark.range(u.LABELLED_MOST + 1).selectExpr("concat('http://h', id, '.org/') as url", "1 as label"))
