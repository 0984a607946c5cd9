"""Classes are those of all pairs that met and hold, whichever member leads."""

import random

from pyspark.sql import functions as F

from versewright.llm import common

APART = lambda s, x, t, y: F.lit(False)


def near(most):
    @F.pandas_udf("boolean")
    def holds(x, y):
        return (x - y).abs() <= most

    return holds


def classes(spark, buckets, at, most=1):
    b = spark.createDataFrame([(n, i, 1, 0) for n, m in buckets.items() for i in m], "bucket long, id long, size int, bits long")
    return {r["id"]: r["root"] for r in common.linked(b, spark.createDataFrame(list(at.items()), "id long, x long"), near(most), APART).collect()}


def wanted(buckets, at, most=1):
    low = {}
    find = lambda i: i if low.get(i, i) == i else find(low[i])
    some = set()
    for m in buckets.values():
        for i in m:
            for j in m:
                if i < j and abs(at[i] - at[j]) <= most:
                    some |= {i, j}
                    a, b = sorted((find(i), find(j)))
                    low[b] = a
    return {i: find(i) for i in some}


def test_members_that_no_leader_is_like(spark):
    """A chain in one bucket: hardly any member is like the leader, all are like the next one."""
    at = {i: i for i in range(30)}
    assert classes(spark, {1: list(at)}, at) == dict.fromkeys(at, 0)


def test_random_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 7)
    rnd = random.Random(5)
    at = {i: rnd.randrange(300) for i in range(120)}
    buckets = {n: rnd.sample(sorted(at), rnd.choice((2, 3, 40))) for n in range(12)}
    assert classes(spark, buckets, at) == wanted(buckets, at)
    assert classes(spark, {1: [0, 1], 2: [3]}, {0: 0, 1: 9, 3: 0}) == {}
