"""Benchmark items whose parts stand in another order, and documents shorter than an item."""

import random
from collections import Counter

from versewright.llm import decontamination

ITEM = [f"i{n}" for n in range(59)]


def _similarity(a, b):
    a, b = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    n = sum((a & b).values())
    return n / max(1, sum(a.values()) + sum(b.values()) - n)


def _best(w, item):
    span = min(len(w), len(item))
    return max(_similarity(w[s : s + span], item) for s in range(len(w) - span + 1))


def _check(spark, docs, items):
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(d, b).collect()}
    assert set(got) == {(i, j) for i, w in docs.items() for j, x in items.items() if _best(w, x) >= 0.8}
    for (i, j), r in got.items():
        assert abs(r["similarity"] - _best(docs[i], items[j])) < 1e-9 and r["n_words"] == min(len(docs[i]), len(items[j]))
    return got


def test_parts_in_another_order(spark):
    rnd = random.Random(3)
    around = lambda n: [f"x{rnd.randrange(10**6)}" for _ in range(n)]
    docs = {n: around(40) + ITEM[c:] + ITEM[:c] + around(40) for n, c in enumerate((0, 10, 20, 29, 30, 45))}
    docs |= {10: around(30) + ITEM[:25] + around(1) + ITEM[25:] + around(30), 11: around(30) + ITEM[40:] + ITEM[20:40] + ITEM[:20] + around(30)}
    docs |= {12: ITEM[29:] + ITEM[:29], 13: around(200) + ITEM[:30], 14: ["same"] * 80}
    items = {1: ITEM, 2: ITEM[:40], 3: ["same"] * 30, 4: around(40), 5: ITEM[29:] + ITEM[:29]}
    got = _check(spark, docs, items)
    assert (3, 1) in got and (12, 1) in got and (13, 1) not in got


def test_documents_shorter_than_the_item(spark):
    docs = {1: ITEM[:-1], 2: ITEM[1:-1], 3: ITEM[:50], 4: ITEM[:45], 5: ITEM[:4], 6: ITEM[3:], 7: ITEM[:-1] + ITEM[:1]}
    got = _check(spark, docs, {1: ITEM, 2: ITEM[:12]})
    assert (1, 1) in got and (4, 1) not in got and not any(i == 5 for i, _ in got)
