"""The label model against one that goes from document to document, and the scorer against a plain sum."""

import math
import random

from tests.conftest import SF
from versewright.llm import weak_labels


def by_rows(rows, rounds=300):
    """Expectation-maximisation with a posterior for each document."""
    post = [1 / (1 + math.exp(3 * r.count("b") - 0.5 * r.count("g"))) for r in rows]
    for _ in range(rounds):
        good = (sum(post) + 1) / (len(rows) + 2)
        chance = []
        for j in range(len(rows[0])):
            n = {c: [0.5, 0.5] for c in "gb-"}
            for r, p in zip(rows, post):
                n[r[j]][0] += p
                n[r[j]][1] += 1 - p
            whole = [sum(x[i] for x in n.values()) for i in (0, 1)]
            chance.append({c: (x[0] / whole[0], x[1] / whole[1]) for c, x in n.items()})
        new = []
        for r in rows:
            odds = math.log(good / (1 - good)) + sum(math.log(chance[j][c][0] / chance[j][c][1]) for j, c in enumerate(r))
            new.append(1 / (1 + math.exp(-max(-60, min(60, odds)))))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        if done:
            break
        post = new
    return chance, good, post


def test_estimates_equal_those_by_rows():
    rnd = random.Random(11)
    rows = []
    for _ in range(400):
        good = rnd.random() < 0.7
        rows.append("".join("-" if rnd.random() < 0.3 else "gb"[(rnd.random() < a) != good] for a in (0.9, 0.8, 0.75)))
    n = {}
    for r in rows:
        n[r] = n.get(r, 0) + 1
    got, share, post = weak_labels.estimate(n)
    want, good, each = by_rows(rows)
    assert abs(share - good) < 1e-6
    assert all(abs(a - b) < 1e-6 for g, w in zip(got, want) for c in "gb-" for a, b in zip(g[c], w[c]))
    assert all(abs(post[r] - p) < 1e-6 for r, p in zip(rows, each))


def test_scores_are_plain_means(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    w, b, accuracy, good = model = weak_labels.train(docs)
    assert len(accuracy) == len(weak_labels.LABELLERS) and 0 < good < 1
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in weak_labels.scored(docs, model).collect():
        words = texts[r["doc_id"]].split()
        x = b + sum(float(w[f]) for word in words for f in weak_labels.features(word)) / max(1, len(words))
        assert abs(r["score"] - 1 / (1 + math.exp(-x))) < 1e-3 and r["kept"] == (r["score"] >= 0.5)
