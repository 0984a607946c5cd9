"""The conversion in columns against the same from paragraph to paragraph, on random documents."""

import random

import pytest
from pyspark.sql import functions as F

from tests import rowwise
from versewright.operators import conversion

ALIASES = ["genesis", "exodus", "Ruth", "کتاب"]
WORDS = ["light", "and", "he", "said", "Water", "over", "earth", "روشنی", "Свет", "ended", "Aa", "bb lamp"]


def text(rnd):
    n, m = rnd.randrange(0, 14), rnd.randrange(1, 14)
    say = lambda k=5: " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, k + 1))) + rnd.choice(["", ".", "!", ",", "”", ":", ". "])
    digits = lambda x: str(x).translate(str.maketrans("0123456789", rnd.choice(["0123456789", "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"])))
    return rnd.choice([
        lambda: "Genesis", lambda: "Exodus", lambda: "EXODUS ", lambda: "Book of Ruth (Ruth)", lambda: "2 Kings", lambda: "translation", lambda: "of the people",
        lambda: f"Chapter {m}", lambda: f"Chapter {m}", lambda: f"باب {digits(m)}", lambda: "Chapter 0", lambda: f"Genesis Chapter {m}", lambda: f"Глава {m} ",
        lambda: rf"\v {digits(n)}", lambda: f"{digits(n)}.", lambda: f"/v {n}", lambda: f"- v {n} -", lambda: str(n),
        lambda: rf"\v {n} {say()}", lambda: rf"\V {digits(m)}. {say()}", lambda: rf"\v {n} {say()} \v {m} {say()}", lambda: rf"\v {m} \v {n}", lambda: rf"\v {m} {say()} \v {m + 1}", lambda: f"v/ {m} {say()}",
        lambda: f"{n}. {say()}", lambda: f"{digits(m)} {say()}", lambda: f"{m} {say()} {m + 1} {say()}", lambda: f"{m}. {say()}. {m + 1}. {say()}", lambda: f"{m}{say()}", lambda: f'"{m} {say()}', lambda: f"{n} \\v {m}",
        lambda: say(9), lambda: say(9), lambda: say(9), lambda: say(3), lambda: f"{say()} \\v {m}", lambda: "...", lambda: "Aa ab", lambda: "",
        lambda: f"{m} {say()}. Chapter {m + 1} 1. {say()}", lambda: f"{say()}. Chapter {m} 1. {say()} Chapter {m + 1} 2. {say()}", lambda: f"{say(3)}. Book of Ruth (Ruth) {m} {say()}", lambda: f"{say(2)}. 1 Kings the First (1 Kings) Chapter 1",
    ])()


def clean(spark, texts):
    """What the row-by-row version is given: paragraphs as the library sets their spacing."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", conversion.strip(conversion.T.paragraph_text(F.col("t"))).alias("t")).orderBy("i").collect()
    return [r["t"] for r in rows]


@pytest.mark.parametrize("keep,book", [(False, None), (True, None), (True, "Exodus"), (False, "Genesis")])
def test_random_documents(spark, keep, book):
    rnd = random.Random(f"{keep}{book}")
    docs = []
    for i in range(150):
        body = [text(rnd) for _ in range(rnd.randrange(1, 28))]
        docs.append(body if i % 5 == 0 or book else ["Genesis", "Chapter 1", *body])
    if not keep:
        docs[0] = ["Genesis", "Chapter 1", *(f"{i}. verse" if i % 3 else "more words" for i in range(1, 190))]
    flat = [t for d in docs for t in d]
    shown, at = clean(spark, flat), 0
    rows, want = [], {}
    for no, body in enumerate(docs):
        listed = [rnd.random() < 0.3 for _ in body]
        rows += [(f"d{no}", i, t, x) for i, (t, x) in enumerate(zip(body, listed))]
        want[f"d{no}"] = rowwise.convert(list(zip(shown[at : at + len(body)], listed)), ALIASES, keep, book)
        at += len(body)
    d = spark.createDataFrame(rows, "doc_id string, para_no int, text string, is_numbered boolean").repartition(3)
    lines, issues = conversion.from_shape(d, ALIASES, keep, book)
    got, found = {k: [] for k in want}, {k: [] for k in want}
    for r in lines.orderBy("doc_id", "line_no").collect():
        got[r["doc_id"]].append(r["line"])
    for r in issues.collect():
        found[r["doc_id"]].append((r["code"], r["found"]))
    for k, (a, b) in want.items():
        assert got[k] == a, (k, docs[int(k[1:])])
        assert sorted(found[k]) == sorted(b), (k, docs[int(k[1:])])


def test_nothing(spark):
    d = spark.createDataFrame([("d", 1, None, None), ("d", 2, " ", True)], "doc_id string, para_no int, text string, is_numbered boolean")
    for rows in (d, d.limit(0)):
        lines, issues = conversion.from_shape(rows, [])
        assert lines.collect() == [] == issues.collect()
