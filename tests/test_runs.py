"""Edits of joined texts against the joined text, markers over runs, paragraphs parted."""

import random

from pyspark.sql import functions as F

from versewright.operators import runs


def run(text, style="s", up=False, kind="text"):
    return {"text": text, "style": style, "superscript": up, "kind": kind}


def paragraphs(spark, *rows):
    return spark.createDataFrame([("d", i, b, t, r) for i, (b, t, r) in enumerate(rows)], f"doc_id string, para_no int, book string, is_title boolean, runs array<{runs.RUN}>")


def test_edits_go_back_to_their_runs():
    rnd = random.Random(1)
    for _ in range(300):
        texts = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 5))) for _ in range(rnd.randrange(1, 8))]
        whole, at, edits = "".join(texts), 0, []
        while at <= len(whole) and len(edits) < 4:
            place = rnd.randrange(at, len(whole) + 1)
            length = rnd.randrange(0, len(whole) - place + 1)
            edits.append((place, length, rnd.choice(["", "X", "YY"])))
            at = place + length + 1
        want, now = "", 0
        for place, length, new in edits:
            want, now = want + whole[now:place] + new, place + length
        o = runs.Offsets(texts)
        got = o.edited(edits)
        assert "".join(got) == want + whole[now:] and len(got) == len(texts)
        for i, (a, b) in enumerate(zip(texts, got)):  # runs that no edit touches stay
            lo, hi = o.starts[i], o.starts[i + 1]
            if all(p + n <= lo and p < lo or p >= hi and p != len(whole) or (p + n < lo) for p, n, _ in edits):
                assert a == b


def test_marker_case_over_runs(spark):
    d = paragraphs(spark, (None, False, [run("x \\"), run("V", "t"), run(" 3 y \\V"), run("12"), run("9", kind="footnote"), run("\\Vx")]), (None, False, None))
    got = [r[0] for r in d.orderBy("para_no").select(runs.marker_case(F.col("runs"))).collect()]
    assert [(r["text"], r["style"], r["kind"]) for r in got[0]] == [("x \\", "s", "text"), ("v", "t", "text"), (" 3 y \\v", "s", "text"), ("12", "s", "text"), ("9", "s", "footnote"), ("\\Vx", "s", "text")] and got[1] is None


def test_paragraphs_by_chapter_and_verse(spark):
    gap = run("", None, kind="break")
    d = paragraphs(
        spark, ("GEN", False, [run("1 before a chapter"), gap, run("2 still")]), ("GEN", False, [run("Chapter 1"), gap, run("1 one"), gap, run("more", "i"), gap, run("9 too many"), gap, run("2 two")]),
        ("GEN", False, [run("3", "n", True), run("3"), run(". three "), run("4", "n", True), run("4 four")]), ("GEN", False, [run("5", "n", True), run("no number")]), ("GEN", True, [run("Exodus")]), ("EXO", False, [run("1 a"), gap, run("2 b")]),
        ("EXO", False, [run(" ")]), ("EXO", False, [run("Chapter 2"), gap, run("77 any"), gap, run("38", "n", True), run("۸. short")]),
    )
    v = spark.createDataFrame([("GEN", 1, 8)], "book string, chapter int, max_verse int")
    got = {(r["para_no"], r["part"]): (r["changed"], [(x["text"], x["kind"] == "break", x["superscript"]) for x in r["runs"]]) for r in runs.restructured(d, v).collect()}
    text = lambda k: ("/".join("|" if b else t for t, b, _ in got[k][1]), got[k][0])
    assert text((0, 0)) == ("1 before a chapter/|/2 still", False)
    assert [text((1, i)) for i in range(3)] == [("Chapter 1", True), ("1 one/|/more/|/9 too many", True), ("2 two", True)]
    assert [text((2, i)) for i in range(2)] == [("3// three ", True), ("4/ four", True)]
    assert text((3, 0)) == ("5/no number", False) and got[3, 0][1][0][2] is True and text((4, 0)) == ("Exodus", False)
    assert text((5, 0)) == ("1 a/|/2 b", False) and (6, 0) not in got
    assert [text((7, i)) for i in range(3)] == [("Chapter 2", True), ("77 any", True), ("38/ short", True)] and not any(up for _, r in (got[7, 2],) for _, _, up in r)
    assert len(got) == 12


def test_whole_paragraphs(spark):
    d = spark.createDataFrame([("d", 1, 1, [run("b")]), ("d", 1, 0, [run("a")])], f"doc_id string, para_no int, sub_no int, runs array<{runs.RUN}>")
    assert [x["text"] + x["kind"] for x in runs.whole(d).first()["runs"]] == ["atext", "break", "btext"]
