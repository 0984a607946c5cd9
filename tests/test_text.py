import pytest
from pyspark.sql import functions as F

from versewright.functions import text as T

CASES = [
    ("Come here !", "Come here!"),
    ("Really?.", "Really?"),
    ("End. . Next", "End. Next"),
    ("wait ... more", "wait... more"),
    (r"\v 3. Text", r"\v 3 Text"),
    ("see( note )now", "see (note)now"),
    ("why?because", "why? because"),
    ("a , b ; c", "a, b; c"),
]


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_spacing_and_idempotence(spark):
    rules = T.apply(T.COMMON, F.col("x"))
    got = one(spark, rules, *[c[0] for c in CASES])
    assert got == [c[1] for c in CASES]
    assert one(spark, rules, *got) == got


def test_null_text_stays_null(spark):
    assert cleaned(spark, None, "") == [None, ""]
    assert cleaned(spark, None, "", language="ur") == [None, ""]


def test_straight_quotes_toggle(spark):
    assert one(spark, T.toggled(F.col("x")), "\"a\" and \"b\"", "don't 'x'", None) == ["”a“ and ”b“", "don't ’x‘", None]


def test_controls_bom_bidi(spark):
    assert one(spark, T.apply((T.BOM, T.CONTROLS, T.BIDI), F.col("x")), "﻿﻿a\x01b\tc‏\x7f") == ["ab\tc"]


def cleaned(spark, *values, language=None):
    d = spark.createDataFrame([(i, v, language) for i, v in enumerate(values)], "i int, x string, l string")
    return [r[0] for r in T.clean_text(d, "x", "l").orderBy("i").select("cleaned").collect()]


CLEANED = [
    ("12 v. text", r"\v 12 text"), ("v 7. text", r"\v 7 text"), ("x-7 v. text", r"x- \v 7 text"), ("(7 v. text", r"(\v 7 text"), ("۱۲ v. text", r"\v 12 text"),
    (r"\v 5 5. text", r"\v 5 text"), (r"\v 5 ۵. x", r"\v 5 x"), (r"\v 5 6. text", r"\v 5 6. text"), ("\\v 1 ا. x", r"\v 1 x"), ("\\v 21 ا2. x", r"\v 21 x"),
    ("\\v 4 \u2060\u2060 text", r"\v 4 text"), ("line one\n. next", "line one\n. next"), ("a ,b\r\nc ,d", "a,b\r\nc,d"), ("باب12", "باب 12"),
    ("latin (a )\nکتاب \"x\"", "latin (a)\nکتاب ”x“"), (r"\v 1 one. 2 two", r"\v 1 one. \v 2 two"), ("End. ”Start", "End.” Start"), ("\ufeffa\x01b", "ab"),
]


def test_cleaner_and_idempotence(spark):
    got = cleaned(spark, *[c[0] for c in CLEANED])
    assert got == [c[1] for c in CLEANED]
    assert cleaned(spark, *got) == got


def test_chains_stay_small(spark):
    """A filter on the cleaned text doesn't make the plan grow with the number of stages."""
    d = T.clean_text(spark.createDataFrame([("a ,b",)], "x string"), "x").where("cleaned like '%b'").where("length(cleaned) > 1")
    assert len(d._jdf.queryExecution().optimizedPlan().toString()) < 100_000 and d.count() == 1


def test_kalasha(spark):
    assert cleaned(spark, "a’b c ’d", language="kls-PK") == ["a`b c`d"]


@pytest.mark.parametrize("text,start,want", [("7. foo، 3. bar", 7, "foo، 3. bar"), ("foo) 3. bar", 1, "foo) bar"), ("3. a. 4) b", 3, "a. b"), ("x 12. y", 1, "x 12. y"), ("“۳۔ y", 1, "“۳۔ y")])
def test_visible_numbers(spark, text, start, want):
    d = spark.createDataFrame([(text, start)], "x string, n int")
    assert d.select(T.visible_numbers_removed(F.col("x"), F.col("n"))).first()[0] == want


def test_numbers(spark):
    assert one(spark, T.script_number(F.col("x")), "۱۲", "٣", "7", "0", "x", None) == [12, 3, 7, None, None, None]


@pytest.mark.parametrize("text,tag,want", [("کتاب", None, True), ("book", "ur", False), ("12", "ur-PK", True), ("12", "ur-Latn", False), ("12", "az-Arab", True), ("12", None, False), ("12", " ur", True), ("12", "Arab", True), ("12", "ar-1994", False), ("12", "--ur", True)])
def test_quote_convention(spark, text, tag, want):
    d = spark.createDataFrame([(text, tag)], "x string, t string")
    assert d.select(T.arabic_quotes(F.col("x"), F.col("t"))).first()[0] is want


def test_whole_words(spark):
    assert one(spark, T.words_replaced(F.col("x"), {"cat": "dog"}), "cat concat cat_a cat.") == ["dog concat cat_a dog."]


def test_changes_are_found(spark):
    d = spark.createDataFrame([("Wait , now",)], "text string")
    s = T.staged(d, T.SPACING)
    assert s.where("s0 <> s9").count() == 1


@pytest.mark.parametrize("arabic,rules", [(False, T.QUOTES), (True, T.ARABIC_QUOTES)])
def test_texts_without_quotes_skip_the_rules(spark, arabic, rules):
    texts = ("plain, text.", "a “ b ”c", "x ’’y‘‘.", "a ”b“۔", "say \"it's\" 'now'", None, "")
    assert one(spark, T.quoted(F.col("x"), arabic), *texts) == one(spark, T.apply(rules, F.col("x")), *texts)
