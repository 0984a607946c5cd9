import pytest
from pyspark.sql import functions as F

from versewright.functions import quotes as Q


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column).collect()]


def test_straight_quotes_by_context(spark):
    yes = F.lit(True)
    assert one(spark, Q.straight_converted(F.col("x"), yes), 'اس نے کہا "آؤ" پھر', "it's", None) == ["اس نے کہا ”آؤ“ پھر", "it's", None]
    assert one(spark, Q.straight_converted(F.col("x"), F.lit(False)), '"a"') == ['"a"']


def test_repair(spark):
    assert one(spark, Q.repaired(F.col("x"), F.lit(False)), "End. ”Start", "’’a‘‘") == ["End. “Start", "“a”"]
    got = one(spark, Q.repaired(F.col("x"), F.lit(True)), "کہا “آؤ” پھر")
    assert got == ["کہا ”آؤ“ پھر"] and one(spark, Q.repaired(F.col("x"), F.lit(True)), *got) == got


def test_closers(spark):
    assert one(spark, Q.closers_paired(F.col("x")), "“Come here.‘", "“a ’b‘ c”", None) == ["“Come here.”", "“a ’b‘ c”", None]


@pytest.mark.parametrize("first,text,want", [
    (1, "one. 2 two", [(1, "one."), (2, "two")]),
    (1, "one 2 two", [(1, "one 2 two")]),
    (3, "three 4. four 5.five", [(3, "three"), (4, "four"), (5, "five")]),
    (1, "1. one \\v 2 two", [(1, "one"), (2, "two")]),
    (1, "had 2 2 two", [(1, "had"), (2, "two")]),
    (7, "", [(7, "")]),
])
def test_merged_verses(first, text, want):
    assert Q.split_verses(first, text) == want


def test_split_lines(spark):
    assert one(spark, Q.verses_split(F.col("x")), r"\v 1 one. 2 two", r"\v 1 one", "plain 2.", None) == [r"\v 1 one. \v 2 two", r"\v 1 one", "plain 2.", None]


def test_numbers(spark):
    assert spark.sql("select 1").select(Q.decimal_suffix(F.lit(8), F.lit(38)), Q.decimal_suffix(F.lit(3), F.lit(38))).first()[:] == (True, False)
