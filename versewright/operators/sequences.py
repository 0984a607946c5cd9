"""Integrity of numbered sequences, and what depends on the order of rows.

Keys, numbers and orders are arguments, so the same functions check verses within chapters and lines within
orders. Orders must be total: Spark doesn't keep the order of equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(df: DataFrame, keys: Sequence[str], number: str, order: Sequence) -> DataFrame:
    """(keys, code, number): duplicates, numbers below the one before, starts other than 1, and gaps.

    One exchange by key; a sort in the given order serves order checks, one by number the rest. Nothing is gathered.
    """
    w, byn = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(number)
    d = df.select(*keys, F.col(number).alias("number"), F.lag(number).over(w).alias("prev"), F.lag(number).over(byn).alias("below"), F.row_number().over(byn).alias("nth"))
    n, below = F.col("number"), F.col("below")
    found = lambda when, code, lo, hi: F.when(when, F.struct(F.lit(code).alias("code"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")))
    codes = F.array_compact(F.array(
        found(n < F.col("prev"), "VERSE_OUT_OF_ORDER", n, n), found(n == below, "VERSE_DUPLICATE", n, n),
        found((F.col("nth") == 1) & (n != 1), "VERSE_START_NOT_ONE", n, n), found(n > below + 1, "VERSE_SEQUENCE_GAP", below + 1, n - 1),
    ))
    e = d.select(*keys, F.explode(codes).alias("x")).select(*keys, "x.*")
    return numbers(e, [*keys, "code"], "lo", "hi", "number")


#: Numbers that one row is turned into at once.
BLOCK = 10_000


def numbers(df: DataFrame, cols: Sequence[str], lo: str, hi: str, name: str) -> DataFrame:
    """A row for each number from lo to hi, both with it; in blocks, so that a wide span is no array."""
    d = df.where(F.col(lo) <= F.col(hi)).select(*cols, F.col(hi).alias("__hi"), F.explode(F.sequence(F.col(lo), F.col(hi), F.lit(BLOCK).cast("long"))).alias("__lo"))
    return d.select(*cols, F.explode(F.sequence(F.col("__lo"), F.least(F.col("__hi"), F.col("__lo") + BLOCK - 1))).alias(name))


def by_code(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count("*").alias("n"))


def jumps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, prev, number): where the next distinct number isn't one more."""
    d = df.select(*keys, F.col(number).alias("number")).distinct()
    return d.withColumn("prev", F.lag("number").over(Window.partitionBy(*keys).orderBy("number"))).where("number <> prev + 1").select(*keys, "prev", "number")


def missing_between(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, missing): numbers between present ones."""
    d = jumps(df, keys, number).select(*keys, (F.col("prev") + 1).cast("long").alias("__a"), (F.col("number") - 1).cast("long").alias("__b"))
    return numbers(d, keys, "__a", "__b", "missing")


def continuity(df: DataFrame, keys: Sequence[str], number: str, order: Sequence) -> DataFrame:
    """(keys, code, number) of a run: RESTART, GAP, DUPLICATE, DECREASE or INVALID against the number before."""
    prev = F.lag(number).over(Window.partitionBy(*keys).orderBy(*order))
    nth = F.row_number().over(Window.partitionBy(*keys, number).orderBy(*order))
    d = df.select(*keys, F.col(number).alias("number"), prev.alias("prev"), nth.alias("nth"))
    n, p = F.col("number"), F.col("prev")
    code = F.when(n < 1, "INVALID").when(F.col("nth") > 1, "DUPLICATE").when((n == 1) & (p > 1), "RESTART").when(n < p, "DECREASE").when(n > p + 1, "GAP")
    return d.select(*keys, code.alias("code"), "number").where("code is not null")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def carried(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """df with the last value that wasn't null, up to and including this row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def neighbours(df: DataFrame, col: str, keys: Sequence[str], order: Sequence) -> DataFrame:
    """df with the nearest non-empty values before and after, as ``before`` and ``after``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    full = F.when(F.trim(col) != "", F.col(col))
    return df.withColumn("before", F.last(full, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(full, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def segments(df: DataFrame, starts: Column, keys: Sequence[str], order: Sequence, name: str = "segment_id") -> DataFrame:
    """df with a running number that goes up where a segment starts."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(starts.cast("int")).over(w).cast("long"))


def until(df: DataFrame, stops: Column, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Rows before the first one that stops its key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__stop", F.max(stops.cast("int")).over(w)).where("__stop = 0").drop("__stop")


def first_inversion(df: DataFrame, keys: Sequence[str], position: str, line: str) -> DataFrame:
    """(keys, line): the first row whose position is below the one before it."""
    prev = F.lag(position).over(Window.partitionBy(*keys).orderBy(line))
    return df.select(*keys, F.col(line).alias("line"), (F.col(position) < prev).alias("x")).where("x").groupBy(*keys).agg(F.min("line").alias("line"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def first_owner(df: DataFrame, keys: Sequence[str], path: str, order: Sequence) -> DataFrame:
    """Rows whose key was claimed by another path before (paths compare without case)."""
    owner = F.first(path).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("owner", owner).where(F.lower("owner") != F.lower(path))


def ordered_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, by: str = " ", name: str = "text") -> DataFrame:
    """Texts of a key, joined in order; blank ones are skipped. A key's texts must fit one row."""
    rows = F.array_sort(F.collect_list(F.when(F.trim(col) != "", F.struct(*order, F.col(col).alias("__t")))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["__t"]), by).alias(name))


def digest(df: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """(keys, n, digest): a digest of a key's values in their order, which partial results of any rows add up to.

    It is the sum of two 64-bit hashes of each value with its position, so 128 bits besides the number of values; positions
    run from 1 (ordered.numbered). Null values count as values of their own.
    """
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col(position).cast("long"), F.col(value).isNull(), F.coalesce(F.col(value).cast("string"), F.lit(""))).cast("decimal(38,0)"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.struct(part(1).alias("a"), part(2).alias("b")).alias("digest"))


def equal_sequences(a: DataFrame, b: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """(keys, n_a, n_b, same): whether the values of a key are the same in the same order on both sides. A key that one side
    lacks has none there. Rows never meet rows: one digest a key does."""
    x = digest(a, keys, position, value).withColumnsRenamed({"n": "n_a", "digest": "d_a"})
    y = digest(b, keys, position, value).withColumnsRenamed({"n": "n_b", "digest": "d_b"})
    same = (F.col("n_a") == F.col("n_b")) & (F.col("d_a") == F.col("d_b"))
    return x.join(y, list(keys), "full").select(*keys, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), F.coalesce(same, F.lit(False)).alias("same"))
