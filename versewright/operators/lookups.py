"""Joins with reference tables: expected counts, floors, ranges, aliases, coverage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matcher import first_named
from .ordered import floored

#: Reference tables of so many rows at most are broadcast; larger ones take part in shuffle joins.
BROADCAST_ROWS = 200_000


def small(dim: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """dim with a broadcast hint if it has few rows; reading stops once it has more."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def with_expected(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(small(dim), list(keys), "left")


#: A start table of so many rows, and of so many a key, at most is broadcast as arrays: 8 MB or less.
ARRAY_ROWS, ARRAY_STARTS = 100_000, 1000


def floor(df: DataFrame, value: str, dim: DataFrame, start: str, keys: Sequence[str] = (), name: str = "floor") -> DataFrame:
    """df with the greatest start that is no more than the value; null before the first, and for a null value.

    A small start table goes to all tasks, as a sorted array of each key; any other is merged with df in one order
    (ordered.floored), so that neither a key's rows nor its starts are ever in one place.
    """
    starts = dim.where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("__v")).distinct()
    n = starts.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (n[0] or 0) > ARRAY_ROWS or (n[1] or 0) > ARRAY_STARTS:
        return floored(df, value, dim, start, keys, name)
    if keys:
        joined = df.join(F.broadcast(starts.groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias("__s"))), list(keys), "left")
    else:
        joined = df.withColumn("__s", F.array(*[F.lit(r[0]) for r in starts.orderBy("__v").collect()]))
    return joined.withColumn(name, F.try_element_at(F.filter("__s", lambda s: s <= F.col(value)), F.lit(-1))).drop("__s")


def next_start(dim: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    return dim.withColumn("next_start", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def decode_chunks(df: DataFrame, col: str = "encoded") -> DataFrame:
    """(book, chapter, start) from "chapter:start,start;chapter:start"; starts are sorted and distinct."""
    part = df.select("book", F.explode(F.split(col, ";")).alias("p")).where("trim(p) <> ''")
    part = part.select("book", F.split("p", ":")[0].cast("int").alias("chapter"), F.split(F.split("p", ":")[1], ",").alias("v"))
    return part.select("book", "chapter", F.explode(F.array_sort(F.array_distinct(F.transform("v", lambda x: x.cast("int"))))).alias("start"))


def within_range(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, low: str, high: str) -> DataFrame:
    """Rows of left with the rows of right of the same key whose value lies in [low, high]."""
    return left.join(right, list(keys)).where(F.col(value).between(F.col(low), F.col(high)))


def missing(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")


def expected_numbers(dim: DataFrame, keys: Sequence[str], most: str, name: str) -> DataFrame:
    """A row for each number from 1 to a key's count."""
    return dim.where(F.col(most) >= 1).select(*keys, F.explode(F.sequence(F.lit(1), F.col(most))).alias(name))


def out_of_range(df: DataFrame, dim: DataFrame, keys: Sequence[str], number: str, most: str) -> DataFrame:
    return with_expected(df, dim, keys).where(~F.col(number).between(F.lit(1), F.col(most)))


def by_alias(df: DataFrame, heading: Column, aliases: DataFrame, key) -> DataFrame:
    """df with ``book``: of an exact alias that names one book only, else of the first alias that the heading contains.

    aliases(book, alias, priority) is a profile's or some profiles' table: it is gathered, as every worker needs all of it;
    key turns a Column into what is compared. Aliases inside a heading are found by an automaton in one pass over it, of
    equal priorities that of the least book; df is neither shuffled nor multiplied.
    """
    rows = aliases.select("book", "priority", key(F.col("alias")).alias("k")).where("k <> ''").distinct().collect()
    named: dict[str, set[str]] = {}
    for r in rows:
        named.setdefault(r["k"], set()).add(r["book"])
    order = sorted({(r["priority"], r["book"]) for r in rows})
    rank = {x: i for i, x in enumerate(order)}
    one = df.sparkSession.createDataFrame([(k, next(iter(b))) for k, b in named.items() if len(b) == 1], "__k string, __exact string")
    d = df.withColumn("__key", key(heading)).join(small(one), F.col("__key") == F.col("__k"), "left")
    inside = first_named(F.when(F.col("__exact").isNull(), F.col("__key")), [(r["k"], rank[r["priority"], r["book"]]) for r in rows], [b for _, b in order])
    return d.withColumn("book", F.coalesce("__exact", inside)).drop("__key", "__k", "__exact")


def overridden(df: DataFrame, choices: DataFrame, on: str, col: str) -> DataFrame:
    """df with col replaced where the user chose a value."""
    c = choices.select(on, F.col(col).alias("__o"))
    return df.join(small(c), on, "left").withColumn(col, F.coalesce("__o", col)).drop("__o")


def longest_prefix(df: DataFrame, path: str, roots: DataFrame, root: str = "root") -> DataFrame:
    """df with the deepest root folder above each path: an equi-join on all prefixes of the path."""
    parts = F.split(path, "/")
    d = df.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("__p"))
    return d.join(small(roots), F.col("__p") == F.col(root)).groupBy(*df.columns).agg(F.max(F.struct(F.char_length(root), F.col(root)))[root].alias(root))


def changed(after: DataFrame, before: DataFrame) -> DataFrame:
    """Paths of after(path, content) that before has not, or with another content, by SHA-256."""
    h = lambda d: d.select("path", F.sha2(F.col("content"), 256).alias("hash"))
    return h(after).join(h(before), ["path", "hash"], "left_anti").select("path")


#: Characters of an anchor, and the shortest text that can lie within another.
ANCHOR, CONTAINED, COMPARED = 40, 80, 40


def _anchors(text: Column) -> Column:
    """Hashes of some pieces of ANCHOR characters: of all that lie within CONTAINED characters the least one. So a text
    that lies within another has each of its anchors among that one's."""

    @F.pandas_udf("array<long>")
    def pick(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            h = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            whole, size, p = None, 1, np.array([0x9E3779B97F4A7C15], np.uint64)  # an array: it wraps round
            need = ANCHOR
            while need:  # pieces of 1, 2, 4, … characters make one of ANCHOR
                if need & size:
                    whole = h if whole is None else h[: len(whole) - size if len(whole) > size else 0] * p + whole[size:]
                    need -= size
                if need:
                    h, size = h[:-size] * p + h[size:], size * 2
                    p = np.multiply(p, p, dtype=np.uint64) + np.uint64(2)
            whole ^= whole >> np.uint64(31)
            whole *= np.uint64(0xD6E8FEB86659FD93)
            reach = CONTAINED - ANCHOR + 1
            out.append(np.unique(np.lib.stride_tricks.sliding_window_view(whole, reach).min(axis=1)).astype(np.int64))
        return pd.Series(out, index=s.index, dtype=object)

    return pick(text)


def duplicated_titles(titles: DataFrame, chunks: DataFrame, key) -> DataFrame:
    """(project, title_path, chunk_path): a title that repeats a chunk's text, the first such chunk of each.

    Both have COMPARED characters or more once compared; equal, or one within the other if the shorter has CONTAINED.
    Each different text is looked at once, whatever paths have it. For texts that aren't equal, the shorter one's anchor
    that the fewest on the other side have is looked up among the other side's anchors: a text meets only those that
    have its rarest piece.
    """
    node = lambda text: F.xxhash64("project", text)
    paths = titles.select("project", F.col("path").alias("title_path"), key(F.col("text")).alias("a")).where(F.char_length("a") >= COMPARED).withColumn("t", node("a"))
    t = paths.select("project", "t", "a").dropDuplicates(["project", "t"])
    c = chunks.select("project", F.col("path").alias("chunk_path"), key(F.col("text")).alias("b")).where(F.char_length("b") >= COMPARED)
    c = c.groupBy("project", "b").agg(F.min("chunk_path").alias("chunk_path")).withColumn("c", node("b"))
    equal = t.join(c, (t["project"] == c["project"]) & (F.col("a") == F.col("b"))).select(t["project"], "t", "chunk_path")

    def marks(d: DataFrame, path: str, text: str) -> DataFrame:
        return d.where(F.char_length(text) >= CONTAINED).select("project", path, F.explode(_anchors(F.col(text))).alias("anchor"))

    def inside(short: DataFrame, long: DataFrame, path: str, other: str) -> DataFrame:
        df = long.groupBy("project", "anchor").agg(F.count("*").alias("df"))
        best = short.join(df, ["project", "anchor"], "left").groupBy("project", path).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "anchor")).alias("x")).where("x.df > 0")
        return best.select("project", path, F.col("x.anchor").alias("anchor")).join(long, ["project", "anchor"]).select("project", path, other)

    mt, mc = marks(t, "t", "a"), marks(c, "c", "b")
    pairs = inside(mt, mc, "t", "c").select("project", "t", "c").union(inside(mc, mt, "c", "t").select("project", "t", "c")).distinct()
    a, b = F.col("a"), F.col("b")
    held = pairs.join(t, ["project", "t"]).join(c, ["project", "c"]).where(a.contains(b) | b.contains(a)).select("project", "t", "chunk_path")
    first = equal.union(held).groupBy("project", "t").agg(F.min("chunk_path").alias("chunk_path"))
    return paths.join(first, ["project", "t"]).groupBy("project", "title_path").agg(F.min("chunk_path").alias("chunk_path"))
