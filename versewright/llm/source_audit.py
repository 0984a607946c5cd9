"""Source divergence audit: how the sources of a language differ in their words, by triangular discrimination.

The terms of a language are grouped by their identical sparse vectors of counts by source: every pair of sources is
evaluated once for each distinct vector, times the number of its terms, and original terms are ranked at the end.
All arithmetic is on whole numbers. A pair's sum over all terms is parted by what the two counts are:

    sum f(p, q) = V f(z, y) + sum over p's terms of (f(p, y) - f(z, y)) + sum over q's terms of (f(z, q) - f(z, y))
                + sum over terms of both of (f(p, q) - f(p, y) - f(z, q) + f(z, y))

with z and y the shares of a term that doesn't occur. The middle sums need a source's counts alone, each distinct one
once; the last needs a vector's own sources, so absent ones cost nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents of a language that a kept term is in, at least; units of a share; terms in a group's report.
LEAST_DOCS, UNIT, TOP = 10, 1_000_000_000, 10
#: Distinct (group, term) counts that a Python worker holds before it hands them on.
HELD = 500_000
#: Sources in a tile of the matrix of pairs, and tiles that a worker holds (8 MB each).
TILE, TILES = 1024, 8

#: A-Z in lower case, a-z and the bytes of all other characters than ASCII's as they are, the rest as blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in a group and documents of it, summed over the whole table. Each group also
    has a row with a null term, so that one without terms is there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        d: dict[tuple[str, str], Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in n.items():
                terms, seen = list(c), d[lang, source]
                for i in range(0, len(terms) or 1, 50_000):
                    part = terms[i : i + 50_000]
                    size = len(part) + (i == 0)  # with the group's own row
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * size), pa.array([source] * size), pa.array([None] * (i == 0) + part, pa.binary()).cast(pa.string()),
                        pa.array([0] * (i == 0) + list(map(c.__getitem__, part)), pa.int64()), pa.array([0] * (i == 0) + list(map(seen.__getitem__, part)), pa.int64()),
                    ], ["lang", "source", "term", "n", "docs"])
            n.clear()
            d.clear()

        held = 0
        for batch in batches:
            text, lang, source = (batch.column(i) for i in range(3))
            for t, key in zip(text.cast(pa.binary()), zip(lang.to_pylist(), source.to_pylist())):
                words = t.as_py().translate(_TERMS).split()  # at blanks of ASCII
                mine, seen = n.setdefault(key, Counter()), d.setdefault(key, Counter())
                held -= len(mine)
                mine.update(words)
                seen.update(set(words))
                held += len(mine)
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    d = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    got = d.mapInArrow(each, "lang string, source string, term string, n bigint, docs bigint")
    # dealt out by what comes next as well: a task's rows have hardly a key twice, so there is nothing to add up before
    return got.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (n + 2) / (total + 2 kept)), exactly; kept must not be 0."""
    over = (n + 2).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    under = (total + 2 * kept).cast("decimal(19,0)")
    return F.call_function("div", over, under) + 1


def _f(p, q):
    return (p - q) * (p - q) // (p + q)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, m, v array of (no, p, z)) to (lang, a, b, value): what the sources that share a vector add to their pairs, summed
    over the rows of a task."""
    tiles: dict[tuple[str, int, int], np.ndarray] = {}

    def out(keys) -> Iterator[pa.RecordBatch]:
        for lang, i, j in keys:
            x = tiles.pop((lang, i, j))
            a, b = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + i * TILE), pa.array(b + j * TILE), pa.array(x[a, b])], ["lang", "a", "b", "value"])

    for batch in batches:
        v, start = batch.column(2).flatten(), batch.column(2).offsets.to_numpy()
        start = start - start[0]
        no, p, z = (v.field(i).to_numpy().astype(np.int64) for i in range(3))
        times = batch.column(1).to_numpy()
        for r, lang in enumerate(batch.column(0).to_pylist()):
            mine = slice(start[r], start[r + 1])  # by number
            blocks = np.unique(no[mine] // TILE)
            cut = start[r] + np.searchsorted(no[mine] // TILE, np.r_[blocks, blocks[-1:] + 1])
            for i, lo, hi in zip(blocks.tolist(), cut, cut[1:]):
                for j, lo2, hi2 in zip(blocks.tolist(), cut, cut[1:]):
                    key = (lang, i, j)
                    if key not in tiles:
                        if len(tiles) >= TILES:
                            yield from out([next(iter(tiles))])
                        tiles[key] = np.zeros((TILE, TILE), np.int64)
                    pa_, za, pb, zb = p[lo:hi, None], z[lo:hi, None], p[None, lo2:hi2], z[None, lo2:hi2]
                    tiles[key][np.ix_(no[lo:hi] - i * TILE, no[lo2:hi2] - j * TILE)] += times[r] * (_f(pa_, pb) - _f(pa_, zb) - _f(za, pb) + _f(za, zb))
    yield from out(list(tiles))


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, no, z, kept, own array of (p, m), others array of (no, z)) to (lang, a, b, value): the sums over one source's terms
    against the other's absent ones, in both directions, and V f(z, y) in one."""
    for batch in batches:
        for r in batch.to_pylist():
            own, others = r["own"] or [], r["others"]
            p, m = (np.array([x[k] for x in own], np.int64) for k in ("p", "m"))
            b, y = (np.array([x[k] for x in others], np.int64) for k in ("no", "z"))
            base = _f(np.int64(r["z"]), y)
            total = -int(m.sum()) * base
            for q, k in zip(p, m):
                total += k * _f(q, y)
            a, lang = np.full(len(b), r["no"]), pa.array([r["lang"]] * len(b), pa.string())
            for x, to, value in ((a, b, total + r["kept"] * base), (b, a, total)):
                yield pa.RecordBatch.from_arrays([lang, pa.array(x), pa.array(to), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])


_PAIRS = "lang string, a bigint, b bigint, value bigint"


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of docs(text, lang, source).

    Part ``pair``: each other source of the language by its divergence over all kept terms, largest first. Part ``term``: the
    terms that the source has more of than its language, by their share in the divergence, the first ``top``. Equal
    values go by item. Null texts, languages and sources count as ''. Repeated rows count as often as they are there; a
    group without terms has pairs and no terms; a source alone in its language has no pairs; a language without kept terms
    has pairs of value 0. An empty table gives no rows. Other columns are not read, whatever their names.

    A vector has at most one entry a source, so no more than the pairs of one source in the result.
    """
    entry = F.struct("source", "n")
    every = counted(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(entry)).alias("v")).where((F.col("docs") >= least_docs) | F.col("term").isNull())
    every = stored(every.select("lang", "term", "v"), "vectors")
    vectors = every.where("term is not null")
    distinct = stored(vectors.groupBy("lang", "v").agg(F.count("*").alias("m")).withColumn("id", F.monotonically_increasing_id()), "distinct")

    kept = distinct.groupBy("lang").agg(F.sum("m").alias("kept"))
    total = distinct.select("lang", "m", F.explode("v").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("m") * F.col("e.n")).alias("total"))
    groups = every.where("term is null").select("lang", F.explode("v.source").alias("source")).join(total, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept"])
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1)
    groups = groups.withColumn("z", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(1))
    groups = stored(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.max("kept").alias("kept"))

    # shares of each entry of each distinct vector, and of its sum in the language
    flat = distinct.select("lang", "id", "m", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("sum"), F.explode("v").alias("e"))
    flat = flat.select("lang", "id", "m", "sum", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
    flat = flat.join(groups, ["lang", "source"]).join(langs.select("lang", "all"), "lang")
    flat = stored(flat.select("lang", "id", "m", "source", "no", "z", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("sum"), F.col("all"), F.col("kept")).alias("q")), "flat")

    whole = flat.groupBy("lang", "id", "m").agg(F.sort_array(F.collect_list(F.struct("no", "p", "z"))).alias("v"))
    within = whole.where(F.size("v") > 1).select("lang", "m", "v").mapInArrow(_within, _PAIRS)
    own = flat.groupBy("lang", "no", "p").agg(F.sum("m").alias("m")).groupBy("lang", "no").agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("own"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("no", "z")).alias("others"))
    alone = groups.select("lang", "no", "z", "kept").join(own, ["lang", "no"], "left").join(others, "lang").select("lang", "no", "z", "kept", "own", "others").mapInArrow(_alone, _PAIRS)
    sums = within.unionByName(alone).where("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = groups.select("lang", F.col("no").alias("a"), "source")
    pairs = sums.join(name, ["lang", "a"]).join(name.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    # a source's report takes no more than the first terms of a vector, as all of them have one value, and of its best vectors
    first = vectors.withColumn("k", F.row_number().over(Window.partitionBy("lang", "v").orderBy("term"))).where(F.col("k") <= top).drop("k")
    first = first.join(distinct.select("lang", "v", "id"), ["lang", "v"]).select("lang", "id", "term")
    more = flat.where("p > q").select("lang", "id", "source", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    best = more.withColumn("k", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("k") <= top).drop("k")
    found = best.join(first, ["lang", "id"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return pairs.unionByName(_ranked(found).where(F.col("rank") <= top))


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
