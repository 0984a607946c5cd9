"""Repeated passages across documents by paragraph MinHash banding.

A text is parted into paragraphs of some 7 to 24 words at places set by the words around them (a cut stands before
the word pair whose hash is the least of its neighbourhood), so that a passage is parted alike wherever it stands,
inside a long line or over several short ones. MinHash values of each paragraph's five-word shingles are banded;
paragraphs that collide are verified by exact Jaccard similarity, and components of verified pairs and of equal
paragraphs are the clusters. Neighbouring paragraphs that other documents have too are one passage; its ends are
then extended word by word, as far as another copy goes on alike. Passages of LEAST_WORDS words or more count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, linked, small, stored
from .pieces import runs
from .shingles import combined, mixed, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Copied paragraphs meet in every band. At Jaccard 0.8, the least, all bands miss in 1 of 21 cases, at 0.9 in 1 of 145;
#: what an edited paragraph misses, the words next to its neighbours make good.
BANDS, ROWS = 3, 2
#: Words of the shortest passage, of the reach of a cut to either side, and of the longest paragraph.
LEAST_WORDS, REACH, LONGEST = 50, 6, 24
#: Unlike words between two like stretches that are still one passage (a word changed, some put in).
GAP = 5
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LATER = np.uint64(0xD6E8FEB86659FD93)
_ODD = np.uint64(0xFF51AFD7ED558CCD)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD = re.compile(r"\S+").finditer
_UNITS = "key long, doc_id long, no int, at int, n int, before int, after int, id long, size int, bits long, words array<int>, bands array<long>"


def cuts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where paragraphs begin in the word hashes of several texts that lie one after another; first: where texts begin."""
    n = len(h)
    g = mixed(h + np.uint64(3) * np.r_[h[1:], np.zeros(1, np.uint64)])
    text = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    wide = np.full(n + REACH * (len(first) + 1), _MOST, np.uint64)  # texts are apart by as many places as a cut looks at
    where = np.arange(n) + REACH * (text + 1)
    wide[where] = g
    least = np.lib.stride_tricks.sliding_window_view(wide, REACH)
    own = (g < least[where - REACH].min(axis=1)) & (g <= least[where + 1].min(axis=1))
    own[first] = True
    at = np.flatnonzero(own)
    size = np.diff(np.r_[at, n])
    long = np.flatnonzero(size > LONGEST)
    if len(long):  # no place stands out, as in one word again and again: every LONGEST words
        at = np.union1d(at, np.concatenate([np.arange(at[k] + LONGEST, at[k] + size[k], LONGEST) for k in long.tolist()]))
    return at


def paragraphs(text: str | None) -> list[tuple[int, int]]:
    """(first word, words) of the paragraphs of a text."""
    h = word_hashes((text or "").lower().split())
    at = cuts(h, np.zeros(1, np.int64)) if len(h) else np.zeros(0, np.int64)
    return list(zip(at.tolist(), np.diff(np.r_[at, len(h)]).tolist()))


def signatures(sh: np.ndarray, ok: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band hashes, a row for each paragraph: minima over its shingles (those of ok) from at on."""
    out = np.zeros((len(at), BANDS), np.uint64)
    high = sh >> np.uint64(32)
    for band in range(BANDS):
        acc = np.full(len(at), _SEEDS[band], np.uint64)
        for seed in _SEEDS[band * ROWS : (band + 1) * ROWS]:
            v = (sh ^ seed) * _ODD ^ high
            v[~ok] = _MOST
            acc = mixed(acc + np.minimum.reduceat(v, at))
        out[:, band] = acc
    return out


def _parted(keys: list[int], ids: list[int | None], texts: list[str]) -> pa.RecordBatch | None:
    """The rows of _UNITS for some texts."""
    words = [t.lower().split() for t in texts]
    some = [i for i, w in enumerate(words) if w]
    if not some:
        return None
    length = np.array([len(words[i]) for i in some])
    first = np.r_[0, np.cumsum(length)[:-1]]
    h = word_hashes([w for i in some for w in words[i]])
    at = cuts(h, first)
    size = np.diff(np.r_[at, len(h)])
    text = np.searchsorted(first, at, side="right") - 1
    no = np.arange(len(at)) - np.searchsorted(at, first)[text]
    same = lambda x, y: x[1:] == y[:-1]
    before = np.r_[0, np.where(same(text, text), size[:-1], 0)]
    after = np.r_[np.where(same(text, text), size[1:], 0), 0]
    para = np.repeat(np.arange(len(at)), size)
    place = np.arange(len(h)) - at[para]
    whole = mixed(np.add.reduceat(mixed(h ^ mixed(place.astype(np.uint64) * _LATER)), at) + size.astype(np.uint64))
    short = size < SHINGLE
    sh = np.zeros(len(h), np.uint64)
    if len(h) >= SHINGLE:
        sh[: len(h) - SHINGLE + 1] = combined(h, SHINGLE)
    ok = place <= size[para] - SHINGLE
    bit = np.where(ok, np.uint64(1) << (sh & np.uint64(63)), np.uint64(0))
    bits = np.bitwise_or.reduceat(bit, at)
    where = np.flatnonzero(ok)
    mine = mixed(sh[where] ^ mixed(para[where].astype(np.uint64) * _LATER))
    order = np.argsort(mine)
    twice = np.flatnonzero(same(mine[order], mine[order])) + 1
    distinct = np.maximum(0, size - SHINGLE + 1) - np.bincount(para[where[order[twice]]], minlength=len(at))
    bands = signatures(sh, ok, at)
    none = pa.array(short)
    ints = lambda x: pa.array(x.astype(np.int32))
    pick = np.array(some)[text]
    doc = pa.array([ids[i] for i in pick.tolist()], pa.int64())
    offsets = pa.array(np.r_[at, len(h)].astype(np.int32))
    steps = pa.array(np.arange(0, len(at) * BANDS + 1, BANDS, dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.array(keys, np.int64)[pick]), doc, ints(no), ints(at - first[text]), ints(size), ints(before), ints(after),
            pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(whole.astype(np.int64))), ints(distinct), pa.array(bits.astype(np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32))),
            pa.ListArray.from_arrays(steps, pa.array(bands.astype(np.int64).reshape(-1))),
        ],
        ["key", "doc_id", "no", "at", "n", "before", "after", "id", "size", "bits", "words", "bands"],
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text) of the rows with a text; key is a 64-bit digest of id and text."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return d.select(_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("-")), text)


def parted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The paragraphs of every text: its place, words (32-bit hashes), digest (null under five words) and bands."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, texts = (b.column(i).to_pylist() for i in range(3))
            for lo, hi in runs(texts, 500_000):
                out = _parted(keys[lo:hi], ids[lo:hi], texts[lo:hi])
                if out is not None:
                    yield out

    return keyed(docs, id_col, text_col).mapInArrow(make, _UNITS)


def _shingle_set(words: np.ndarray) -> set[int]:
    return set(combined(np.asarray(words).astype(np.uint32).astype(np.uint64), SHINGLE).tolist())


def _udf(least: float):
    """The UDF that tells whether two paragraphs have that Jaccard similarity."""

    @F.pandas_udf("boolean")
    def holds(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y):
            a, b = _shingle_set(s), _shingle_set(t)
            both = len(a & b)
            out.append(both >= least * (len(a) + len(b) - both) - 1e-9)
        return pd.Series(out, index=x.index, dtype=bool)

    return holds


def _common():
    """The UDF for the words that two paragraphs have in common at one side."""

    @F.pandas_udf("int")
    def alike(a: pd.Series, b: pd.Series, side: pd.Series) -> pd.Series:
        """Words that two paragraphs have in common at their front (side 1) or end (side -1); 0 with a null."""
        out = np.zeros(len(a), np.int32)
        for i, (x, y, s) in enumerate(zip(a, b, side)):
            if x is None or y is None:
                continue
            n = min(len(x), len(y))
            same = (x[:n] == y[:n]) if s > 0 else (x[::-1][:n] == y[::-1][:n])
            out[i] = n if same.all() else int(np.argmin(same))
        return pd.Series(out, index=a.index)

    return alike


def clusters(units: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(id, cluster): the paragraphs of clusters that two documents have at least; cluster is the smallest digest in it."""
    named = units.where("id is not null")
    bands = named.select("id", "size", "bits", F.posexplode("bands").alias("i", "h")).select(F.xxhash64("i", "h").alias("bucket"), "id", "size", "bits")
    live = bands.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("bucket")
    met = stored(bands.join(small(stored(live, "live")), "bucket", "left_semi").distinct(), "buckets")
    holds = _udf(least)
    apart = lambda s, x, t, y: (F.least(s, t) < least * F.greatest(s, t)) | (F.bit_count(x.bitwiseXOR(y)) > (s + t) * (1 - least) / (1 + least) + 1e-9)
    root = linked(met, named.select("id", F.col("words").alias("x")), holds, apart)
    whose = named.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).join(root, "id", "left")
    whose = stored(whose.where("lo <> hi or root is not null").select("id", F.coalesce("root", "id").alias("cluster"), "lo", "hi"), "whose")
    many = stored(whose.groupBy("cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("cluster"), "many")
    return stored(whose.select("id", "cluster").join(many, "cluster"), "clusters")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, doc_id, start_word, n_words, cluster, kept): stretches of passages that other documents have too.

    Words are runs between white space, counted from 0 over the whole text and compared in lower case; line breaks
    are spaces. A passage has least_words words or more, of which the part ``least`` at least is in paragraphs that
    another document has too, or in words next to them in which another copy goes on alike; up to GAP unlike words may
    stand between. Where a paragraph of it is the first of its cluster (by doc_id, a null id last, then key and
    place), the stretch is kept; others can go. So every cluster has a kept place in some passage. cluster is the
    smallest cluster of a stretch's paragraphs. Where two copies end in paragraphs that are alike but not equal, a stretch
    may end a few words early. A document with null text, or without such passages, has no rows;
    what repeats only inside one document is none; repeated rows of a document are one. Other columns are not read.
    """
    units = stored(parted(docs, id_col, text_col), "paragraphs")
    of = clusters(units, least)
    doc = Window.partitionBy("key").orderBy("no")
    hits = units.select("key", "doc_id", "no", "at", "n", "before", "after", "id").join(small(of), "id").drop("id")
    end = F.col("at") + F.col("n")
    # neighbours make a run; runs with one paragraph or so between make a group, kept if it can reach the least length
    gap = F.col("at") - F.lag(end).over(doc)
    hits = hits.withColumn("gap", gap).withColumn("run", F.count(F.when(F.coalesce(F.col("gap") > 0, F.lit(True)), 1)).over(doc)).withColumn("group", F.count(F.when(F.coalesce(F.col("gap") > LONGEST + GAP, F.lit(True)), 1)).over(doc))
    group = Window.partitionBy("key", "group").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach = F.last(end + F.col("after")).over(group) - F.first(F.col("at") - F.col("before")).over(group)
    hits = stored(hits.withColumn("reach", reach).where(F.col("reach") >= least_words).drop("reach", "gap", "group"), "hits")

    # the ends of runs, and for each the neighbours of the first and of the last other place of its paragraph
    run = Window.partitionBy("key", "run").orderBy("no")
    ends = hits.withColumn("first", F.lag("no").over(run).isNull()).withColumn("last", F.lead("no").over(run).isNull())
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("is"), (F.col(b) > 0).alias("any")) for s, c, b in ((-1, "first", "before"), (1, "last", "after"))])
    ends = stored(ends.select("key", "no", "run", "cluster", F.explode(sides).alias("s")).select("key", "no", "run", "cluster", "s.*").where("any"), "ends")
    spot = F.struct("key", (F.col("no") + F.col("side")).alias("no"))
    others = stored(ends.groupBy("cluster", "side").agg(F.min(spot).alias("p"), F.max(spot).alias("q")), "others")
    ask = stored(ends.where("`is`").join(others, ["cluster", "side"]).select("key", "run", "side", (F.col("no") + F.col("side")).alias("no"), "p", "q"), "ask")
    want = stored(ask.select("key", "no").union(ask.select("p.*")).union(ask.select("q.*")).distinct(), "want")
    near = stored(units.select("key", "no", "words").join(small(want), ["key", "no"], "left_semi").dropDuplicates(["key", "no"]), "near")
    other = lambda c: near.select(F.struct("key", "no").alias(c), F.col("words").alias(f"{c}_words"))
    not_own = lambda c: F.when(F.col(f"{c}.key") != F.col("key"), F.col(f"{c}_words"))
    known = ask.join(near, ["key", "no"]).join(other("p"), "p").join(other("q"), "q")
    alike = _common()
    known = known.select("key", "run", "side", F.greatest(alike("words", not_own("p"), "side"), alike("words", not_own("q"), "side")).alias("more"))
    more = known.groupBy("key", "run").agg(F.max(F.when(F.col("side") < 0, F.col("more"))).alias("lead"), F.max(F.when(F.col("side") > 0, F.col("more"))).alias("trail"))

    spans = hits.groupBy("key", "run").agg(F.min("at").alias("a"), F.max(end).alias("b")).join(stored(more, "more"), ["key", "run"], "left")
    spans = spans.select("key", "run", (F.col("a") - F.coalesce("lead", F.lit(0))).alias("a"), (F.col("b") + F.coalesce("trail", F.lit(0))).alias("b"))
    by = Window.partitionBy("key").orderBy("run")
    spans = spans.withColumn("from", F.greatest("a", F.coalesce(F.lag("b").over(by), F.lit(0)))).withColumn("new", F.coalesce(F.col("a") - F.lag("b").over(by) > GAP, F.lit(True)))
    spans = spans.withColumn("passage", F.count(F.when(F.col("new"), 1)).over(by))
    part = Window.partitionBy("key", "passage")
    spans = spans.withColumn("lo", F.min("a").over(part)).withColumn("hi", F.max("b").over(part)).withColumn("like", F.sum(F.col("b") - F.col("from")).over(part))
    spans = stored(spans.where((F.col("hi") - F.col("lo") >= least_words) & (F.col("like") >= least * (F.col("hi") - F.col("lo")))).select("key", "run", "passage", "lo", "hi"), "spans")

    mine = stored(hits.select("key", "doc_id", "no", "at", "n", "run", "cluster").join(spans, ["key", "run"]), "mine")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key", "no")
    head = mine.groupBy("cluster").agg(F.min(order).alias("f")).select("cluster", F.col("f.key").alias("f_key"), F.col("f.no").alias("f_no"))
    mine = mine.join(stored(head, "heads"), "cluster").withColumn("kept", (F.col("key") == F.col("f_key")) & (F.col("no") == F.col("f_no")))
    inside = Window.partitionBy("key", "passage").orderBy("no")
    mine = mine.withColumn("turn", F.count(F.when(F.coalesce(F.col("kept") != F.lag("kept").over(inside), F.lit(True)), 1)).over(inside))
    mine = mine.withColumn("turns", F.max("turn").over(Window.partitionBy("key", "passage")))
    out = mine.groupBy("key", "doc_id", "passage", "turn").agg(F.min("at").alias("a"), F.max(end).alias("b"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("turns").alias("turns"), F.min("cluster").alias("cluster"), F.first("kept").alias("kept"))
    a = F.when(F.col("turn") == 1, F.col("lo")).otherwise(F.col("a"))
    b = F.when(F.col("turn") == F.col("turns"), F.col("hi")).otherwise(F.col("b"))
    out = stored(out.select("key", "doc_id", a.alias("start_word"), (b - a).alias("n_words"), "cluster", "kept"), "passages")
    drop_stored(units, hits, ends, others, ask, want, near, spans)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the stretches that are not kept cut from their texts (from the first word's first character to the
    last word's last); all rows and columns stay."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, spans):
            at = [m.span() for m in _WORD(t)]
            keep, last = [], 0
            for s in ss:
                keep.append(t[last : at[s["start_word"]][0]])
                last = at[s["start_word"] + s["n_words"] - 1][1]
            out.append("".join(keep) + t[last:])
        return pd.Series(out, index=texts.index, dtype=object)

    gone = repeats(docs, id_col, text_col).where("not kept").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("__cut"))
    gone = stored(gone.withColumnRenamed("key", "__key"), "cuts")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    d = docs.withColumn("__key", _key(docs[id_col].cast("long"), docs[text_col]))
    touched = d.join(gone, "__key").withColumn(text_col, cut(F.col(text_col), F.col("__cut"))).select(*cols)
    return d.join(small(gone.select("__key")), "__key", "left_anti").select(*cols).unionByName(touched)
