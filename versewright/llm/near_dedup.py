"""Near-duplicate documents by Order MinHash.

A sketch takes, for each of several hash functions, the few smallest occurrence-labelled shingles of five
words and hashes them in the order in which they stand in the text, so it is sensitive to edits and moves.
Documents whose sketches agree somewhere are candidates; a banded alignment of their words verifies them.
The similarity of two texts is matched / (n + m - matched), matched being the longest common subsequence of
their n and m words in lower case: a Jaccard similarity that counts only what stands in the same order.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import OrderedDict
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import linked, small, stored
from .shingles import combined, labelled, mixed, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Sketches, and shingles in each. Of two texts that share a part j of their shingles a sketch agrees with a chance
#: near j^DEPTH. Texts of word similarity 0.8 share some 0.35 to 0.8, as the edits lie: all sketches miss in 1 of 23
#: cases at 0.35, in 1 of 1000 at 0.5.
SKETCHES, DEPTH = 24, 2
#: Bits of a text's mark.
MARK = 1024
_SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sketch(h: np.ndarray, depth: int = DEPTH, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """One hash for each hash function; none for a text without shingles."""
    x = labelled(h)
    n, out = len(x), np.zeros(len(seeds) if len(x) else 0, np.uint64)
    step = max(1, 200_000 // max(1, n))
    for lo in range(0, len(out), step):
        own = seeds[lo : lo + step, None]
        v = (x[None, :] ^ own) * np.uint64(0xFF51AFD7ED558CCD)
        v ^= v >> np.uint64(32)
        at = np.argpartition(v, depth - 1, axis=1)[:, :depth] if n > depth else np.broadcast_to(np.arange(n), v.shape)
        picked = x[np.sort(at, axis=1)]
        acc = own[:, 0].copy()
        for j in range(picked.shape[1]):
            acc = mixed(acc + picked[:, j])
        out[lo : lo + step] = acc
    return out


def marked(h: np.ndarray) -> np.ndarray:
    """MARK bits over the words of a text, each set if an odd number of occurrence-labelled words falls on it.

    Two marks differ in no more bits than there are words of one text without their like in the other.
    """
    odd = np.bincount((labelled(h) & np.uint64(MARK - 1)).astype(np.int64), minlength=MARK) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def far(x: Column, s: Column, y: Column, t: Column, least: float = SIMILARITY) -> Column:
    """Whether two texts of s and t words surely aren't similar, by their marks: of s + t words the similarity leaves
    (s + t) * (1 - least) / (1 + least) without their like at most."""
    differ = reduce(add, [F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(MARK // 64)])
    return differ > (s + t) * (1 - least) / (1 + least) + 1e-6


def banded(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """The longest common subsequence if it is ``need`` or more, else less than ``need``: dynamic programming over the
    band of offsets that an alignment with ``need`` matches can reach."""
    n, m = len(a), len(b)
    left, right = n - need, m - need  # so many words of a and of b may stay unmatched
    if left < 0 or right < 0:
        return 0
    row = np.zeros(m + 1, np.int64)
    for r in range(n):
        lo, hi = max(0, r - left), min(m, r + right + 1)
        if lo < hi:
            new = np.maximum(row[lo + 1 : hi + 1], row[lo:hi] + (b[lo:hi] == a[r]))
            row[lo + 1 : hi + 1] = np.maximum.accumulate(new)
    return int(row.max())


def _anchored(a: np.ndarray, b: np.ndarray) -> int:
    """Words of an alignment through the shingles that ascend in both texts, with what aligns between them: no more than the longest."""
    x, y = combined(a, SHINGLE), combined(b, SHINGLE)
    if min(len(a), len(b)) < SHINGLE:
        return 0
    _, i, j = np.intersect1d(labelled(x), labelled(y), assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order].tolist(), j[order].tolist()
    tails, at, back = [], [], [-1] * len(i)
    for k, v in enumerate(j):
        p = bisect_left(tails, v)
        tails[p : p + 1] = [v]
        at[p : p + 1] = [k]
        back[k] = at[p - 1] if p else -1
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    ai = bi = total = 0
    for p, q in [*((i[k], j[k]) for k in reversed(chain)), (len(a), len(b))]:
        if p < ai or q < bi:  # overlaps what is matched: the words after it count, if they go on alike
            over = max(ai - p, bi - q)
            if over >= SHINGLE or ai - p != bi - q:
                continue
            ai, bi, total = p + SHINGLE, q + SHINGLE, total + SHINGLE - over
            continue
        if p > ai and q > bi and (p - ai) * (q - bi) <= 40_000:
            total += banded(a[ai:p], b[bi:q], 0)
        end = SHINGLE if p < len(a) else 0
        ai, bi, total = p + end, q + end, total + end
    return total


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sequences of word hashes have that similarity; two empty ones have.

    Bounds come first: the words in common, whatever their order, are no fewer than the longest common
    subsequence, and an alignment through common shingles has no more. The banded alignment decides in between.
    """
    total = len(a) + len(b)
    need = math.ceil(least * total / (1 + least) - 1e-9)
    if total == 0 or (len(a) == len(b) and (a == b).all()):
        return True
    if min(len(a), len(b)) < need or len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < need:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, need, short = a[head:], b[head:], need - head, short - head
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b, need = a[: len(a) - tail], b[: len(b) - tail], need - tail
    return need <= 0 or _anchored(a, b) >= need or banded(a, b, need) >= need


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, node, row, size, sketch, mark): 64-bit digests of the text and of the whole row, the words, the sketch and the mark."""

    @F.pandas_udf("size int, sketch array<long>, mark array<long>")
    def make(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            w = word_hashes(t.lower().split())
            rows.append((len(w), sketch(combined(w, k)).astype(np.int64), marked(w)))
        return pd.DataFrame(rows, columns=["size", "sketch", "mark"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), row_digest(docs).alias("row"))
    return d.select("doc_id", F.xxhash64("t").alias("node"), "row", make("t").alias("x")).select("doc_id", "node", "row", "x.*")


def row_digest(docs: DataFrame) -> Column:
    """64-bit digest of all columns but maps and variants, which can't be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def _udf(least: float):
    """The UDF that tells whether two texts are similar."""

    @F.pandas_udf("boolean")
    def holds(x: pd.Series, y: pd.Series) -> pd.Series:
        known: OrderedDict[str, np.ndarray] = OrderedDict()

        def of(t: str) -> np.ndarray:
            if t not in known:
                if len(known) > 64:
                    known.popitem(last=False)
                known[t] = word_hashes(t.lower().split())
            return known[t]

        return pd.Series([similar(of(s), of(t), least) for s, t in zip(x, y)], index=x.index, dtype=bool)

    return holds


def _resolved(docs: DataFrame, id_col: str, text_col: str, least: float, k: int) -> tuple[DataFrame, DataFrame]:
    """The sketched rows without their sketches, and (node, root) of the texts that are linked to others."""
    all_ = stored(sketched(docs, id_col, text_col, k), "sketches")
    met = all_.select(F.col("node").alias("id"), "size", F.posexplode("sketch").alias("i", "h")).select(F.xxhash64("i", "h").alias("bucket"), "id", "size", F.lit(0).cast("long").alias("bits")).distinct()
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    apart = lambda s, _, t, __: F.least(s, t) < least * F.greatest(s, t)
    marks = all_.select(F.col("node").alias("id"), "mark")
    root = linked(stored(met, "buckets"), texts, _udf(least), apart, marks, lambda x, s, y, t: far(x, s, y, t, least))
    return all_.select("doc_id", "node", "row"), root.withColumnRenamed("id", "node")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the smallest id of the documents linked to this one.

    Equal texts are one class (null and empty texts too); different texts are linked if their similarity is
    ``least`` or more, and links chain. A text of fewer than k words is one shingle, so it is linked only to texts
    of the same words. Texts are told apart by a 64-bit digest. A null id gets the class of its text, null if no
    row of the class has an id. Rows that share an id but not a text have a class each, which may bear the same
    id. Repeated rows stay; an empty table gives no rows; other columns don't matter.
    """
    all_, root = _resolved(docs, id_col, text_col, least, k)
    lowest = all_.groupBy("node").agg(F.min("doc_id").alias("low")).join(root, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = stored(lowest, "nodes")
    of = lowest.join(lowest.groupBy("root").agg(F.min("low").alias("class_id")), "root").select("node", "class_id")
    return all_.join(stored(of, "of"), "node").select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the smallest id, null ids last, then the smallest digest of the whole row.

    Rows that share an id but not a class both stay, as do null ids with texts of their own; of rows that are equal
    in all columns one stays. An empty table gives none.
    """
    all_, root = _resolved(docs, "doc_id", "text", SIMILARITY, SHINGLE)
    of = all_.join(root, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root"))
    kept = stored(of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("x")).select(F.col("x.row").alias("__row")), "kept")
    twice = stored(all_.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias("__row")).join(kept, "__row", "left_semi"), "twice")
    named = docs.withColumn("__row", row_digest(docs))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = named.join(small(kept.join(twice, "__row", "left_anti")), "__row", "left_semi").select(*cols)
    if twice.isEmpty():
        return once
    again = named.join(small(twice), "__row", "left_semi").dropDuplicates(["__row"]).select(*cols)  # equal rows: any is the same
    return once.unionByName(again)
