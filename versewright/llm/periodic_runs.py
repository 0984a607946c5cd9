"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on the segments that survive.

A run is a stretch of words with smallest period q (words q apart are equal) of at least max(least, 2 q) words that no
neighbouring word extends keeping q. Its words q apart agree over at least max(least, 2 q) - q >= ceil(least / 2) words:
so many words are the k of the mask. Each word of a run stands in a k-gram that occurs twice in its text, so words in
no such k-gram are in no run and part the text into segments; every run lies inside one.

Main-Lorentz halves a segment again and again; a run that crosses a middle m has, for its period p, the words m - p and
m or m and m + p equal, and reaches as far as the words before and after agree. All halves of a level, of all segments
and texts of a batch, go through numpy at once; how far words agree is found by doubling and halving over equal blocks
of hashes, and what is found is held against the words themselves, so that no result rests on a hash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import runs as slices
from .shingles import mixed

#: Words of the shortest run.
LEAST = 12
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD).findall
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class Agreement:
    """How far the words of x agree from two places on, forwards or backwards; x is a flat array of word numbers."""

    def __init__(self, x: np.ndarray, reach: int, seed: np.uint64):
        self.x, self.levels, n = x, [mixed((x.astype(np.uint64) + np.uint64(1)) * seed)], 1
        while 2 * n <= reach:
            h = self.levels[-1]
            self.levels.append(mixed(h[:-n] * seed + h[n:]) if len(h) > n else h[:0])  # of 2 n words from each place on
            n *= 2

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from a and from b on, most of them at most; a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):  # two of the longest blocks are more than any reach
            step, h = 1 << k, self.levels[k]
            at = np.flatnonzero(out + step <= most)
            out[at[h[a[at] + out[at]] == h[b[at] + out[at]]]] += step
        return out

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree before a and before b, most of them at most."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step, h = 1 << k, self.levels[k]
            at = np.flatnonzero(out + step <= most)
            out[at[h[a[at] - out[at] - step] == h[b[at] - out[at] - step]]] += step
        return out


def survivors(x: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """True for words in a k-gram that occurs twice in their text; equal hashes only let more words survive."""
    n, keep = len(x) - k + 1, np.zeros(len(x), bool)
    if n < 2:
        return keep
    h = text[:n].astype(np.uint64)
    for j in range(k):
        h = mixed(h * _SEEDS[0] + x[j : j + n].astype(np.uint64))
    places = np.flatnonzero(text[:n] == text[k - 1 :])
    h = h[places]
    order = np.argsort(h)
    same = np.zeros(len(h), bool)
    twice = h[order[1:]] == h[order[:-1]]
    same[order[1:]] = twice
    same[order[:-1]] |= twice
    return _covered(len(x), places[same], places[same] + k)


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True for the places of n that stand in one of the stretches."""
    return np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0


def segments(keep: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places (exclusive) of stretches of survivors of one text, those of at least so many words."""
    n = len(keep)
    start = keep & np.r_[True, ~keep[:-1] | (text[1:] != text[:-1])][:n]
    end = keep & np.r_[~keep[1:] | (text[1:] != text[:-1]), True][:n]
    lo, hi = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = hi - lo >= least
    return lo[long], hi[long]


def find(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs inside the segments, by start and period."""
    for seed in _SEEDS:
        out = _find(x, lo, hi, least, seed)
        if out is not None:
            return out
    raise RuntimeError("periodic runs: hashes of three seeds collided")


def _find(x, lo, hi, least, seed):
    if not len(lo):
        return np.zeros((0, 3), np.int64)
    agree = Agreement(x, int((hi - lo).max()), seed)
    found, b, e, whole = [], lo, hi, np.arange(len(lo))  # blocks and the segments they are of
    while len(b):
        m = (b + e) // 2
        for size, ahead in ((m - b, False), (e - m - 1, True)):  # periods that reach back from the middle, and ahead
            for chosen in _parts(size):
                own = np.repeat(chosen, size[chosen])
                p = np.arange(len(own)) - np.repeat(np.cumsum(size[chosen]) - size[chosen], size[chosen]) + 1
                left = m[own] - (0 if ahead else p)
                hit = x[left] == x[left + p]
                left, p, own = left[hit], p[hit], whole[own[hit]]
                after = agree.forward(left, left + p, hi[own] - left - p)
                before = agree.backward(left, left + p, left - lo[own])
                good = (after + before >= p) & (after + before + p >= least)
                found.append(np.stack([left[good] - before[good], left[good] + p[good] + after[good], p[good], own[good]], 1))
        keep = e - b >= 2 * least - 1  # else neither half has room for a run
        b, e, m, whole = b[keep], e[keep], m[keep], whole[keep]
        b, e, whole = np.r_[b, m], np.r_[m, e], np.r_[whole, whole]
        room = e - b >= least
        b, e, whole = b[room], e[room], whole[room]
    got = np.concatenate(found)
    got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
    got = got[np.r_[True, (got[1:, 0] != got[:-1, 0]) | (got[1:, 1] != got[:-1, 1])]] if len(got) else got  # a multiple of the period reaches as far
    if any(not _holds(x, lo[w], hi[w], s, t, p) for s, t, p, w in got.tolist()):
        return None
    return got[np.lexsort((got[:, 2], got[:, 0])), :3]


def _parts(size: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Numbers of blocks, parted so that the periods of a part are a bounded number (a larger block comes alone)."""
    part = np.cumsum(size) // most
    for k in np.unique(part[size > 0]):
        yield np.flatnonzero((part == k) & (size > 0))


def _holds(x, lo, hi, s, t, p) -> bool:
    """Whether words p apart agree from s to t, and no further inside the segment."""
    return bool((x[s : t - p] == x[s + p : t]).all()) and (s == lo or x[s - 1] != x[s - 1 + p]) and (t == hi or x[t] != x[t - p])


def analyse(texts: list[str | None], least: int = LEAST) -> list[tuple[list[tuple[int, int, int]], list[str]]]:
    """For each text its runs (start, length, period) and the words that stay: those that stand in no run after its first period."""
    out = []
    for a, z in slices(texts):
        lists = [_WORDS(t or "") for t in texts[a:z]]
        number = defaultdict(count().__next__).__getitem__
        x = np.fromiter(map(number, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        base = np.cumsum([0, *map(len, lists)])
        text = np.repeat(np.arange(len(lists)), np.diff(base))
        lo, hi = segments(survivors(x, text, max(1, (least + 1) // 2)), text, least)
        got = find(x, lo, hi, least)
        stays = ~_covered(len(x), got[:, 0] + got[:, 2], got[:, 1])
        of = text[got[:, 0]]
        first = np.searchsorted(of, np.arange(len(lists) + 1))
        triples = np.stack([got[:, 0] - base[of], got[:, 1] - got[:, 0], got[:, 2]], 1).tolist()
        for i, ws in enumerate(lists):
            mine = triples[first[i] : first[i + 1]]
            out.append(([tuple(t) for t in mine], [w for w, s in zip(ws, stays[base[i] : base[i + 1]].tolist()) if s] if mine else ws))
    return out


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs array<struct<start, length, period>> by start and period, collapsed string) of every row.

    collapsed has the words that stay, joined by one space. A null or empty text has no words: no runs and ''. Repeated
    rows, null and repeated ids are each looked at by their own text; other columns are not read, whatever their names.
    Ties have no part here: all runs are there. A text of any length is one task's, as it is one row.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, z in slices(texts):
                got = analyse(texts[a:z], least)
                rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r, _ in got], kind)
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), rows, pa.array([" ".join(w) for _, w in got], pa.string())], ["doc_id", "runs", "collapsed"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(each, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of every row, with a period put into the texts of ids whose CRC-32 ends in the digit 0.

    With g the CRC without that digit and n words, word i >= a = g % n becomes word a + (i - a) % p of the original, p =
    1 + floor((n - a) / (3 + g % 8)). A null id, a null text and a text without words stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("takes"))
    d = d.withColumn("w", F.when(F.col("takes"), F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)))
    n, a = F.size("w"), F.col("a")
    d = d.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    d = d.withColumn("p", (F.floor((n - a) / (F.col("g") % 8 + 3)) + 1).cast("int"))
    unit = F.slice("w", a + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / F.col("p")).cast("int"))), F.lit(1), n - a)
    return d.select("doc_id", F.when(a.isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per row of periodic_runs(): how many runs there are, the longest (the first of equals, of equals from one place that of
    the smallest period) and digests of all runs and of the collapsed text. Without runs the longest's columns are null."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return d.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.n").alias("length"), (-F.col("b.p")).alias("period"), F.expr("(1000 * b.n) div -b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
