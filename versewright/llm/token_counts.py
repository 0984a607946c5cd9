"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch that haven't been counted yet lie one after another in flat numpy arrays. In each
round every sequence applies its lowest-rank pair, all sequences at once, until no sequence has a pair
left; the surviving symbols are counted. Counts of pre-tokens are kept in a bounded table, as most recur.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import load, runs

#: Pre-tokens whose counts a Python worker keeps: two generations of so many, some 60 MB in all.
KEPT = 250_000
NONE = 2**30


class Counter(dict):
    """Counts by pre-token; ``count(texts)`` counts a batch of whole texts."""

    def __init__(self, path: str):
        import numpy as np

        super().__init__()
        self.old: dict[str, int] = {}
        self.np, self.p = np, load(path)
        ids, rank = self.p.ids, self.p.rank
        self.symbol = np.full(0x110000, -1, np.int32)
        for name, i in ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        pairs, unsafe, often = [], set(), {}
        for name, r in rank.items():
            often[r] = often.get(r, 0) + 1
        for name, i in ids.items():
            for k in range(1, len(name)):
                a, b = ids.get(name[:k]), ids.get(name[k:])
                if a is not None and b is not None:
                    pairs.append((a * self.p.n + b, rank[name], i))
                    unsafe.update(x for x, t in ((a, name[:k]), (b, name[k:])) if rank[t] >= rank[name])
            if often[rank[name]] > 1:
                unsafe.add(i)
        pairs.sort()
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        #: merging a pair everywhere at once equals one by one if the piece it makes can't merge on before that pair does
        self.safe = np.ones(self.p.n, bool)
        self.safe[list(unsafe)] = False

    def look(self, a, b):
        """Rank and result of symbol pairs; NONE where there is no such piece."""
        np = self.np
        key = a.astype(np.int64) * self.p.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)

    def merge(self, units: list[str]):
        """Surviving symbols of each unit; a character outside the vocabulary counts its UTF-8 bytes."""
        np = self.np
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units)), size)
        sym = self.symbol[code]
        width = np.where(sym >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        out = np.bincount(owner, weights=width - 1, minlength=len(units)).astype(np.int64)  # what unknown characters have beyond one
        rank, made = self._all_pairs(sym, owner)
        while len(sym):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            low = np.minimum.reduceat(rank, first)
            done = low == NONE
            if done.any():
                out[owner[first[done]]] += count[done]
                keep = np.repeat(~done, count)
                sym, owner, rank, made = sym[keep], owner[keep], rank[keep], made[keep]
                if not len(sym):
                    break
                count, low = count[~done], low[~done]
            at = np.flatnonzero(rank == np.repeat(low, count))
            fresh = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            if not fresh.all():  # several places with that pair: all of them if safe, without overlaps, else the first
                cut = fresh | np.r_[True, at[1:] != at[:-1] + 1]
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(cut, np.arange(len(at)), 0))
                at = at[fresh | (self.safe[made[at]] & (place % 2 == 0))]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            here = np.cumsum(keep)[at] - 1
            sym, owner, rank, made = sym[keep], owner[keep], rank[keep], made[keep]
            near = np.zeros(len(sym) + 1, bool)
            near[here] = near[here - 1] = True  # -1 falls on the spare place
            again = np.flatnonzero(near[:-1])
            nxt = np.minimum(again + 1, len(sym) - 1)
            r, m = self.look(sym[again], sym[nxt])
            apart = (again == nxt) | (owner[again] != owner[nxt])
            rank[again], made[again] = np.where(apart, NONE, r), np.where(apart, -1, m)
        return out

    def _all_pairs(self, sym, owner):
        np = self.np
        r, m = self.look(sym[:-1], sym[1:])
        apart = owner[1:] != owner[:-1]
        return np.r_[np.where(apart, NONE, r), NONE], np.r_[np.where(apart, -1, m), -1]

    def count(self, texts) -> list[int]:
        out: list[int] = []
        for lo, hi in runs(texts):
            split = [self.p.split(t) for t in texts[lo:hi]]
            if len(self) > KEPT:
                self.old = self.copy()
                self.clear()
            new = set().union(*split).difference(self)
            again = new & self.old.keys()
            self.update((u, self.old[u]) for u in again)
            new = list(new - again)
            parts = [self.p.cut(u) if len(u) > 48 else [u] for u in new]
            flat = [x for p in parts for x in p]
            counts = self.merge(flat).tolist() if flat else []
            at = 0
            for u, p in zip(new, parts):
                self[u] = sum(counts[at : at + len(p)])
                at += len(p)
            out += [sum(map(self.__getitem__, s)) for s in split]
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each model and Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def n_tokens(text: Column, model: str) -> Column:
    """Tokens of each text as the library for the model file counts them, without begin, end or special tokens."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return pd.Series(counter(model).count(s.tolist()), index=s.index, dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay as they are; other
    columns are not read, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("n_tokens", n_tokens(F.col("t"), model))
    return d.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
