"""Many names looked for in many texts at once: a goto/fail automaton in flat arrays.

The automaton goes to each worker once, with the function that uses it. A worker lays the texts of a batch end to end and
parts them into strips of equal width, each led in by as many characters as the longest name has: the state behind them
doesn't depend on what comes before. All strips step through the automaton together, a column of characters at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a strip besides its lead-in, and characters that are matched at once.
STRIP, AT_ONCE = 512, 4_000_000
#: Names in one automaton; more are parted over several.
NAMES = 100_000
_NONE = np.iinfo(np.int32).max


class Matcher:
    """names: (name, rank) in any order; a name that occurs has its least rank, a text that of the least of its names."""

    def __init__(self, names: Sequence[tuple[str, int]]):
        names = [(n, r) for n, r in names if n]
        self.longest = max((len(n) for n, _ in names), default=0)
        alphabet = sorted({c for n, _ in names for c in n})
        self.letters = np.array([ord(c) for c in alphabet], np.uint32)
        number = {c: i for i, c in enumerate(alphabet)}
        self.size = max(1, len(alphabet))
        edges: dict[int, int] = {}  # state and letter to state
        best = [_NONE]
        for name, rank in names:
            at = 0
            for c in name:
                key = at * self.size + number[c]
                if key not in edges:
                    edges[key] = len(best)
                    best.append(_NONE)
                at = edges[key]
            best[at] = min(best[at], rank)
        children: list[list[tuple[int, int]]] = [[] for _ in best]
        for key, to in edges.items():
            children[key // self.size].append((key % self.size, to))
        fail, queue = [0] * len(best), [0]
        for at in queue:  # by depth: what a state falls back to is known, and what occurs with it
            for c, to in children[at]:
                back = fail[at]
                while at and back and back * self.size + c not in edges:
                    back = fail[back]
                fail[to] = edges.get(back * self.size + c, 0) if at else 0
                best[to] = min(best[to], best[fail[to]])
                queue.append(to)
        order = sorted(edges)
        self.keys, self.to = np.array(order, np.int64), np.array([edges[k] for k in order], np.int32)
        self.fail, self.best = np.array(fail, np.int32), np.array(best, np.int32)

    def ranks(self, texts: Sequence[str]) -> np.ndarray:
        """The least rank of each text, a very large one where no name occurs."""
        out = np.full(len(texts), _NONE, np.int32)
        at = 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and (end == at or n + len(texts[end]) < AT_ONCE):
                n += len(texts[end]) + 1
                end += 1
            out[at:end] = self._ranks(texts[at:end])
            at = end
        return out

    def _ranks(self, texts: Sequence[str]) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(texts), _NONE, np.int32)
        x = np.frombuffer("".join(f"{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.letters, x), len(self.letters) - 1)
        letter = np.where((self.letters[place] == x) & (x > 0), place, -1).astype(np.int32)
        lead = self.longest - 1
        strips = -(-len(letter) // STRIP)
        wide = np.full(lead + strips * STRIP, -1, np.int32)
        wide[lead : lead + len(letter)] = letter
        rows = np.lib.stride_tricks.as_strided(wide, (strips, lead + STRIP), (STRIP * wide.itemsize, wide.itemsize))
        state, found = np.zeros(strips, np.int32), np.full((strips, STRIP), _NONE, np.int32)
        for column in range(lead + STRIP):
            state = self._step(state, rows[:, column])
            if column >= lead:
                found[:, column - lead] = self.best[state]
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.minimum.reduceat(found.ravel()[: len(letter)], np.r_[0, ends[:-1]])

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int32)
        open_, now = np.flatnonzero(letter >= 0), state[letter >= 0]
        while len(open_):
            key = now.astype(np.int64) * self.size + letter[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[open_[hit]] = self.to[at[hit]]
            rest = ~hit & (now > 0)  # the others fall back, those at the root stay there
            open_, now = open_[rest], self.fail[now[rest]]
        return out


def first_named(text: Column, names: Sequence[tuple[str, int]], values: Sequence[str]) -> Column:
    """values[rank] of the least rank among the names that a text holds; null if it holds none, or is null."""
    parts = [Matcher(names[i : i + NAMES]) for i in range(0, len(names), NAMES)]
    known = list(values)

    @F.pandas_udf("string")
    def find(s: pd.Series) -> pd.Series:
        texts = s.fillna("").tolist()
        best = np.full(len(texts), _NONE, np.int32)
        for m in parts:
            best = np.minimum(best, m.ranks(texts))
        return pd.Series([None if r == _NONE else known[r] for r in best.tolist()], index=s.index, dtype=object)

    return find(text)
