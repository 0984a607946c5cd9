"""Merge-type sentencepiece vocabularies, and how a text falls apart into units that never merge.

The model file is read through the sentencepiece library (pieces, scores, kinds); all merging is done here.
A vocabulary qualifies if it has byte fallback, a dummy prefix and no other normalisation, and if the
escaped space occurs only at the front of pieces: then no merge crosses from another character to a space.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

SPACE = "▁"


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
        self.n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(self.n)]
        self.byte_ids: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.control: set[int] = set()
        for i, name in enumerate(self.names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:-1], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i):
                self.control.add(i)
            else:
                self.ids[name] = i
        levels = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        #: 0 merges first; pieces of equal score have equal ranks, and the leftmost of them merges first
        self.rank = {name: levels[sp.get_score(i)] for name, i in self.ids.items()}
        inner = {c for name in self.ids if len(name) > 1 for c in name}
        if any(SPACE in name.lstrip(SPACE) for name in self.ids) or len(self.byte_ids) != 256 or any(c not in self.ids for c in inner):
            raise ValueError("the model is not of the kind that is supported here")
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inner)
        #: finds the units of a text: a lone character that no longer piece has, or spaces and what follows them
        self.units = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+").findall
        self.joins = {name[i : i + 2] for name in self.ids for i in range(len(name) - 1)}

    def split(self, text: str | None) -> list[str]:
        """The units of a whole text; null and empty texts have none."""
        return self.units(SPACE + text.replace(" ", SPACE)) if text else []

    def cut(self, unit: str) -> list[str]:
        """A unit, parted where no piece has the two characters side by side; exact, as no merge can span that."""
        out, at = [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in self.joins:
                out.append(unit[at:i])
                at = i
        out.append(unit[at:])
        return out

    def merged(self, text: str) -> tuple[str, ...]:
        """The pieces of a short string, by merging its lowest-rank pair again and again."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """The vocabulary, read once in each Python worker."""
    return Pieces(path)


def runs(texts, chars: int = 1_000_000):
    """Slices of a batch with a bounded number of characters each (a longer text comes alone)."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t or "") > chars:
            yield at, i
            at, n = i, 0
        n += len(t or "")
    if at < len(texts):
        yield at, len(texts)
