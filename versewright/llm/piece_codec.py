"""Exact sentencepiece encoding by backtracking, and decoding.

Aho-Corasick gives, for each place of a unit, the pieces that start there. The encoder takes the longest
one that is compatible with the token before it: two tokens are if merging their joined characters from
scratch gives the two tokens again. A sequence whose neighbours are all compatible is the encoding, as the
first merge across a border would show in the two tokens at that border. At a dead end the encoder steps
back to a shorter piece; a bitfield keeps the places from which no rest of the unit can be encoded.
"""

from __future__ import annotations

import codecs
import hashlib
from itertools import chain, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import SPACE, load

#: Units, and token pairs, that a Python worker keeps, some 150 MB. The half that came first stays: frequent units come early.
KEPT = 600_000

codecs.register_error("versewright-bytes", lambda e: ("�" * (e.end - e.start), e.end))


class Codec(dict):
    """Ids by unit, filled as units come; ``encode`` and ``decode`` work on whole texts."""

    def __init__(self, path: str):
        import ahocorasick

        super().__init__()
        self.p = load(path)
        self.found = ahocorasick.Automaton()
        for name in self.p.ids:
            self.found.add_word(name, name)
        self.found.make_automaton()
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.bytes_of = [b"" if i in self.p.control else name.replace(SPACE, " ").encode() for i, name in enumerate(self.p.names)]
        for b, i in self.p.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        for i in self.p.control:
            self.bytes_of[i] = b" \xe2\x81\x87 " if self.p.names[i] == "<unk>" else b""
        self.spaced = {i for name, i in self.p.ids.items() if name.startswith(SPACE)}

    def compatible(self, before: str | None, name: str) -> bool:
        """Whether the two tokens stand when their characters are merged from scratch (alone at the start of a unit)."""
        key = (before, name)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > KEPT:
                self.fits.clear()
            known = self.fits[key] = self.p.merged((before or "") + name) == ((before, name) if before else (name,))
        return known

    def pieces(self, unit: str) -> list[str]:
        """The tokens of a unit: its longest matches if all neighbours fit, else by backtracking."""
        path, before, fits = [], None, self.fits
        at = 0
        for end, name in self.found.iter_long(unit):
            if (known := fits.get((before, name))) is None:
                known = self.compatible(before, name)
            if not known or end - len(name) + 1 != at:
                break
            path.append(name)
            before, at = name, end + 1
        else:
            if at == len(unit):
                return path
        starts: list[list[str]] = [[] for _ in unit]
        for end, name in self.found.iter(unit):
            starts[end - len(name) + 1].append(name)  # ends ascend, so the longest of a place is its last
        n, at, failed, path = len(unit), 0, 0, []
        tried: list[int] = []  # for each token of the path, its index among the pieces of its place
        k = len(starts[0]) - 1
        while at < n:
            if not starts[at]:  # outside the vocabulary: no piece has it, so nothing merges with it
                path.append(unit[at])
                tried.append(-1)
                at += 1
            else:
                before = path[-1] if path and tried[-1] >= 0 else None
                here = starts[at]
                while k >= 0:
                    name = here[k]
                    if not failed >> (at + len(name)) & 1:
                        if (known := fits.get((before, name))) is None:
                            known = self.compatible(before, name)
                        if known:
                            break
                    k -= 1
                if k < 0:
                    failed |= 1 << at
                    if not path or tried[-1] < 0:
                        raise ValueError(f"no encoding: {unit!r}")
                    at -= len(path.pop())
                    k = tried.pop() - 1
                    continue
                path.append(name)
                tried.append(k)
                at += len(name)
            k = len(starts[at]) - 1 if at < n else -1
        return path

    def __missing__(self, unit: str) -> tuple[int, ...]:
        if len(self) > KEPT:
            first = dict(islice(self.items(), KEPT // 2))
            self.clear()
            self.update(first)
        get, as_bytes = self.p.ids.get, self.p.byte_ids
        out: list[int] = []
        for part in self.p.cut(unit) if len(unit) > 48 else (unit,):
            for name in self.pieces(part):
                i = get(name)
                if i is None:
                    out += [as_bytes[b] for b in name.encode("utf-8", "surrogatepass")]
                else:
                    out.append(i)
        self[unit] = ids = tuple(out)
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.p.split(text))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; each byte that is no UTF-8 becomes U+FFFD, and the dummy prefix goes."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1 if ids and ids[0] in self.spaced else 0 :].decode("utf-8", "versewright-bytes")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(text: Column, model: str) -> Column:
    """array<int> of ids of each text; null counts as empty."""

    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        c = codec(model)
        return pd.Series([c.encode(t) for t in s], index=s.index, dtype=object)

    return encode(F.coalesce(text, F.lit("")))


def decoded(ids: Column, model: str) -> Column:
    """The text of each array of ids; null counts as empty."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        c = codec(model)
        return pd.Series([c.decode([] if x is None else list(x)) for x in s], index=s.index, dtype=object)

    return decode(ids)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, same) of every row; same: the decoded text is the text.

    Ids are hashed in the worker that makes them, so that only digests leave it. Null and empty texts have
    no ids; repeated rows and null ids stay; other columns are not read.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
    def digest(s: pd.Series) -> pd.DataFrame:
        c, rows = codec(model), []
        for t in s:
            ids = c.encode(t)
            back = c.decode(ids)
            rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "same"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return d.withColumn("d", digest("t")).select("doc_id", "d.*")
