"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each document (1 good, -1 bad, 0 nothing). Votes are counted by
pattern over all documents, and expectation-maximisation over the counted patterns estimates each
labeller's accuracy and the share of good documents. The posterior of a pattern is the soft label of its
documents. A linear scorer over hashed features of the words (the word and its shape) is trained on the
posteriors of a bounded sample and scores every whole text.
"""

from __future__ import annotations

import math
import uuid
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents whose features the scorer is trained on; the least hashed ids are taken.
SAMPLE = 4000
BUCKETS = 1 << 16
#: Words whose weights a Python worker keeps.
KEPT = 1_000_000


@dataclass(frozen=True)
class Labeller:
    """A heuristic: SQL conditions for a bad and a good vote over the features of ``measured``."""

    name: str
    bad: str
    good: str


LABELLERS = (
    Labeller("noise", "100 * (n_upper + n_symbols + n_marks) > 25 * n_letters", "100 * (n_upper + n_symbols + n_marks) < 12 * n_letters"),
    Labeller("characters", "100 * n_odd > 3 * n_chars", "100 * n_odd < n_chars"),
    Labeller("word_ends", "100 * n_odd_ends > 20 * n_words", "100 * n_odd_ends < 5 * n_words"),
    Labeller("sentences", "n_words >= 20 and 40 * n_stops < n_words", "n_words >= 20 and 25 * n_stops > n_words"),
    Labeller("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines", "n_lines >= 4 and n_dup_lines = 0"),
)


FEATURES = ("n_chars", "n_words", "n_letters", "n_upper", "n_symbols", "n_marks", "n_stops", "n_odd", "n_odd_ends", "n_lines", "n_dup_lines")
_LETTER, _UPPER, _BLANK, _MARK, _STOP, _SYMBOL, _ODD, _PLAIN = range(8)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point, from its Unicode category."""
    out = np.full(0x110000, _ODD, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category[0] == "L":
            out[c] = _UPPER if category == "Lu" else _LETTER
        elif category[0] in "NM":
            out[c] = _PLAIN
        elif chr(c).isspace():
            out[c] = _BLANK
    for chars, kind in ((",;:'\"()-", _PLAIN), (".?", _STOP), ("!", _MARK), ("#*$%&|<>", _SYMBOL)):
        for c in chars:
            out[ord(c)] = kind
    return out


def counts(text: str) -> tuple[int, ...]:
    """FEATURES of a text, from one pass over the kinds of its characters."""
    k = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    n = np.bincount(k, minlength=8).tolist()
    blank = k == _BLANK
    ends = np.r_[blank[1:], True] & ~blank if len(k) else blank
    odd = (k == _SYMBOL) | (k == _MARK) | (k == _ODD)
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        len(k), int(ends.sum()), n[_LETTER] + n[_UPPER], n[_UPPER], n[_SYMBOL], n[_MARK], n[_STOP], int(odd.sum()), int((odd & ends).sum()), len(lines), len(lines) - len(set(lines)),
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the struct ``__f`` of counts that the labellers read; a null text counts as empty."""

    @F.pandas_udf(", ".join(f"{f} long" for f in FEATURES))
    def count(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in s], columns=FEATURES)

    return docs.withColumn("__f", count(F.coalesce(F.col(text_col), F.lit(""))))


def votes(docs: DataFrame, labellers: tuple[Labeller, ...] = LABELLERS, text_col: str = "text") -> DataFrame:
    """docs with ``votes``: a letter for each labeller, b, g or a dash."""
    d = measured(docs, text_col)
    names = "|".join(d.schema["__f"].dataType.names)
    sql = lambda c: re.sub(rf"\b({names})\b", r"__f.\1", c)
    return d.withColumn("votes", F.concat(*[F.expr(f"case when {sql(x.bad)} then 'b' when {sql(x.good)} then 'g' else '-' end") for x in labellers])).drop("__f")


def estimate(patterns: dict[str, int], rounds: int = 300) -> tuple[list[dict[str, tuple[float, float]]], float, dict[str, float]]:
    """(accuracies, share of good documents, posterior of good by pattern) from counted vote patterns.

    A labeller's accuracies: for each vote, its chance for a good and for a bad document; votes are
    independent given the class. The start takes a bad vote for strong and a good one for weak evidence.
    Without documents there are no posteriors.
    """
    if not patterns:
        return [], 0.5, {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["gb-".index(c) for c in k] for k in keys])
    post = np.array([1 / (1 + math.exp(3.0 * k.count("b") - 0.5 * k.count("g"))) for k in keys])
    for _ in range(rounds):
        good = float((n @ post + 1) / (n.sum() + 2))
        odds = np.full(len(keys), math.log(good / (1 - good)))
        accuracy = []
        for j in range(v.shape[1]):
            mine = [[float((n * p)[v[:, j] == c].sum() + 0.5) for c in range(3)] for p in (post, 1 - post)]
            chance = [[x / sum(row) for x in row] for row in mine]
            accuracy.append({"gb-"[c]: (chance[0][c], chance[1][c]) for c in range(3)})
            odds += np.log(np.array(chance[0]) / np.array(chance[1]))[v[:, j]]
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return accuracy, good, dict(zip(keys, post.tolist()))


_SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]"), "A"), (re.compile(r"[a-zß-öø-ÿ]"), "a"), (re.compile(r"\d"), "0"), (re.compile(r"(.)\1+"), r"\1"))


def features(word: str) -> tuple[int, int]:
    """Hashed places of a word in lower case and of its shape."""
    shape = word
    for pattern, by in _SHAPES:
        shape = pattern.sub(by, shape)
    h = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) % BUCKETS
    return h("w " + word.lower()), h("s " + shape)


class Scorer(dict):
    """Weights by word; the score of a text is the mean over its words, put through the logistic function."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        if len(self) > KEPT:
            self.clear()
        a, b = features(word)
        w = self[word] = float(self.weights[a] + self.weights[b])
        return w

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        x = self.bias + (math.fsum(map(self.__getitem__, words)) / len(words) if words else 0.0)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def fit(rows: list[tuple[dict[int, float], float]], epochs: int = 30, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps over (share of words by feature, soft label); all zero without rows."""
    if not rows:
        return np.zeros(BUCKETS), 0.0
    at = np.concatenate([np.fromiter(r[0].keys(), np.int64, len(r[0])) for r in rows])
    x = np.concatenate([np.fromiter(r[0].values(), float, len(r[0])) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[1] for r in rows])
    w, b = np.zeros(BUCKETS), math.log((y.mean() + 0.01) / (1.01 - y.mean()))
    scale, b_scale = np.zeros(BUCKETS) + 1e-8, 1e-8
    for _ in range(epochs * 10):
        z = b + np.bincount(of, weights=x * w[at], minlength=len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(rows)
        grad = np.bincount(at, weights=x * g[of], minlength=BUCKETS) + decay * w
        scale += grad * grad
        w -= rate * grad / np.sqrt(scale)
        b_scale += g.sum() ** 2
        b -= rate * g.sum() / math.sqrt(b_scale)
    return w, b


def train(docs: DataFrame, labellers: tuple[Labeller, ...] = LABELLERS, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """(weights, bias, accuracies, share of good): votes of all documents, features of ``sample`` of them,
    chosen by a digest of id and text (rows equal in both count once).

    To the driver come the counts of vote patterns, at most 3 to the number of labellers, and the features
    of the sample.
    """
    counted = votes(docs.select(F.col(text_col).alias("text")), labellers).groupBy("votes").count().collect()
    accuracy, good, post = estimate({r["votes"]: r["count"] for r in counted})

    @F.pandas_udf("at array<int>, x array<float>")
    def featured(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            words = (t or "").split()
            seen: dict[int, float] = {}
            for w in words:
                for f in features(w):
                    seen[f] = seen.get(f, 0.0) + 1 / len(words)
            rows.append((list(seen), list(seen.values())))
        return pd.DataFrame(rows, columns=["at", "x"])

    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    key = F.xxhash64(F.coalesce(F.col("__id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    ids = d.select(key.alias("__k")).distinct().orderBy("__k").limit(sample)
    some = votes(d.withColumn("__k", key).join(F.broadcast(ids), "__k", "left_semi").dropDuplicates(["__k"]), labellers)  # ``sample`` rows at most
    got = some.select("votes", featured(F.coalesce("text", F.lit(""))).alias("f")).select("votes", "f.*").collect()
    w, b = fit([(dict(zip(r["at"], r["x"])), post[r["votes"]]) for r in got if r["at"]])
    return w, b, accuracy, good


_scorers: dict[str, Scorer] = {}


def scored(docs: DataFrame, model=None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, votes, score, kept) of every row; kept: the score is ``least`` or more.

    A null or empty text has no words, so only the bias scores it. Repeated rows and null ids stay; other
    columns are not read. Without documents there is nothing to learn and nothing to score.
    """
    w, b, *_ = model or train(docs, id_col=id_col, text_col=text_col)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.asarray(w, np.float32))  # BUCKETS floats
    name = uuid.uuid4().hex  # of this model: a worker that has another one's scorer makes a new one

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(sent.value, b)
        return pd.Series([round(_scorers[name].score(t), 6) for t in s], index=s.index, dtype=float)

    d = votes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    d = d.withColumn("score", score(F.coalesce("text", F.lit(""))))
    return d.select("doc_id", "votes", "score", (F.col("score") >= least).alias("kept"))
