"""URL filter: rules by host and path, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled table of URLs. A URL's features are the distinct hashes of the n-grams of its
host and its path, as a vector of length 1. Training goes by gradient descent on the rows' shares in the weights (one
number a labelled row; the weights are their sums over a hash's rows), so that it is one expression over one row.
Weights are rounded to whole billionths: scores are sums of whole numbers, alike in whatever order. All of it is
DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Lengths of the n-grams, the hashes' base and their number (a prime).
SIZES, BASE, BUCKETS = (3, 4, 5), 257, 65521
#: Rounds and step of the descent, and the value of the constant feature.
ROUNDS, STEP, CONSTANT = 400, 0.12, 0.25
#: Labelled rows at most; training holds each against each, in one row.
LABELLED_MOST = 1000
#: Weights are whole numbers of 1 / UNIT.
UNIT = 10**9

#: (host, path, verdict): each fits its host and all subdomains where the path starts with its own.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)

_BLOCKED = ("casino", "poker", "bets", "pills", "loans", "adult", "porn", "spam", "ads", "track", "viagra", "warez", "jackpot", "clicks")
_PUSHING = ("cheap", "free", "win", "hot", "fast", "best", "farm", "bonus")
_PLAIN = ("library", "museum", "garden", "school", "weather", "kitchen", "history", "theatre", "science", "travel", "river", "market", "village", "press")
_QUIET = ("city", "north", "open", "old", "daily", "green", "local", "first")
_SYLLABLES = ("lor", "en", "ta", "bri", "shol", "we", "nth", "er", "ti", "on", "mer", "di", "ha", "ing", "cas", "dre", "bat", "pil", "ton", "ade", "lan", "es", "st", "ou", "ly", "or", "and", "re")
_FRONT, _END, _PATH = ("", "www.", "m.", "blog."), ("com", "net", "org"), ("/", "/en/12", "/de/730/", "/fr/58.html", "/es/401", "/news/2019/7", "?b=1")


def labelled_rows() -> list[tuple[str, int]]:
    """The labelled table: (url, 1 to block, 0 to allow). Both kinds have the same fronts, ends and paths."""
    out = []

    def add(name: str, label: int) -> None:
        n = sum(x == label for _, x in out)  # of its kind: both kinds are dealt alike
        out.append((f"http{'s' * (n // 2 % 2)}://{_FRONT[(n + n // 4) % 4]}{name}.example.{_END[n % 3]}{_PATH[n % 7]}", label))

    for i in range(14):
        for label, word in ((1, _BLOCKED[i]), (0, _PLAIN[i])):  # beside the same other words
            a, b, c, d = _PUSHING[i % 8], _QUIET[i % 8], _PUSHING[(i + 3) % 8], _QUIET[(i + 5) % 8]
            for name in (f"{word}-{a}", f"{b}-{word}", f"{c}{word}", f"{word}{d}"):
                add(name, label)
        for j in range(4):  # names that mean nothing
            add("".join(_SYLLABLES[(5 * i + 11 * j + k * (3 + j)) % 28] for k in range(3)), 0)
    return out


def labelled(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{url}', {label})" for url, label in labelled_rows())
    return spark.sql(f"select url, label from values {rows} as t (url, label)")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (its A-Z in lower case) and path; a null URL and one without :// have two empty ones."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, host and path counted together, then host; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def codes(text: Column) -> Column:
    """Code points of a text between two marks."""
    return F.concat(F.array(F.lit(2)), F.transform(F.regexp_extract_all(text, F.lit(r"(?s)."), 0), F.ascii), F.array(F.lit(3)))


def _grams(c: Column, part: int) -> Column:
    """Hashes of the n-grams of an array of code points; part 0 is the host, 1 the path."""

    def of(n: int) -> Column:
        value = lambda i: sum((F.get(c, i + j).cast("long") * BASE ** (n - 1 - j) for j in range(n)), F.lit(10007 * (2 * n + part)))
        each = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.pmod(value(i), F.lit(BUCKETS)).cast("int"))
        return F.when(F.size(c) >= n, each).otherwise(F.array().cast("array<int>"))

    return F.concat(*map(of, SIZES))


def features(df: DataFrame) -> DataFrame:
    """df(host, path, ...) and x, the distinct hashes of the n-grams of host and path, in order of value."""
    coded = df.withColumns({"__h": codes(F.col("host")), "__p": codes(F.col("path"))})
    return coded.withColumn("x", F.array_sort(F.array_distinct(F.concat(_grams(F.col("__h"), 0), _grams(F.col("__p"), 1))))).drop("__h", "__p")


def fit(table: DataFrame) -> tuple[int, dict[int, int]]:
    """(constant, weights by hash) from a table (url, label); rows with nulls are left out, repeated rows count as often.

    A table without rows gives a model that blocks nothing. More than LABELLED_MOST rows are an error.
    """
    host, path = parts(F.col("url"))
    rows = features(table.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("y"), host.alias("host"), path.alias("path"))).where(F.size("x") > 0)
    one = stored(rows.select("url", "y", "x").limit(LABELLED_MOST + 1).agg(F.sort_array(F.collect_list(F.struct("url", "y", "x"))).alias("r")), "labelled")
    if one.select(F.size("r")).first()[0] > LABELLED_MOST:
        raise ValueError(f"more than {LABELLED_MOST} labelled URLs")
    like = F.transform("r", lambda a: F.transform("r", lambda b: F.size(F.array_intersect(a["x"], b["x"])) / F.sqrt(F.size(a["x"]).cast("double") * F.size(b["x"])) + CONSTANT**2))
    alike = stored(one.select("r", F.transform("r", lambda a: a["y"]).alias("y"), like.alias("k")), "alike")  # else it's worked out again in each round

    def round_(s: Column) -> Column:
        dot = lambda row: F.aggregate(F.zip_with(row, s, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
        miss = F.zip_with("k", "y", lambda row, y: y - 1 / (1 + F.exp(-dot(row))))
        return F.zip_with(s, miss, lambda a, d: a + STEP * d)

    shares = stored(alike.select("r", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.transform("r", lambda a: F.lit(0.0)), lambda s, _: round_(s)).alias("s")), "shares")
    each = shares.select(F.explode(F.arrays_zip("r", "s")).alias("z")).select("z.r.x", F.col("z.s").alias("s"))
    constant = each.agg(F.sum(F.round(F.col("s") * (CONSTANT**2 * UNIT)).cast("long"))).first()[0] or 0
    weights = each.select(F.explode("x").alias("h"), F.round(F.col("s") / F.sqrt(F.size("x").cast("double")) * UNIT).cast("long").alias("w")).groupBy("h").agg(F.sum("w").alias("w"))
    out = constant, {r["h"]: r["w"] for r in weights.collect()}  # BUCKETS at most
    drop_stored(one, alike, shares)
    return out


def score(x: Column, model: tuple[int, dict[int, int]]) -> Column:
    """A URL's score times the length of its vector: above 0 if to block is likelier than not; 0 without features."""
    constant, weights = model
    table = F.split(F.lit(",".join(str(weights.get(h, 0)) for h in range(BUCKETS))), ",").cast("array<bigint>")  # a constant, folded once
    total = F.aggregate(x, F.lit(0).cast("long"), lambda s, h: s + F.get(table, h))
    return total + constant * F.sqrt(F.size(x).cast("double"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, table: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row: the verdict is the rule's, or else the model's.

    A null URL, and one without ://, has an empty host and path and is allowed, as nothing speaks against it. Repeated rows
    and null ids stay as they are; equal URLs get equal verdicts; a score of exactly 0 allows. Rules are a list that each
    URL is held against, so a short one. Other columns are not read, whatever their names.
    """
    model = fit(labelled(pages.sparkSession) if table is None else table)
    host, path = parts(F.col("url"))
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    d = features(d).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(score(F.col("x"), model) > 0, F.lit("block")).otherwise(F.lit("allow"))
    return d.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"))
