"""Secret scans: fixed patterns, and Character Markov models compared by log-likelihood ratio.

Two first-order models over a fixed alphabet, of random strings and of ordinary identifiers, are counted
from labelled samples. A candidate token is a secret if its log-likelihood ratio is above a threshold. The
models meet as one array of ratios by character pair, whose size is the square of the alphabet's, so it
travels as a literal. All of it is DataFrame expressions.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The least lengths of these two stand in the patterns: a match that is too short has no longer one inside it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that the models judge: long, with a letter, and with a digit or a lower-case letter before an upper-case one.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])(?=[A-Za-z+/_=-]*+[0-9]|[A-Za-z0-9+/_=-]*[a-z][A-Z])[A-Za-z0-9+/_=-]{16,}"
#: Bound of the sample of documents from which ordinary identifiers are counted, and of made random strings.
SAMPLE_DOCS = 2000
SAMPLE_RANDOM = 4000
THRESHOLD = 8.0

_SPAN = "array<struct<s:int,k:int,e:int,kind:string>>"


def _spans(text: Column, pattern: str, kind: str, group: int, least: int, guard: str) -> Column:
    """Spans of a pattern's leftmost matches whose group has at least so many characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.zip_with(F.arrays_zip(found.alias("m"), part.alias("g")), F.split(text, pattern), lambda m, gap: F.struct(m["m"].alias("m"), m["g"].alias("g"), F.char_length(gap).alias("gap")))
    step = F.aggregate(
        F.filter(rows, lambda r: r["m"].isNotNull()), F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda a, r: F.struct(
            (a["at"] + r["gap"] + F.char_length(r["m"])).alias("at"),
            F.when(F.char_length(r["g"]) >= least, F.array_append(a["out"], F.struct((a["at"] + r["gap"]).alias("s"), F.lit(KINDS.index(kind)).alias("k"), (a["at"] + r["gap"] + F.char_length(r["m"])).alias("e"), F.lit(kind).alias("kind")))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.regexp_like(text, F.lit(guard)), step).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind: array of (s, k, e, kind), code points, e exclusive, in order."""
    return {
        "assign": _spans(text, ASSIGN, "assign", 2, 6, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
        "access": _spans(text, ACCESS, "access", 0, 20, ACCESS),
        "hex": _spans(text, HEX, "hex", 0, 24, HEX),
    }


def labelled_samples(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n_docs: int = SAMPLE_DOCS, n_random: int = SAMPLE_RANDOM) -> DataFrame:
    """(token, random) rows: made random strings, and words of the n_docs documents with the least hashed ids.

    Both bounds are parameters; neither grows with the input. The made strings are hex, base-64 and
    upper-case forms of SHA-256 digests. Words that base patterns would match are left out.
    """
    spark = docs.sparkSession
    made = spark.range(n_random).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("x"), "id")
    b64 = F.base64(F.unhex("x"))
    made = made.select(F.when(F.col("id") % 3 == 0, F.col("x")).when(F.col("id") % 3 == 1, b64).otherwise(F.upper(F.regexp_replace(b64, "[+/=]", ""))).alias("token"))
    ids = docs.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct().orderBy(F.xxhash64("__id"), "__id").limit(n_docs)
    words = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(ids), "__id", "left_semi")  # n_docs rows at most
    words = words.select(F.explode(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_-]{3,}[0-9]{0,2}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("token")).distinct()
    return made.select("token", F.lit(True).alias("random")).unionAll(words.where(~F.col("token").rlike("^AKIA|^[0-9a-f]{24,}")).select("token", F.lit(False).alias("random")))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios by character pair, from (token, random) rows.

    Only counts by label and pair come to the driver: at most twice the square of the alphabet. Without
    samples of a label its model is uniform. Null tokens and characters outside the alphabet don't count.
    """
    size = len(ALPHABET)
    place = F.transform(F.split(F.coalesce("token", F.lit("")), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    d = samples.select(F.col("random"), place.alias("p"))
    pairs = d.select("random", F.explode(F.zip_with("p", F.slice("p", 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("x"))
    counts = pairs.where("x.a >= 0 and x.b >= 0").groupBy("random", "x.a", "x.b").agg(F.count("*").alias("n")).collect()
    n = {True: [smooth] * (size * size), False: [smooth] * (size * size)}
    for r in counts:
        n[r["random"]][r["a"] * size + r["b"]] += r["n"]
    out = [0.0] * (size * size)
    for a in range(size):
        row = slice(a * size, (a + 1) * size)
        top, low = sum(n[True][row]), sum(n[False][row])
        for b in range(size):
            out[a * size + b] = round(math.log(n[True][a * size + b] / top) - math.log(n[False][a * size + b] / low), 6)
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token; 0 for one without pairs inside the alphabet."""
    size = len(ALPHABET)
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pair = lambda p: F.zip_with(p, F.slice(p, 2, 1 << 30), lambda a, b: a * size + b)  # noqa: E731  the last place has no next: null
    return F.aggregate(pair(place), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(table, i), F.lit(0.0)))


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``base`` and ``spans``: arrays of (s, k, e, kind) by start and kind; spans holds base's and the models'.

    Base patterns match as leftmost non-overlapping matches; the models judge tokens that no base span
    touches. A null text counts as empty and has no spans; repeated rows and null ids stay. The model is
    trained from labelled_samples(docs) if none is given; without any documents it is of made strings only.
    """
    if model is None:
        model = train(labelled_samples(docs, text_col, id_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = base_spans(text)
    d = docs.withColumn("__c", _spans(text, CANDIDATE, "markov", 0, 16, CANDIDATE))
    d = d.withColumn("base", F.array_sort(F.concat(*kinds.values())))
    free = lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    judged = F.filter("__c", lambda c: free(c) & (ratio(F.substring(text, c["s"] + 1, c["e"] - c["s"]), model) > threshold))
    return d.withColumn("spans", F.array_sort(F.concat("base", judged))).drop("__c")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, and spans that overlap it, put as one mark; the text itself if there are none."""
    text = F.coalesce(text, F.lit(""))
    step = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))
        .otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(mark)).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, step).otherwise(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    d = scan(docs.select("doc_id", "text"), model)
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """docs with secrets masked in ``text`` and ``n_chars`` brought up to date where they were; all rows and columns stay."""
    cols = docs.columns
    d = scan(docs, model)
    hit = F.size("spans") > 0
    d = d.withColumn("text", F.when(hit, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    if "n_chars" in cols:
        d = d.withColumn("n_chars", F.when(hit, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*[F.col(f"`{c}`") for c in cols])

