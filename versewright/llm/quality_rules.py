"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document; its bit and the measurements behind it are stored. Policies
are versioned sets of rules, applied to the stored bits, and ablations are aggregates over the bits: no
text is read again. All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """One bit of the ledger; ``fails`` is a condition over the measurements."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of what counts: the names of the rules that reject a document."""

    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 16 * n_words)"),
    Rule(5, "bullets", "n_lines >= 4 and 100 * n_bullet_lines > 90 * n_lines"),
    Rule(6, "cut_lines", "n_lines >= 4 and 100 * n_cut_lines > 30 * n_lines"),
    Rule(7, "few_letters", "100 * n_letter_words < 80 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("v1", ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length"))
LAYOUT = Policy("v2", tuple(r.name for r in RULES))


def measure(docs: DataFrame, text_col: str = "text", k: int = 5) -> DataFrame:
    """docs with a struct column ``measures``; other columns stay, also one that has a measurement's name.

    Words are runs without the six ASCII blanks. ``n_repeat_words``: words inside windows of k words that
    occur twice or more in the text; windows are compared by 64-bit hashes of the words' hashes. A null text
    counts as empty; an empty text has 0 everywhere.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("__words", F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    d = d.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(BLANKS)) != ""))
    d = d.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    n = F.size("__words")
    window = lambda i: F.xxhash64(*[F.get(F.col("__h"), i + j) for j in range(k)])
    d = d.withColumn("__w", F.when(n > k, F.transform(F.sequence(F.lit(0), n - k), window)).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("__w")) < F.size("__w")
    d = d.withColumn("__s", F.when(twice, F.array_sort(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda s, at: F.coalesce(F.get(F.col("__s"), at)["h"] == s["h"], F.lit(False))
    d = d.withColumn("__p", F.array_sort(F.transform(F.filter("__s", lambda s, j: same(s, j - 1) | same(s, j + 1)), lambda s: s["i"])))
    covered = F.aggregate(
        "__p", F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(k), x - a["last"])).alias("n")), lambda a: a["n"],
    )
    measures = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("__lines", lambda x: x.rlike(r"^[ \t-\r]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("__lines", lambda x: x.rlike(r"(?:\.\.\.|…)[ \t-\r]*$"))).cast("long").alias("n_cut_lines"),
        F.size(F.filter("__words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
    )
    return d.withColumn("measures", measures).drop("__words", "__lines", "__h", "__w", "__s", "__p")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with ``measures`` and ``fail_bits`` long: bit b is set if the rule with that bit fails."""
    d = measure(docs, text_col)
    names = d.schema["measures"].dataType.names
    bits = [F.when(_over(r.fails, names), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    return d.withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")))


def _over(condition: str, names: list[str]) -> Column:
    import re

    return F.expr(re.sub(r"\b(" + "|".join(names) + r")\b", r"measures.\1", condition))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of a policy's rules; a name without a rule is an error."""
    bit = {r.name: 1 << r.bit for r in rules}
    return reduce(lambda a, name: a | bit[name], policy.rules, 0)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: Column | None = None) -> Column:
    """Whether a document with these bits is kept under a policy."""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def applied(stored: DataFrame, policies: tuple[Policy, ...] = (BASE, STRICT, LAYOUT), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A stored ledger with a boolean column kept_<version> for each policy: versions are compared without a text being read."""
    return stored.select("*", *[passes(p, rules).alias(f"kept_{p.version}") for p in policies])


def ablation(stored: DataFrame, policies: tuple[Policy, ...] = (BASE, STRICT, LAYOUT), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule of it: documents that fail the rule, that fail it alone, and what is kept without it.

    The ledger is first counted by its bits, of which there are at most 2^rules, before anything is joined.
    """
    by = stored.groupBy("fail_bits").agg(F.count("*").alias("n"))
    plan = [F.struct(F.lit(p.version).alias("policy"), F.lit(name).alias("rule"), F.lit(mask(p, rules)).cast("long").alias("all"), F.lit(mask(Policy("", (name,)), rules)).cast("long").alias("one")) for p in policies for name in p.rules]
    d = by.select("fail_bits", "n", F.explode(F.array(*plan)).alias("p")).select("fail_bits", "n", "p.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("all"))
    return d.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("one")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("one"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("one"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def verdicts(docs: DataFrame, policy: Policy = STRICT, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, fail_bits, base_failed, kept) of every row; repeated rows and null ids stay."""
    d = ledger(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules)
    base = ~passes(BASE, rules)
    return d.select("doc_id", "measures.*", "fail_bits", base.alias("base_failed"), (~base & passes(policy, rules)).alias("kept"))


def keep(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of docs that the policy and the base rules keep, with docs' own columns.

    The filter leans on a column that isn't deterministic, so that it stays above the measurements: pushed
    below them, it would work the arrays of words out again for each window.
    """
    cols = docs.columns
    rules = tuple(r for r in RULES if r.name in (*BASE.rules, *policy.rules))
    d = ledger(docs, rules).withColumn("__at", F.monotonically_increasing_id())
    return d.where(passes(BASE, rules) & passes(policy, rules) & (F.col("__at") >= 0)).select(*[F.col(f"`{c}`") for c in cols])
