"""Quotes by context, and verses that were run together on one line."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as T

_OPENS = rf"(?<![{P.SENTENCE_ENDS}])(?<=\A|[ \t{P.BEFORE_OPENER}])"
_GOES_ON = rf"(?=[ \t]*[^ \t{P.AFTER_CLOSER}])"
_WORD = "[A-Za-z0-9_]"


def by_context(text: Column, marks: str, opener: str, closer: str, keep: str = "") -> Column:
    """Each mark turned into the opener or closer that its neighbours ask for.

    ``keep`` is a pattern of marks that stay. A control character, which cleaned text has not, holds the
    place of openers until closers are set.
    """
    c = F.regexp_replace(text, f"{_OPENS}{keep}[{marks}]{_GOES_ON}", "\u0001")
    return F.replace(F.regexp_replace(c, f"{keep}[{marks}]", closer), F.lit("\u0001"), F.lit(opener))


def straight_converted(text: Column, arabic: Column) -> Column:
    """Straight quotes made directional, only where the Arabic convention holds; apostrophes within words stay."""
    single = f"(?:(?<!{_WORD})(?=')|(?='(?!{_WORD})))"
    return F.when(text.rlike("[\"']") & arabic, by_context(by_context(text, '"', "”", "“"), "'", "’", "‘", single)).otherwise(text)


def repaired(text: Column, arabic: Column) -> Column:
    """Wrong directional quotes: by context in the Arabic convention, else closers that follow a sentence's end and a space."""
    pairs = lambda opener, closer: F.replace(F.replace(text, F.lit("’’"), F.lit(opener)), F.lit("‘‘"), F.lit(closer))
    c = F.regexp_replace(pairs("“", "”"), rf"(?U)([{P.SENTENCE_ENDS}]\s+)”(?=\S)", "$1“")
    other = F.regexp_replace(c, rf"(?U)([{P.SENTENCE_ENDS}]\s+)‘(?=\S)", "$1’")
    return F.when(~text.rlike(f"[{P.QUOTE_MARKS}]"), text).when(arabic, by_context(by_context(pairs("”", "“"), "“”", "”", "“"), "‘’", "’", "‘")).otherwise(other)


def closers_paired(text: Column) -> Column:
    """A single closer without an opener becomes the double closer that is due at a sentence's end.

    Balances of open quotes run over the quotes of a text; what stands between them is only carried along.
    """
    due = F.regexp_replace(text, rf"(?<=[{P.SENTENCE_ENDS}][ \t]{{0,99}})‘(?=[ \t]*(?:\z|[\r\n]|\\v))", "\u0001")
    parts = F.split(due, "(?<=[“”’‘\u0001])|(?=[“”’‘\u0001])")
    less = lambda n: F.greatest(F.lit(0), n - 1)

    def step(s: Column, t: Column) -> Column:
        closer = t.isin("‘", "\u0001")
        double_due = (t == "\u0001") & (s["single"] == 0) & (s["double"] > 0)
        return F.struct(
            F.when(t == "“", s["double"] + 1).when((t == "”") | double_due, less(s["double"])).otherwise(s["double"]).alias("double"),
            F.when(t == "’", s["single"] + 1).when(closer, less(s["single"])).otherwise(s["single"]).alias("single"),
            F.concat(s["out"], F.array(F.when(double_due, "”").when(closer, "‘").otherwise(t))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("double"), F.lit(0).alias("single"), F.array().cast("array<string>").alias("out"))
    return F.when(text.contains("‘") & text.contains("“"), F.aggregate(parts, start, step, lambda s: F.array_join(s["out"], ""))).otherwise(text)


_NUMBER = "([0-9]{1,3}|[٠-٩]{1,3}|[۰-۹]{1,3})"
_CANDIDATE = re.compile(rf"(\s*\\[vV]\s*)?{_NUMBER}")
_REPEATED = re.compile(rf"\s*(?:\\[vV]\s*)?{_NUMBER}\s*[.)۔:]?\s*")
_ARTIFACT = re.compile(r"\s*[.)۔:]?\s*")


def _after_repeat(text: str, at: int, number: int) -> int:
    m = _REPEATED.match(text, at)
    return m.end() if m and int(m[1]) == number else at


def split_verses(first: int, text: str) -> list[tuple[int, str]]:
    """(number, text) of the verses in a line's body: a break is the next number at a boundary.

    Boundaries: a verse marker, the number twice, punctuation before it, or a full stop behind it.
    """
    now, start = first, _after_repeat(text, 0, first)
    at, out = start, []
    while m := _CANDIDATE.search(text, at):
        n, end = m.start(2), m.end(2)
        at = n + 1 if m[1] is None else m.end(1)
        if int(m[2]) != now + 1:
            at = max(at, n + 1)
            continue
        behind = _after_repeat(text, end, now + 1)
        digit = n > 0 and text[n - 1].isdigit()
        before = text[:n].rstrip() if n and text[n - 1].isspace() else text[:n]
        inline = n > 0 and not digit and ((before == "" or before[-1] in P.VERSE_BOUNDARY) if text[n - 1].isspace() else text[n - 1] in P.VERSE_BOUNDARY)
        dot = not digit and text[end : end + 1] == "." and (end + 1 == len(text) or text[end + 1].isspace() or text[end + 1].isalpha() or text[end + 1] in "\"'«“")
        if not (behind > end or m[1] is not None or inline or dot):
            at = n + 1
            continue
        piece = text[start : m.start()].strip() if m[1] is not None else text[start:n].strip()
        if piece:
            out.append((now, piece))
        now += 1
        start = at = behind if behind > end else _ARTIFACT.match(text, end + 1 if dot else end).end()
    if tail := text[start:].strip():
        out.append((now, tail))
    return out or [(first, text.strip())]


_VERSE_LINE = re.compile(r"^(\s*\\v\s*)(\d+)(\s+)(.*)$", re.I)


def _line_split(line: str) -> str:
    m = _VERSE_LINE.match(line)
    parts = split_verses(int(m[2]), m[4]) if m else []
    return " ".join(f"{m[1]}{n}{m[3]}{x}" for n, x in parts) if len(parts) > 1 else line


def verses_split(line: Column) -> Column:
    """A verse line with merged verses gets a marker for each; other lines stay."""
    return T.guarded(_line_split, line.rlike(rf"(?i)^\s*\\v\s*[0-9]+\s.*{P.DIGITS}"), line)


def split_lines(text: str) -> str:
    """verses_split for each line of a whole text."""
    return re.sub(r"[^\r\n]+", lambda m: _line_split(m[0]), text)


def decimal_suffix(a: Column, b: Column) -> Column:
    """Whether one number's digits end with the other's (8 and 38)."""
    x, y = a.cast("string"), b.cast("string")
    return (a > 0) & (b > 0) & (F.char_length(x) != F.char_length(y)) & (x.endswith(y) | y.endswith(x))
