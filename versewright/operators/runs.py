"""Paragraphs as runs: edits of the joined text that go back to their runs, and paragraphs parted where a chapter or verse begins.

The runs of a paragraph are one array, their lengths' prefix sums an interval map between places of the joined text and
runs. An edit changes the runs that it lies in and no other; a cut parts the run that it falls in, and both halves keep
its style. What a paragraph begins depends on the chapter that is open: that is carried over the lines of a document.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versewright.functions import headings as H
from versewright.functions import patterns as P
from versewright.functions import text as T

from .documents import leading_verse
from .lookups import small
from .ordered import all_carried

RUN = "struct<text:string,style:string,superscript:boolean,kind:string>"
_D = "[0-9٠-٩۰-۹]"
# A number that repeats a marker before it, and what may stand behind it.
_REPEATED = re.compile(rf"\s*({_D}{{1,3}})(\s*[۔.):\-])?\s*")


class Offsets:
    """Places of the joined text of some runs."""

    def __init__(self, texts: Sequence[str]):
        self.texts, self.starts = list(texts), [0, *accumulate(map(len, texts))]

    def at(self, place: int) -> int:
        """The run that a place lies in; the end belongs to the last run."""
        return max(0, min(bisect_right(self.starts, place) - 1, len(self.texts) - 1))

    def edited(self, edits: Sequence[tuple[int, int, str]]) -> list[str]:
        """The runs' texts after edits (place, length, new text), which are in order and don't overlap. New text goes to the run
        that the edit begins in."""
        out: list[list[str]] = [[] for _ in self.texts]

        def keep(lo: int, hi: int) -> None:
            while lo < hi:
                i = self.at(lo)
                end = min(hi, self.starts[i + 1])
                out[i].append(self.texts[i][lo - self.starts[i] : end - self.starts[i]])
                lo = end

        now = 0
        for place, length, new in edits:
            keep(now, place)
            if new:
                out[self.at(place)].append(new)
            now = place + length
        keep(now, self.starts[-1])
        return ["".join(x) for x in out]


def edited(runs: Column, pattern: str, new: str) -> Column:
    """Runs whose joined text has a pattern replaced, wherever the matches lie; footnotes and breaks are no text. pattern is
    Python's, new has no groups."""
    find = re.compile(pattern)

    @F.pandas_udf(f"array<{RUN}>")
    def change(s: pd.Series) -> pd.Series:
        out = []
        for rs in s:
            if rs is None:
                out.append(None)
                continue
            rows = [dict(r) for r in rs]
            own = [r for r in rows if r["kind"] == "text"]
            o = Offsets([r["text"] or "" for r in own])
            edits = [(m.start(), m.end() - m.start(), new) for m in find.finditer("".join(o.texts))]
            for r, t in zip(own, o.edited(edits) if edits else o.texts):
                r["text"] = t
            out.append(rows)
        return pd.Series(out, index=s.index, dtype=object)

    return change(runs)


def marker_case(runs: Column) -> Column:
    """Verse markers written with a capital V are small, also where a marker lies in several runs."""
    return edited(runs, rf"(?<=\\)V(?=\s*{_D})", "v")


def _number(raw: str) -> int | None:
    t = raw.strip()
    return int(t) or None if re.fullmatch(f"{_D}{{1,9}}", t) else None


def _suffix(a: int, b: int) -> bool:
    x, y = str(a), str(b)
    return a != b and len(x) != len(y) and (x.endswith(y) or y.endswith(x))


def _superscript(line: list[dict], i: int) -> int | None:
    """The verse that a superscript run marks: the text behind it repeats the number, or in Arabic digits before a stop its last digits."""
    r = line[i]
    n = _number(r["text"] or "") if r["superscript"] and r["kind"] == "text" else None
    if n is None or n > P.MOST_VERSES:
        return None
    m = _REPEATED.match("".join(x["text"] or "" for x in line[i + 1 :] if x["kind"] == "text"))
    again = _number(m[1]) if m else None
    if again is None or again == n:
        return again
    return max(n, again) if m[2] and not m[1].isascii() and _suffix(n, again) else None


def _logical(runs: list[dict]) -> tuple[list[list[dict]], int]:
    """Lines of a paragraph (its breaks part them, and superscript verse numbers, which become plain ones), and how many runs changed."""
    lines: list[list[dict]] = [[]]
    for r in runs:
        if r["kind"] == "break":
            lines.append([])
        else:
            lines[-1].append(dict(r))
    out, changed = [], 0
    for line in lines:
        marks, last = {}, 0
        for i in range(len(line)):
            if (n := _superscript(line, i)) is not None and n > last:
                marks[i] = last = n
        for i, n in marks.items():
            behind = [r for r in line[i + 1 :] if r["kind"] == "text"]
            o = Offsets([r["text"] or "" for r in behind])
            joined = "".join(o.texts)
            m = _REPEATED.match(joined)
            again = _number(m[1]) if m else None
            if again is None or (again != n and not _suffix(again, n)):
                continue
            end = m.end()
            rest = len(joined) > end and not joined[end].isspace()
            new = o.edited([(0, end, "")])
            if rest:
                new[o.at(end)] = " " + new[o.at(end)]
            for r, t in zip(behind, new):
                changed += t != r["text"]
                r["text"] = t
        part: list[dict] = []
        parts = [part]
        for i, r in enumerate(line):
            if i in marks:
                part = [r | {"text": str(marks[i]), "superscript": False}]
                parts.append(part)
                changed += 1
            else:
                part.append(r)
        out += [p for p in parts if "".join(r["text"] or "" for r in p if r["kind"] == "text").strip()]
    return out, changed


def whole(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_no, runs) of paragraphs(doc_id, para_no, sub_no, runs) that were parted at their breaks."""
    gap = F.array(F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("style"), F.lit(False).alias("superscript"), F.lit("break").alias("kind")))
    d = paragraphs.groupBy("doc_id", "para_no").agg(F.array_sort(F.collect_list(F.struct("sub_no", "runs"))).alias("x"))
    return d.select("doc_id", "para_no", F.flatten(F.transform("x", lambda x, i: F.when(i > 0, F.concat(gap, x["runs"])).otherwise(x["runs"]))).alias("runs"))


def logical_lines(runs: Column) -> Column:
    """struct(lines array<array<run>>, changed int) of a paragraph's runs."""

    @F.pandas_udf(f"struct<lines:array<array<{RUN}>>,changed:int>")
    def part(s: pd.Series) -> pd.DataFrame:
        got = [_logical([dict(r) for r in rs] if rs is not None else []) for rs in s]
        return pd.DataFrame({"lines": [a for a, _ in got], "changed": [b for _, b in got]}, index=s.index)

    return part(runs)


def joined(runs: Column) -> Column:
    return F.array_join(F.transform(F.filter(runs, lambda r: r["kind"] == "text"), lambda r: F.coalesce(r["text"], F.lit(""))), "")


def restructured(paragraphs: DataFrame, versification: DataFrame) -> DataFrame:
    """(doc_id, para_no, part, runs, changed) of paragraphs(doc_id, para_no, runs, book, is_title): a paragraph for each line that begins a
    chapter or, in an open chapter, a verse that its book's chapter has; other lines stay with the one before, a break between.

    A title closes the chapter before it. A book that versification(book, chapter, max_verse) doesn't know, or null, allows any
    verse. Paragraphs without text have no rows; changed is whether the paragraph came out otherwise than it was.
    """
    p = paragraphs.select("doc_id", "para_no", "book", "is_title", logical_lines(F.col("runs")).alias("x"))
    d = p.select("doc_id", "para_no", "book", "is_title", F.col("x.changed").alias("edits"), F.posexplode("x.lines").alias("line_no", "runs"))
    d = d.withColumn("text", T.one_line(joined(F.col("runs"))))
    opens = H.chapter_number(F.col("text"))
    d = d.withColumn("opens", opens).withColumn("set", F.when(F.col("opens").isNotNull(), F.col("opens")).when((F.col("line_no") == 0) & F.col("is_title"), F.lit(0)))
    d = all_carried(d, [("set", "chapter", True)], ["doc_id"], [F.col("para_no").asc(), F.col("line_no").asc()])
    most = versification.groupBy(F.col("book").alias("__b"), F.col("chapter").alias("__c")).agg(F.max("max_verse").alias("most"))
    d = d.join(small(most), (F.col("book") == F.col("__b")) & (F.col("chapter") == F.col("__c")), "left").drop("__b", "__c")
    n = leading_verse(F.col("text"))
    begins = F.col("opens").isNotNull() | F.coalesce((F.col("chapter") > 0) & (n > 0) & ((F.coalesce("most", F.lit(0)) == 0) | (n <= F.col("most"))), F.lit(False))
    w = Window.partitionBy("doc_id", "para_no").orderBy("line_no")  # the lines of one paragraph
    d = d.withColumn("part", F.sum((begins | (F.row_number().over(w) == 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    gap = F.array(F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("style"), F.lit(False).alias("superscript"), F.lit("break").alias("kind")))
    lines = F.array_sort(F.collect_list(F.struct("line_no", "runs")))
    out = d.groupBy("doc_id", "para_no", "part", "edits").agg(lines.alias("x"))
    out = out.withColumn("runs", F.flatten(F.transform("x", lambda x, i: F.when(i > 0, F.concat(gap, x["runs"])).otherwise(x["runs"]))))
    many = F.max("part").over(Window.partitionBy("doc_id", "para_no"))
    return out.select("doc_id", "para_no", "part", "runs", ((many > 0) | (F.col("edits") > 0)).alias("changed"))
