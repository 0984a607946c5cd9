"""Word-processor documents to marked-up lines by paragraph styles, and what is done with converted lines: headings set
free, remaps, checks. conversion.py reads paragraphs without such styles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versewright.functions import headings as H
from versewright.functions import patterns as P
from versewright.functions import text as T

from .conversion import strip
from .ordered import numbered

# Style ids, custom properties, marker patterns and the names of issues.
STYLE_TITLE, STYLE_LABEL, STYLE_PARAGRAPH, STYLE_VERSE = "USFM_MT", "USFM_CL", "USFM_P", "USFM_V"
HEADERS = {"USFM_ID": "id", "USFM_IDE": "ide", "USFM_H": "h", "USFM_TOC1": "toc1", "USFM_TOC2": "toc2", "USFM_TOC3": "toc3"}
_D = "[0-9٠-٩۰-۹]"
REMAP_BOOK, REMAP_START = "Числа", "После"


def headers(props: DataFrame) -> DataFrame:
    """(doc_id, no, line): header lines of props(doc_id, name, value), in the order of HEADERS; blank values give none."""
    order = F.create_map(*[x for i, (k, m) in enumerate(HEADERS.items()) for x in (F.lit(k), F.struct(F.lit(i).alias("no"), F.lit(m).alias("marker")))])
    d = props.where(F.trim("value") != "").withColumn("m", F.try_element_at(order, F.col("name"))).where("m is not null")
    return d.select("doc_id", F.col("m.no").alias("no"), F.concat(F.lit("\\"), "m.marker", F.lit(" "), F.trim("value")).alias("line"))


def from_styles(paragraphs: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, issues) of paragraphs(doc_id, para_no, sub_no, style, runs) by their styles: titles, chapter labels, and paragraphs
    whose runs in the verse style are numbers. notes(doc_id, id, text) stand in line; text before the first number of a
    paragraph is an issue, not a verse. Parts of a paragraph are set a blank apart; its style is that of the first."""
    run = paragraphs.schema["runs"].dataType.elementType
    blank = F.array(F.struct(*[(F.lit({"text": " ", "kind": "text"}.get(f.name)).cast(f.dataType)).alias(f.name) for f in run.fields]))
    d = paragraphs.groupBy("doc_id", "para_no").agg(F.array_sort(F.collect_list(F.struct("sub_no", "style", "runs"))).alias("x"))
    d = d.select("doc_id", "para_no", F.col("x")[0]["style"].alias("style"), F.flatten(F.transform("x", lambda x, i: F.when(i > 0, F.concat(blank, x["runs"])).otherwise(x["runs"]))).alias("runs"))
    plain = strip(F.array_join(F.transform(F.filter("runs", lambda r: r["kind"] == "text"), lambda r: r["text"]), ""))
    marker = F.when(F.col("style") == STYLE_TITLE, "\\mt ").when(F.col("style") == STYLE_LABEL, "\\cl ").when(F.col("style") == STYLE_PARAGRAPH, "\\p")
    heads = d.select("doc_id", "para_no", F.lit(-1).cast("long").alias("sub"), "style", marker.alias("m"), plain.alias("t")).where("m is not null")
    heads = heads.where((F.col("style") == STYLE_PARAGRAPH) | (F.col("t") != "")).select("doc_id", "para_no", "sub", F.when(F.col("style") == STYLE_PARAGRAPH, F.col("m")).otherwise(F.concat("m", "t")).alias("line"))

    r = d.where(F.col("style") == STYLE_PARAGRAPH).select("doc_id", "para_no", F.posexplode("runs").alias("pos", "r")).select("doc_id", "para_no", "pos", F.col("r.text").alias("text"), F.col("r.kind").alias("kind"), F.col("r.style").alias("style"))
    known = notes.groupBy("doc_id", "id").agg(F.max_by("text", F.length("text")).alias("note"))
    r = r.join(known, (r["doc_id"] == known["doc_id"]) & (r["kind"] == "footnote") & (r["text"] == known["id"]), "left").drop(known["doc_id"])
    begins = (F.col("style") == STYLE_VERSE) & (F.col("kind") == "text")
    w = Window.partitionBy("doc_id", "para_no").orderBy("pos")  # the runs of one paragraph
    r = r.withColumn("begins", F.coalesce(begins, F.lit(False))).withColumn("verse", F.count(F.when(F.col("begins"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    note = strip(F.coalesce("note", F.lit("")))
    said = F.when(F.col("kind") == "footnote", F.when(note != "", F.concat(F.lit(" \\f + \\ft "), note, F.lit(" \\f*"))).otherwise("")).when(F.col("begins"), "").otherwise(F.col("text"))
    v = r.where("verse > 0").groupBy("doc_id", "para_no", "verse").agg(F.max(F.when(F.col("begins"), strip(F.col("text")))).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("t")))), lambda x: x["t"]), "").alias("t"))
    lines = heads.unionByName(v.select("doc_id", "para_no", F.col("verse").alias("sub"), F.concat(F.lit("\\v "), "n", F.lit(" "), strip(F.col("t"))).alias("line")))
    lines = numbered(lines, [F.col("para_no").asc(), F.col("sub").asc()], ["doc_id"], "line_no").select("doc_id", "line_no", "line")

    code = (
        F.when(F.col("begins"), F.when(strip(F.col("text")) == "", F.struct(F.lit("VERSE_NUMBER_EMPTY").alias("code"), F.lit("").alias("found"))))
        .when(F.col("kind") == "footnote", F.when(F.col("verse") == 0, F.struct(F.lit("FOOTNOTE_WITHOUT_VERSE").alias("code"), F.col("text").alias("found"))).when(note == "", F.struct(F.lit("FOOTNOTE_MISSING_TEXT").alias("code"), F.col("text").alias("found"))))
        .when((F.col("verse") == 0) & (strip(F.col("text")) != ""), F.struct(F.lit("VERSE_TEXT_WITHOUT_NUMBER").alias("code"), strip(F.col("text")).alias("found")))
    )
    issues = r.select("doc_id", code.alias("x")).where("x is not null").select("doc_id", "x.*")
    other = d.where((F.col("style") != "") & ~F.col("style").isin(STYLE_TITLE, STYLE_LABEL, STYLE_PARAGRAPH)).groupBy("doc_id", "style").agg(F.count("*").alias("n"))
    return lines, issues.unionByName(other.select("doc_id", F.lit("STYLE_UNKNOWN_PARAGRAPH").alias("code"), F.concat_ws(" ", "style", F.col("n").cast("string")).alias("found")))


def heading_freed(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, line): a chapter heading at the end of a verse's text, where the next line is verse 1,
    gets lines of its own."""
    head = rf"(?iU)^(\\v\s+\d+\s+.+?)\s+((?:[\p{{L}}\p{{M}}]+\s+){{0,4}}(?:{'|'.join(H.CHAPTER_WORDS)})\s*({_D}+))\s*$"
    nxt = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    n = T.script_number(F.regexp_extract("line", head, 3))
    hit = F.col("line").startswith("\\v ") & nxt.startswith("\\v 1 ") & n.isNotNull()
    d = lines.withColumn("__hit", F.coalesce(hit, F.lit(False))).withColumn("__n", n)
    parts = F.when(F.col("__hit"), F.array(F.rtrim(F.regexp_extract("line", head, 1)), F.concat(F.lit("\\c "), F.col("__n").cast("string")), F.concat(F.lit("\\cl "), H.chapter_line(F.regexp_extract("line", head, 2))))).otherwise(F.array("line"))
    return renumbered(d.select("doc_id", "line_no", F.posexplode(parts).alias("sub", "line")), ["line_no", "sub"])


def renumbered(lines: DataFrame, order: list[str]) -> DataFrame:
    return lines.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("long").alias("line_no"), "line")


def numbers_remapped(lines: DataFrame, canon: str = "protestant-ot", books: list[str] | None = None) -> DataFrame:
    """A translation's first verse of Numbers 13 that belongs to 12:16 goes there, and the rest of 13 moves down by one.

    Only in the first Numbers of a document with chapters 12 and 13, where 12 has no verse 16 and 13:1 begins as that verse does; never for an
    Orthodox canon, nor where other books were asked for.
    """
    if canon.lower().startswith("orthodox") or (books and "NUM" not in books):
        return lines
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("__b", F.count(F.when(F.col("line").startswith("\\mt "), 1)).over(w))
    named = F.when(F.col("line").startswith("\\mt ") & F.lower("line").contains(REMAP_BOOK.lower()), F.col("__b"))
    d = d.withColumn("__num", F.col("__b") == F.min(named).over(Window.partitionBy("doc_id")))
    d = d.withColumn("__c", F.last(F.when(F.col("line").startswith("\\c "), F.regexp_extract("line", r"^\\c (\d+)$", 1).try_cast("int")), True).over(Window.partitionBy("doc_id", "__b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__v", F.regexp_extract("line", r"^\\v\s+(\d+)\s", 1).try_cast("int"))
    at = Window.partitionBy("doc_id")
    here = lambda c: F.col("__num") & (F.col("__c") == c)
    first = F.min(F.when(here(13) & F.col("line").startswith("\\v 1 "), F.struct("line_no", "line"))).over(at)
    d = d.withColumn("__one", first).withColumn("__has", F.max((here(12) & F.col("line").startswith("\\v 16 ")).cast("int")).over(at)).withColumn("__12", F.max(here(12).cast("int")).over(at)).withColumn("__13", F.min(F.when(here(13), F.col("line_no"))).over(at))
    on = F.coalesce((F.col("__has") == 0) & (F.col("__12") == 1) & F.lower(F.substring("__one.line", 6, 10_000)).startswith(REMAP_START.lower()), F.lit(False))
    moved = F.concat(F.lit("\\v 16 "), F.expr("substring(__one.line, 6)"))
    out = (
        F.when(on & (F.col("line_no") == F.col("__13")), F.array(moved, F.col("line"))).when(on & (F.col("line_no") == F.col("__one.line_no")), F.array().cast("array<string>"))
        .when(on & here(13) & (F.col("__v") >= 2), F.array(F.concat(F.lit("\\v "), (F.col("__v") - 1).cast("string"), F.lit(" "), F.regexp_extract("line", r"^\\v\s+\d+\s+(.*)$", 1)))).otherwise(F.array("line"))
    )
    return renumbered(d.select("doc_id", "line_no", F.posexplode(out).alias("sub", "line")), ["line_no", "sub"])


def continuity(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, severity, code, chapter, verse) of converted lines, in one pass of windows: verses by chapter run,
    chapters by book run."""
    sev = F.lit("Error" if strict else "Warning")
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("b", F.count(F.when(F.col("line").startswith("\\mt "), 1)).over(upto("doc_id")))
    raw = F.when(F.col("line").startswith("\\c "), F.trim(F.substring("line", 4, 10_000)))
    d = d.withColumn("raw", raw).withColumn("n", F.when(F.col("raw").rlike("^[0-9]{1,9}$"), F.col("raw").cast("int"))).withColumn("starts", F.coalesce(F.col("n") > 0, F.lit(False)))
    d = d.withColumn("run", F.count(F.when(F.col("starts"), 1)).over(upto("doc_id", "b"))).withColumn("chapter", F.last(F.when(F.col("starts"), F.col("n")), True).over(upto("doc_id", "b")))
    row = lambda df, code, verse: df.select("doc_id", sev.alias("severity"), F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), "chapter", verse.alias("verse"))
    none = F.lit(None).cast("int")
    bad_c = row(d.where("raw is not null and not starts"), "CHAPTER_INVALID_NUMBER", none)
    gaps = d.where("starts").withColumn("before", F.lag("n").over(Window.partitionBy("doc_id", "b").orderBy("line_no")))
    gaps = row(gaps.where("n <> before + 1"), "CHAPTER_SEQUENCE_GAP", none)
    v = d.where(F.col("line").startswith("\\v ") & (F.col("run") > 0)).withColumn("v", F.regexp_extract("line", r"^\\v\s+(\d+)\b", 1).try_cast("int"))
    bad_v = row(v.where("v is null or v <= 0"), "VERSE_INVALID_NUMBER", none)
    good = v.where("v > 0")
    w = Window.partitionBy("doc_id", "b", "run").orderBy("line_no")
    good = good.withColumn("p", F.lag("v").over(w)).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "b", "run", "v").orderBy("line_no")))
    n, p = F.col("v"), F.col("p")
    codes = F.array_compact(F.array(F.when((n == 1) & (p > 0), "VERSE_RESTART_WITHOUT_CHAPTER"), F.when(n > p + 1, "VERSE_SEQUENCE_GAP"), F.when(F.col("nth") > 1, "VERSE_DUPLICATE"), F.when((n < p) & (n != 1), "VERSE_OUT_OF_ORDER")))
    found = good.select("doc_id", "chapter", F.col("v").alias("verse"), F.explode(codes).alias("code")).select("doc_id", sev.alias("severity"), "code", "chapter", "verse")
    empty = d.where("starts").select("doc_id", "b", "run", "chapter").join(good.select("doc_id", "b", "run").distinct(), ["doc_id", "b", "run"], "left_anti")
    return bad_c.unionByName(gaps).unionByName(bad_v).unionByName(found).unionByName(row(empty, "CHAPTER_WITHOUT_VERSES", none))


def strict(issues: DataFrame, mode: str) -> DataFrame:
    """Issues in a mode: in strict mode warnings are errors; nothing is stopped by that."""
    return issues.withColumn("severity", F.when((F.lit(mode) == "strict") & (F.col("severity") == "Warning"), "Error").otherwise(F.col("severity")))


def missing_styles(styles: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, code): documents of docs(doc_id) without a style that verses need, from styles(doc_id, kind, style_id)."""
    need = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("style_id")) for k, s in (("paragraph", STYLE_PARAGRAPH), ("character", STYLE_VERSE))])).alias("x")).select("doc_id", "x.*")
    lost = need.join(styles.select("doc_id", "kind", "style_id").distinct(), ["doc_id", "kind", "style_id"], "left_anti")
    return lost.select("doc_id", F.concat(F.lit("STYLE_MISSING_"), "style_id").alias("code"))
