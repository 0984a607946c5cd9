"""A scan of paragraphs: books, chapters and verses as they are found, and how they stand to a canon."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versewright.functions import headings as H
from versewright.functions import patterns as P
from versewright.functions import quotes as Q
from versewright.functions import text as T

from . import documents, lookups, sequences
from .shared import stored

# Books of the canons in their order, the names of profiles, and what a scan says of them.
OT = ("GEN", "EXO", "LEV", "NUM", "DEU", "JOS", "JDG", "RUT", "1SA", "2SA", "1KI", "2KI", "1CH", "2CH", "EZR", "NEH", "EST", "JOB", "PSA", "PRO", "ECC", "SNG", "ISA", "JER", "LAM", "EZK", "DAN", "HOS", "JOL", "AMO", "OBA", "JON", "MIC", "NAM", "HAB", "ZEP", "HAG", "ZEC", "MAL")
NT = ("MAT", "MRK", "LUK", "JHN", "ACT", "ROM", "1CO", "2CO", "GAL", "EPH", "PHP", "COL", "1TH", "2TH", "1TI", "2TI", "TIT", "PHM", "HEB", "JAS", "1PE", "2PE", "1JN", "2JN", "3JN", "JUD", "REV")
CANONS = {"protestant-ot": ("Protestant OT", OT), "catholic-ot": ("Catholic OT", OT), "orthodox-ot": ("Orthodox OT", OT), "protestant-nt": ("Protestant NT", NT), "catholic-nt": ("Catholic NT", NT), "orthodox-nt": ("Orthodox NT", NT)}
VERSIFICATIONS = {
    "protestant-ot": ("bttw-en-US-v1", "BTTW English Protestant OT versification (v1)"),
    "catholic-ot": ("catholic-ot-v1", "Catholic OT versification (v1)"),
    "orthodox-ot": ("orthodox-ot-lxx-v1", "Orthodox OT versification (LXX-aware v2)"),
    "protestant-nt": ("protestant-nt-v1", "Protestant NT versification (v1)"),
    "catholic-nt": ("catholic-nt-v1", "Catholic NT versification (v1)"),
    "orthodox-nt": ("orthodox-nt-v1", "Orthodox NT versification (v1)"),
}
MARKER_CODES = ("CHAPTER_COUNT_MISMATCH", "CANON_CHAPTER_MISSING", "CANON_VERSE_MISSING", "CANON_VERSE_EXTRA", "CANON_CHAPTER_EXTRA", "VERSE_OUT_OF_ORDER", "VERSE_DUPLICATE")


def canon_books(canon: str) -> list[str]:
    """The books of a canon in their order; an unknown canon is the first one."""
    return list(CANONS.get(canon, CANONS["protestant-ot"])[1])


def events(paragraphs: DataFrame, aliases: DataFrame, canon: str = "protestant-ot") -> DataFrame:
    """(doc_id, line_no, kind, book, book_seq, title, chapter, chapter_seq, verse, pos): what each line of
    paragraphs(doc_id, line_no, text) is: title, boundary, chapter, verse or nothing.

    aliases(book, alias, priority) tells books. A title of the book that is open already opens nothing; a heading without a
    book of the canon closes the one before. A verse line's further markers are verses of their own.
    """
    d = paragraphs.select("doc_id", "line_no", T.scan_text(F.col("text")).alias("text")).where("text <> ''")
    d = lookups.by_alias(d, F.col("text"), aliases, T.alias_key)
    known = F.col("book").isNotNull()
    exact = lookups.small(aliases.select(T.alias_key(F.col("alias")).alias("k"), F.col("book").alias("exact")).groupBy("k").agg(F.countDistinct("exact").alias("n"), F.min("exact").alias("exact")).where("n = 1").drop("n"))
    d = d.withColumn("k", T.alias_key(F.col("text"))).join(exact, "k", "left")
    listed = F.col("book").isin(*canon_books(canon))
    skip = H.ignorable(F.col("text"), known)
    title = F.coalesce(F.when(F.col("exact").isNotNull(), listed).otherwise(H.scanned_title(F.col("text"), known) & known & listed), F.lit(False))
    loose = F.regexp_extract("text", r"^\s*(\d{1,3})", 1).try_cast("int")
    lead = T.script_number(F.regexp_extract("text", H.VERSE_LEAD, 1), 0)
    verse = F.coalesce(lead, F.when(loose.between(1, 200), loose))
    kind = F.when(skip, None).when(title, "title").when(H.heading_boundary(F.col("text"), known), "boundary").when(H.is_chapter(F.col("text")), "chapter").when(verse > 0, "verse")
    d = d.withColumn("kind", kind).withColumn("n", F.when(F.col("kind") == "chapter", H.chapter_number(F.col("text"))).when(F.col("kind") == "verse", verse))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.col("kind").isin("title", "boundary")
    d = d.withColumn("open", F.last(F.when(heads, F.struct(F.when(F.col("kind") == "title", F.col("book")).alias("book"), F.col("text").alias("title"))), True).over(w))
    prev = F.last(F.when(heads, F.struct(F.when(F.col("kind") == "title", F.col("book")).alias("book"))), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("kind") == "title") & ~F.coalesce(prev["book"] == F.col("book"), F.lit(False))
    d = d.withColumn("fresh", fresh).withColumn("book_seq", F.count(F.when(F.col("fresh"), 1)).over(w))
    d = d.withColumn("name", F.last(F.when(F.col("fresh"), F.col("text")), True).over(w))
    ch = Window.partitionBy("doc_id", "book_seq").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    good = (F.col("kind") == "chapter") & F.col("n").isNotNull() & F.col("open.book").isNotNull()
    d = d.withColumn("chapter", F.last(F.when(good, F.col("n")), True).over(ch)).withColumn("chapter_seq", F.count(F.when(good, 1)).over(ch))
    further = F.when(F.col("kind") == "verse", F.concat(F.array("n"), embedded(F.col("text"), F.col("n")))).otherwise(F.array(F.col("n")))
    d = d.select("doc_id", "line_no", "kind", F.col("open.book").alias("book"), "book_seq", F.col("name").alias("title"), "fresh", "chapter", "chapter_seq", "text", F.posexplode(further).alias("pos", "number"))
    return d


def embedded(text: Column, first: Column) -> Column:
    """Verse numbers inside a line above its first, sorted and distinct: one to three digits behind a blank, a verse boundary
    or nothing, and before a blank and a letter or an opening quote; a stop or bracket may stand behind the number."""
    edge, opens = re.escape("".join(c for c in P.VERSE_BOUNDARY if c not in "۔؟")), re.escape("\"'«“[")
    found = F.regexp_extract_all(text, F.lit(rf"(?U)(?<![^\s{edge}])(\d{{1,3}})[.)]?\s+(?=[\p{{L}}\p{{M}}{opens}])"), F.lit(1))
    n = F.transform(found, lambda x: T.ascii_digits(x).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(n, lambda x: (x > first) & (x <= P.MOST_VERSES))))


def structure_issues(found: DataFrame) -> DataFrame:
    """(doc_id, severity, code, book, chapter, verse) of events(): what stands before a book or a chapter, jumps of chapters,
    and the integrity of verses by chapter number (a chapter that is opened again keeps its verses). events() are worked out once."""
    found = stored(found.select("doc_id", "line_no", "kind", "book", "book_seq", "chapter", "pos", "number"), "events")
    none = F.lit(None).cast("int")
    row = lambda d, sev, code, c=none, v=none: d.select("doc_id", F.lit(sev).alias("severity"), F.lit(code).alias("code"), "book", c.alias("chapter"), v.alias("verse"))
    out = row(found.where("kind = 'boundary'"), "Info", "UNMAPPED_BOOK_HEADING")
    out = out.unionByName(row(found.where("kind = 'chapter' and book is null"), "Warning", "CHAPTER_BEFORE_BOOK"))
    out = out.unionByName(row(found.where("kind = 'chapter' and book is not null and number is null"), "Warning", "CHAPTER_INVALID"))
    out = out.unionByName(row(found.where("kind = 'verse' and book is null and pos = 0"), "Warning", "VERSE_BEFORE_BOOK"))
    merged = found.where("kind = 'verse' and book is not null and pos > 0").select("doc_id", "line_no", "book").distinct()
    out = out.unionByName(row(merged, "Info", "VERSE_MERGED_MARKERS_DETECTED"))
    c = found.where("kind = 'chapter' and book is not null and number is not null")
    gap = c.withColumn("prev", F.lag("number").over(Window.partitionBy("doc_id", "book_seq").orderBy("line_no"))).where("number <> prev + 1")
    out = out.unionByName(row(gap, "Warning", "CHAPTER_SEQUENCE_GAP", F.col("number")))
    v = found.where("kind = 'verse' and book is not null")
    out = out.unionByName(row(v.where("chapter is null"), "Warning", "VERSE_WITHOUT_CHAPTER", none, F.col("number")))
    key = ["doc_id", "book_seq", "book", "chapter"]
    bad = sequences.issues(v.where("chapter is not null"), key, "number", ["line_no", "pos"])
    out = out.unionByName(bad.select("doc_id", F.lit("Warning").alias("severity"), "code", "book", "chapter", F.col("number").cast("int").alias("verse")))
    empty = c.select("doc_id", "book_seq", "book", F.col("number").alias("chapter")).distinct().join(v.select(*key).distinct(), key, "left_anti")
    return out.unionByName(row(empty, "Warning", "CHAPTER_WITHOUT_VERSES", F.col("chapter")))


def totals(found: DataFrame) -> DataFrame:
    """(doc_id, books, chapters, verses): distinct ones, in books that are known."""
    key = F.struct("book_seq", "chapter")
    c, v = F.when(F.col("kind") == "chapter", F.struct("book_seq", "number")), F.when((F.col("kind") == "verse") & F.col("chapter").isNotNull(), F.struct(key, "number"))
    return found.where("book is not null").groupBy("doc_id").agg(F.countDistinct("book").alias("books"), F.countDistinct(c).alias("chapters"), F.countDistinct(v).alias("verses"))


def detected_books(found: DataFrame) -> DataFrame:
    """(doc_id, testament, books): ids in the order of their first appearance, joined by commas; none if there are none."""
    seen = found.where("fresh").groupBy("doc_id", "book").agg(F.min("line_no").alias("at"))
    part = F.when(F.col("book").isin(*OT), "OT").when(F.col("book").isin(*NT), "NT")
    both = seen.withColumn("testament", part).where("testament is not null").groupBy("doc_id", "testament").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "book"))), lambda x: x["book"]), ", ").alias("books"))
    every = found.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("OT"), F.lit("NT"))).alias("testament"))
    return every.join(both, ["doc_id", "testament"], "left").select("doc_id", "testament", F.coalesce("books", F.lit("(none)")).alias("books"))


def order_mismatch(found: DataFrame) -> DataFrame:
    """(doc_id, book): the first book of the Old Testament that stands behind one which follows it in the canon."""
    pos = F.create_map(*[x for i, b in enumerate(OT) for x in (F.lit(b), F.lit(i))])
    d = found.where("fresh").withColumn("p", F.try_element_at(pos, F.col("book"))).where("p is not null")
    first = sequences.first_inversion(d, ["doc_id"], "p", "line_no")
    return first.withColumnRenamed("line", "line_no").join(d.select("doc_id", "line_no", "book"), ["doc_id", "line_no"]).select("doc_id", "book")


def chapter_counts(found: DataFrame, versification: DataFrame) -> DataFrame:
    """(doc_id, book, chapters, expected): books with another number of chapters than the versification has."""
    want = versification.groupBy("book").agg(F.max("chapter").alias("expected"))
    have = found.where("book is not null").groupBy("doc_id", "book_seq", "book").agg(F.countDistinct(F.when(F.col("kind") == "chapter", F.col("number"))).alias("chapters"))
    return have.join(lookups.small(want), "book").where("chapters <> expected").select("doc_id", "book", "chapters", "expected")


def canon_issues(found: DataFrame, versification: DataFrame, relaxed: list[str] = ()) -> DataFrame:
    """documents.canon_issues for each document and book of a scan; books whose counts are relaxed are told, not checked."""
    v = found.where("kind = 'verse' and book is not null and chapter is not null").select("doc_id", "book", "chapter", F.col("number").alias("verse"))
    soft = v.where(F.col("book").isin(*relaxed)).select("doc_id", "book").distinct() if relaxed else None
    out = documents.canon_issues(v.where(~F.col("book").isin(*relaxed)) if relaxed else v, versification, ["doc_id"])
    none = F.lit(None).cast("int")
    return out if soft is None else out.unionByName(soft.select("doc_id", "book", F.lit("VERSIFICATION_RELAXED_BOOK").alias("code"), none.alias("chapter"), none.alias("verse")))


def canon_notes(canon: str) -> list[tuple[str, str, str]]:
    """(severity, code, message) that every scan of a canon has."""
    name, (_, profile) = CANONS.get(canon, CANONS["protestant-ot"])[0], VERSIFICATIONS.get(canon, VERSIFICATIONS["protestant-ot"])
    scope = {"catholic-ot": "canonical checks currently cover shared OT books in this workflow", "orthodox-ot": "canonical checks currently cover shared OT books in this workflow", "catholic-nt": "chapter checks cover common NT books in this workflow", "orthodox-nt": "chapter checks cover common NT books in this workflow"}
    out = [("Info", "CANON_PROFILE_SCOPE", f"{name} selected: {scope[canon]}.")] if canon in scope else []
    return [*out, ("Info", "CANON_SELECTED", f"Selected canon profile: {name}."), ("Info", "VERSIFICATION_PROFILE_SELECTED", f"Versification profile: {profile}.")]


def marker_highlights(issues: DataFrame) -> DataFrame:
    """The issues that a report of highlighted markers has."""
    return issues.where(F.col("code").isin(*MARKER_CODES))


def selected_books(found: DataFrame, ids: list[str], titles: list[str] = ()) -> DataFrame:
    """Rows of the books that were asked for, by id or by the title they bear."""
    return found.where(F.coalesce(F.col("book").isin(*ids), F.lit(False)) | F.coalesce(F.trim("title").isin(*titles), F.lit(False)))


def relabelled(paragraphs: DataFrame) -> DataFrame:
    """Paragraph texts with a chapter's label in one form (word, blank, number) and a leading verse marker as \\v N."""
    words = "|".join(H.CHAPTER_WORDS)
    c = F.regexp_replace("text", rf"(?iU)^\s*({words})\s*([0-9٠-٩۰-۹]+)\s*$", "$1 $2")
    return paragraphs.withColumn("text", F.regexp_replace(c, r"(?iU)^\s*\\v\s*([0-9٠-٩۰-۹]{1,3})\s*[.)۔:]?\s*(?=\S)", r"\\v $1 "))


def marker_alone(text: Column) -> Column:
    """Whether a paragraph is nothing but a verse marker or number."""
    return text.rlike(r"(?iU)^\s*(?:\\v\s*)?[0-9٠-٩۰-۹]{1,3}\s*[.)۔:]?\s*$")


def suffix_of(a: Column, b: Column) -> Column:
    """Whether two numbers are one whose digits were cut off in front."""
    return Q.decimal_suffix(a, b)
