"""Converted lines by book: segments, where a book ends, headers, psalms, selection and limits. All of it is windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versewright.functions import headings as H
from versewright.functions import text as T

# The label of the regular resource, header markers, and what begins another book.
REGULAR_ID, REGULAR_LABEL = "reg", "Regular"
HEADER_MARKERS = ("\\mt ", "\\id ", "\\h ", "\\toc")
PSALM_WORDS, PSALM_TITLE = ("Псалом",), "ПСАЛТЫРЬ"


def _upto(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def inline_start(line: Column, phrases: list[str]) -> Column:
    """Where the earliest of a profile's phrases stands in a verse line, from 0; null without one behind the start."""
    at = [F.nullif(F.locate(p.lower(), F.lower(line)) - 1, F.lit(-1)) for p in phrases]
    first = F.least(*[F.when(a > 0, a) for a in at]) if len(at) > 1 else (F.when(at[0] > 0, at[0]) if at else F.lit(None).cast("int"))
    return F.when(line.startswith("\\v "), first)


def _inline(line: Column, prefixes, phrases, known) -> tuple[Column, Column]:
    """(text before, title) of a verse line with the next book's heading in it; nulls for others."""
    at = inline_start(line, phrases)
    title = F.trim(F.substring(line, at + 2, F.char_length(line)))
    hit = at.isNotNull() & H.likely_book_heading(title, prefixes, known(title))
    return F.when(hit, F.rtrim(F.substring(line, F.lit(1), at))), F.when(hit, title)


def segments(lines: DataFrame, known, prefixes: list[str] = (), phrases: list[str] = ()) -> DataFrame:
    """(doc_id, segment, title, line_no, line): lines(doc_id, line_no, line) parted by book.

    A book begins at \\mt, at a line that is a heading, or at a heading inside a verse. A heading's own line is dropped,
    its text is the title; right behind another heading, or at the very start, it is a line like others. known(column)
    tells whether a book is named in a text; "book" is the title of what has none.
    """
    before, title = _inline(F.col("line"), prefixes, phrases, known)
    alone = ~F.col("line").startswith("\\") & (F.trim("line") != "") & H.likely_book_heading(F.col("line"), prefixes, known(F.col("line")))
    d = lines.select("doc_id", "line_no", "line", before.alias("cut"), F.coalesce(title, F.when(alone, F.trim("line"))).alias("head"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    d = d.withColumn("cand", F.col("head").isNotNull()).withColumn("no", F.row_number().over(w))
    d = d.withColumn("grp", F.col("no") - F.row_number().over(Window.partitionBy("doc_id", "cand").orderBy("line_no")))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "cand", "grp").orderBy("line_no")))
    at_start = F.col("no") == F.col("k")
    d = d.withColumn("ends", F.col("cand") & ((F.col("k") + at_start.cast("int")) % 2 == 1))
    mt = F.col("line").startswith("\\mt ")
    prev_ends = F.coalesce(F.lag("ends").over(w), F.lit(True))
    d = d.withColumn("starts", prev_ends | mt).withColumn("segment", F.count(F.when(F.col("starts"), 1)).over(_upto("doc_id")))
    named = F.when(mt, F.trim(F.substring("line", 5, 10_000))).when(F.lag("ends").over(w), F.lag("head").over(w))
    d = d.withColumn("named", named).withColumn("title", F.last("named", True).over(Window.partitionBy("doc_id", "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    text = F.when(F.col("ends"), F.col("cut")).otherwise(F.col("line"))
    return d.withColumn("line", text).where("line is not null and (not ends or trim(line) <> '')").select("doc_id", "segment", F.coalesce("title", F.lit("book")).alias("title"), "line_no", "line")


def trimmed(rows: DataFrame, limits: DataFrame, prefixes: list[str], phrases: list[str], known) -> DataFrame:
    """rows(doc_id, segment, book, line_no, line, …) up to where their book ends.

    With a known number of chapters, limits(book, chapters): behind the last chapter at another book's header or heading
    or at chapter 1, and before any chapter beyond. Without: at a heading, or where chapters begin again. A heading
    inside a verse ends the book there, and the verse's own text stays.
    """
    key = ("doc_id", "segment")
    d = rows.join(F.broadcast(limits.select("book", F.col("chapters").alias("__most"))), "book", "left")  # a row for each book of a canon
    raw = F.when(F.col("line").startswith("\\c "), F.trim(F.substring("line", 4, 10_000)))
    d = d.withColumn("__raw", raw).withColumn("__n", F.when(F.col("__raw").rlike("^[0-9]{1,9}$") & (F.col("__raw").try_cast("int") > 0), F.col("__raw").try_cast("int")))
    past = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("__n", True).over(past)
    d = d.withColumn("__first", first).withColumn("__prev", F.last("__n", True).over(past))
    reached = (F.col("__n") == F.col("__most")) | (F.col("__first").isNull() & (F.col("__n") >= F.col("__most")))
    d = d.withColumn("__reached", F.coalesce(reached, F.lit(False)))
    d = d.withColumn("__done", F.coalesce(F.max("__reached").over(past), F.lit(False)))
    before, _ = _inline(F.col("line"), prefixes, phrases, known)
    head = ~F.col("line").startswith("\\") & (F.trim("line") != "") & H.likely_book_heading(F.col("line"), prefixes, known(F.col("line")))
    started, n, prev = F.col("__first").isNotNull(), F.col("__n"), F.col("__prev")
    other = F.lit(False)
    for m in HEADER_MARKERS:
        other = other | F.col("line").startswith(m)
    limited = (F.col("__done") & (other | head | before.isNotNull() | (n == 1))) | (started & (n > F.col("__most"))) | (started & F.col("__raw").isNotNull() & n.isNull())
    free = started & (head | before.isNotNull() | ((n == 1) & (prev > 1)) | ((n < prev) & (n <= 3) & (prev > 3)))
    stop = F.coalesce(F.when(F.col("__most").isNotNull(), limited).otherwise(free), F.lit(False))
    d = d.withColumn("__stop", stop).withColumn("__cut", before).withColumn("__over", F.sum(F.col("__stop").cast("int")).over(_upto(*key)))
    keep = (F.col("__over") == 0) | ((F.col("__over") == 1) & F.col("__stop") & (F.trim(F.coalesce("__cut", F.lit(""))) != ""))
    return d.where(keep).withColumn("line", F.when(F.col("__stop"), F.col("__cut")).otherwise(F.col("line"))).select(*rows.columns)


def resource_label(resource: Column) -> Column:
    return F.when((F.lower(F.trim(F.coalesce(resource, F.lit("")))).isin(REGULAR_ID, "")), REGULAR_LABEL).otherwise(F.trim(resource))


def header_lines(book: Column, title: Column, resource: Column) -> Column:
    """The six header lines of a book without an \\id line."""
    b = F.lower(book)
    return F.array(F.concat(F.lit("\\id "), b, F.lit(" "), resource_label(resource)), F.lit("\\ide usfm"), *[F.concat(F.lit(f"\\{m} "), title) for m in ("h", "toc1", "toc2")], F.concat(F.lit("\\toc3 "), b))


def display_title(rows: DataFrame) -> DataFrame:
    """(doc_id, segment, display): the first \\mt with text, else the segment's title, else its book."""
    mt = F.when(F.col("line").startswith("\\mt ") & (F.trim(F.substring("line", 5, 10_000)) != ""), F.col("line_no"))
    g = rows.groupBy("doc_id", "segment").agg(F.min_by(F.trim(F.substring("line", 5, 10_000)), mt).alias("m"), F.first("title").alias("t"), F.first("book").alias("b"))
    g = g.select("doc_id", "segment", "b", F.coalesce("m", F.nullif(F.trim("t"), F.lit("")), "b").alias("display"))
    psalms = F.regexp_replace("display", r"\s*\(.*\)\s*$", "")
    return g.select("doc_id", "segment", F.when(F.col("b") == "PSA", F.coalesce(F.nullif(F.trim(psalms), F.lit("")), F.lit(PSALM_TITLE))).otherwise(F.col("display")).alias("display"))


def with_headers(rows: DataFrame, resource: str = REGULAR_ID) -> DataFrame:
    """rows(doc_id, segment, title, book, line_no, line) with header lines where a segment has no \\id line and a book;
    an \\id line that is there gets the book in small letters and the resource's label. Lines are numbered anew."""
    is_id = F.col("line").startswith("\\id ")
    first_id = F.min(F.when(is_id, F.col("line_no"))).over(Window.partitionBy("doc_id", "segment"))
    d = rows.withColumn("__id", first_id)
    code = F.lower(F.regexp_extract("line", r"^\\id\s+(\S+)", 1))
    body = d.withColumn("line", F.when((F.col("line_no") == F.col("__id")) & (code != ""), F.concat(F.lit("\\id "), code, F.lit(" "), resource_label(F.lit(resource)))).otherwise(F.col("line")))
    heads = d.where("__id is null and book is not null").select("doc_id", "segment", "title", "book").distinct().join(display_title(rows), ["doc_id", "segment"])
    heads = heads.select("doc_id", "segment", "title", "book", F.posexplode(header_lines(F.col("book"), F.col("display"), F.lit(resource))).alias("at", "line")).withColumn("line_no", F.lit(-1).cast("long"))
    both = body.select("doc_id", "segment", "title", "book", "line_no", F.lit(0).alias("at"), "line").unionByName(heads)
    no = F.row_number().over(Window.partitionBy("doc_id", "segment").orderBy("line_no", "at"))
    return both.select("doc_id", "segment", "title", "book", no.cast("long").alias("line_no"), "line")


def selected(rows: DataFrame, books: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of segments whose book was asked for, mismatches): a document is a mismatch if books are known in it but
    none of those asked for; it has no rows then. A document in which no book is known keeps its rows under the one book
    that was asked for, if it was one."""
    want = [b.strip().upper() for b in books]
    seen = rows.groupBy("doc_id").agg(F.count_if(F.col("book").isNotNull()).alias("known"), F.count_if(F.col("book").isin(*want)).alias("hits"), F.array_sort(F.collect_set("book")).alias("books"))
    d = rows.join(seen, "doc_id")
    hit = d.where(F.col("book").isin(*want))
    forced = d.where("known = 0").withColumn("book", F.lit(want[0])) if len(want) == 1 else d.limit(0)
    wrong = seen.where("known > 0 and hits = 0").select("doc_id", F.lit("BOOK_SELECTION_MISMATCH").alias("code"), F.array_join("books", ", ").alias("found"))
    return hit.unionByName(forced).select(*rows.columns), wrong


def over_limits(lines: DataFrame, versification: DataFrame, book: str) -> DataFrame:
    """(doc_id, code, chapter, verse): the first chapter or verse of a document that a book doesn't have; of a range of
    verses the last counts. Documents with a row produce no output. A book without counts is never checked."""
    most = versification.where(F.col("book") == book).select("chapter", "max_verse")
    chapters = most.agg(F.max("chapter").alias("chapters"))
    number = F.regexp_extract("line", r"(?i)^\s*\\c\s+(\d+)\b", 1).try_cast("int")
    d = lines.withColumn("c", number).withColumn("chapter", F.last("c", True).over(_upto("doc_id")))
    d = d.crossJoin(F.broadcast(chapters)).where("chapters is not null")  # one row
    bad_c = d.where("c is not null and (c < 1 or c > chapters)").select("doc_id", "line_no", F.lit("CHAPTER_BEYOND_BOOK").alias("code"), F.col("c").alias("chapter"), F.lit(None).cast("int").alias("verse"))
    hits = F.regexp_extract_all("line", F.lit(r"(?i)\\v\s+(\d+(?:\s*[-–]\s*\d+)?)\b"), F.lit(1))
    v = d.where("chapter between 1 and chapters").select("doc_id", "line_no", "chapter", F.explode(hits).alias("r")).withColumn("verse", F.regexp_extract("r", r"(\d+)\s*$", 1).try_cast("int"))
    bad_v = v.join(F.broadcast(most), "chapter").where("verse > max_verse").select("doc_id", "line_no", F.lit("VERSE_BEYOND_CHAPTER").alias("code"), "chapter", "verse")  # the chapters of one book
    both = bad_c.unionByName(bad_v)
    return both.groupBy("doc_id").agg(F.min(F.struct("line_no", "code", "chapter", "verse")).alias("x")).select("doc_id", "x.code", "x.chapter", "x.verse")


def psalm_markers(lines: DataFrame, words: list[str] = PSALM_WORDS, title: str = PSALM_TITLE, key=("doc_id",)) -> DataFrame:
    """Lines of a psalter: a label with a psalm's number becomes a chapter with a label, later labels before the first
    verse become descriptions, and the first main title is the psalter's."""
    number = F.lit(None).cast("int")
    for w in words:
        number = F.coalesce(number, F.when(F.col("line").startswith("\\cl "), F.regexp_extract("line", rf"(?i)^\\cl\s+\Q{w}\E\s+(\d+)\b", 1).try_cast("int")))
    d = lines.withColumn("__n", F.when(number > 0, number)).withColumn("__start", F.col("__n").isNotNull() | F.col("line").startswith("\\c "))
    d = d.withColumn("__run", F.count(F.when(F.col("__start"), 1)).over(_upto(*key)))
    d = d.withColumn("__seen", F.max(F.col("line").startswith("\\v ").cast("int")).over(_upto(*key, "__run"))).withColumn("__mt", F.count(F.when(F.col("line").startswith("\\mt "), 1)).over(_upto(*key)))
    intro = F.col("line").startswith("\\cl ") & (F.col("__run") > 0) & (F.col("__seen") == 0) & (F.trim(F.substring("line", 5, 10_000)) != "")
    out = (
        F.when(F.col("__n").isNotNull(), F.array(F.concat(F.lit("\\c "), F.col("__n").cast("string")), F.concat(F.lit(f"\\cl {words[0]} "), F.col("__n").cast("string"))))
        .when(intro, F.array(F.concat(F.lit("\\d "), F.trim(F.substring("line", 5, 10_000))))).when(F.col("line").startswith("\\mt ") & (F.col("__mt") == 1), F.array(F.lit(f"\\mt {title}"))).otherwise(F.array("line"))
    )
    d = d.select(*key, "line_no", F.posexplode(out).alias("__sub", "line"))
    return d.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("line_no", "__sub")).cast("long").alias("line_no"), "line")


def psalm_bodies(lines: DataFrame, phrases: list[str], key=("doc_id",)) -> DataFrame:
    """Lines of a psalter with each chapter's body in one order: \\p, descriptions, verses, what else is marked.

    A chapter without descriptions whose verse 1 of several is a superscription has it as its description, and its other
    verses move down by one. What stands before the first chapter, and labels right behind a chapter, stay.
    """
    d = lines.withColumn("__c", F.count(F.when(F.col("line").startswith("\\c "), 1)).over(_upto(*key)))
    head = F.col("line").startswith("\\c ") | F.col("line").startswith("\\cl ")
    d = d.withColumn("__head", head & (F.max((~head).cast("int")).over(_upto(*key, "__c")) == 0))
    plain = ~F.col("line").startswith("\\")
    kind = F.when((F.col("__c") == 0) | F.col("__head"), 0).when((F.col("line") == "\\p") | (plain & (F.trim("line") == "")), -1).when(F.col("line").rlike(r"^\\d\s*$"), -1).when(F.col("line").startswith("\\d ") | plain, 2).when(F.col("line").startswith("\\v "), 3).otherwise(4)
    d = d.withColumn("__k", kind).where("__k >= 0 or (line = '\\\\p' and __c > 0)")
    n, t = F.regexp_extract("line", r"^\\v\s+(\d+)\s+(.*)$", 1).try_cast("int"), F.trim(F.regexp_extract("line", r"^\\v\s+(\d+)\s+(.*)$", 2))
    d = d.withColumn("__n", n).withColumn("__t", t)
    at = Window.partitionBy(*key, "__c")
    first = F.min(F.when(F.col("__k") == 3, F.struct("line_no", "__n", "__t"))).over(at)
    moves = (F.max((F.col("__k") == 2).cast("int")).over(at) == 0) & (F.sum((F.col("__k") == 3).cast("int")).over(at) > 1) & (first["__n"] == 1) & H.superscription(first["__t"], phrases)
    d = d.withColumn("__first", first["line_no"]).withColumn("__moves", F.coalesce(moves, F.lit(False)) & (F.col("__c") > 0))
    goes = F.col("__moves") & (F.col("line_no") == F.col("__first"))
    line = (
        F.when(goes, F.concat(F.lit("\\d "), "__t")).when(F.col("__k") == 2, F.when(F.col("line").startswith("\\d "), F.concat(F.lit("\\d "), F.trim(F.substring("line", 4, 10_000)))).otherwise(F.concat(F.lit("\\d "), F.trim("line"))))
        .when(F.col("__moves") & (F.col("__k") == 3) & (F.col("__n") > 1), F.concat(F.lit("\\v "), (F.col("__n") - 1).cast("string"), F.lit(" "), "__t")).otherwise(F.col("line"))
    )
    body = d.where("__k >= 0").select(*key, "__c", F.when(goes, 2).otherwise(F.col("__k")).alias("__rank"), "line_no", line.alias("line"))
    opens = d.where("__c > 0").select(*key, "__c").distinct().select(*key, "__c", F.lit(1).alias("__rank"), F.lit(0).cast("long").alias("line_no"), F.lit("\\p").alias("line"))
    both = body.unionByName(opens)
    no = F.row_number().over(Window.partitionBy(*key).orderBy("__c", "__rank", "line_no"))
    return both.select(*key, no.cast("long").alias("line_no"), "line")


def verse_export(rows: DataFrame) -> DataFrame:
    """(doc_id, segment, book, chapter, verse, text): the verses of segments, for files with a verse on each line."""
    number = F.when(F.col("line").startswith("\\c "), F.regexp_extract("line", r"^\\c\s+(\d+)", 1).try_cast("int"))
    d = rows.withColumn("chapter", F.last(number, True).over(_upto("doc_id", "segment")))
    v = F.regexp_extract("line", r"^\\v\s+(\d+)\s+(.*)$", 1).try_cast("int")
    return d.withColumn("verse", v).where("verse is not null and chapter is not null").select("doc_id", "segment", "book", "chapter", "verse", F.trim(F.regexp_extract("line", r"^\\v\s+(\d+)\s+(.*)$", 2)).alias("text"))


def output_folder(target: str, exists: bool) -> str:
    """The folder for split books: a target that is a folder or has no extension itself, else one named after the file."""
    stem, dot, ext = target.rstrip("/").rpartition(".")
    return target.rstrip("/") if exists or target.endswith("/") or not dot or "/" in ext else f"{stem}_books"


def file_stem(raw: Column, most: int = 64) -> Column:
    """A name fit for a file: no reserved characters, blanks as hyphens, none doubled or at the ends; "book" if nothing is left."""
    c = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r'[\x00-\x1F"<>|:*?\\/]', ""), r"(?U)\s", "-")
    c = F.regexp_replace(F.regexp_replace(c, "-{2,}", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(c == "", "book").otherwise(F.substring(c, 1, most))
