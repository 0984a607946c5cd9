"""Marked-up lines: parsing, context, verses, preflight, compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versewright.functions import patterns as P
from versewright.functions import text as T

from .ordered import all_carried, numbered, scanned


def marked(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, line) with ``marker`` (null without one) and ``body``."""
    m = F.regexp_extract("line", r"^\s*\\([A-Za-z]+[0-9]*)\*?", 1)
    return lines.withColumn("marker", F.when(m != "", F.lower(m))).withColumn("body", F.trim(F.regexp_replace("line", r"^\s*\\[A-Za-z]+[0-9]*\*?\s*", "")))


def context(lines: DataFrame) -> DataFrame:
    """lines with book, chapter and the sequence of chapters; a new book ends the chapter before it."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = marked(lines)
    d = d.withColumn("book_seq", F.sum((F.col("marker") == "id").cast("int")).over(w)).withColumn("book", F.last(F.when(F.col("marker") == "id", F.upper(F.regexp_extract("body", r"^(\S+)", 1))), True).over(w))
    w = Window.partitionBy("doc_id", "book_seq").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    number = T.ascii_digits(F.regexp_extract("body", rf"^({P.DIGITS}+)", 1)).try_cast("int")
    d = d.withColumn("chapter", F.last(F.when(F.col("marker") == "c", number), True).over(w))
    return d.withColumn("chapter_seq", F.sum((F.col("marker") == "c").cast("int")).over(w))


def verses(lines: DataFrame, continued: bool = True) -> DataFrame:
    """(doc_id, book, chapter, verse, text, line_no, pos): verse starts, several of a line too.

    With ``continued``, the marker-less text of later lines joins the verse it follows; without, such lines
    are dropped, as a packager does. Text before the first marker of a chapter belongs to no verse.
    """
    d = context(lines)
    at = F.regexp_extract_all("line", F.lit(rf"(?i)\\v\s*({P.DIGITS}+)"), F.lit(1))
    parts = F.split("line", rf"(?i)\\v\s*{P.DIGITS}+\s*")
    starts = d.where(F.lower("line").contains(r"\v")).select("doc_id", "book", "book_seq", "chapter", "chapter_seq", "line_no", F.posexplode(F.zip_with(at, F.slice(parts, 2, 100_000), lambda n, t: F.struct(n.alias("n"), t.alias("t")))).alias("pos", "x"))
    starts = starts.select("doc_id", "book", "book_seq", "chapter", "chapter_seq", "line_no", "pos", T.ascii_digits(F.col("x.n")).try_cast("int").alias("verse"), F.trim("x.t").alias("text")).where("verse is not null")
    if not continued:
        return starts.select("doc_id", "book", "chapter", "verse", "text", "line_no", "pos")
    plain = ~F.coalesce(F.col("marker").isin("id", "ide", "h", "toc1", "toc2", "toc3", "mt", "mt1", "mt2", "c", "cl", "s", "s1", "s2", "r", "d"), F.lit(False))
    rest = d.where(plain & ~F.lower("line").contains(r"\v")).select("doc_id", "book", "book_seq", "chapter", "chapter_seq", "line_no", F.lit(0).alias("pos"), F.lit(None).cast("int").alias("verse"), F.col("body").alias("text"))
    both = starts.unionByName(rest)
    w = Window.partitionBy("doc_id", "book_seq", "chapter_seq").orderBy("line_no", "pos").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("v", F.last(F.when(F.col("verse").isNotNull(), F.struct("verse", "line_no", "pos")), True).over(w)).where("v is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("line_no", "pos", "text")))), lambda x: x["text"]), " ")
    out = both.groupBy("doc_id", "book", "chapter", "v").agg(text.alias("text"))
    return out.select("doc_id", "book", "chapter", "v.verse", "text", "v.line_no", "v.pos")


def identity(lines: DataFrame) -> DataFrame:
    """(doc_id, book, title): \\id, and the first of \\h, \\toc1, \\mt before the first chapter; title null if none."""
    d = marked(lines)
    first_c = d.groupBy("doc_id").agg(F.min(F.when(F.col("marker") == "c", F.col("line_no"))).alias("c"))
    d = d.join(first_c, "doc_id").where("c is null or line_no < c")
    first = lambda *names: F.min_by("body", F.when(F.col("marker").isin(*names) & (F.col("body") != ""), F.col("line_no")))
    return d.groupBy("doc_id").agg(F.upper(F.regexp_extract(first("id"), r"^(\S+)", 1)).alias("book"), F.coalesce(first("h"), first("toc1"), first("mt", "mt1")).alias("title"))


def rejected(lines: DataFrame) -> DataFrame:
    """Documents with a numbered verse marker inside a description line: they produce no output."""
    return marked(lines).where((F.col("marker") == "d") & F.col("body").rlike(rf"(?i)\\v\s*{P.DIGITS}")).select("doc_id").distinct()


def gate(docs: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, blocked): only the documents that are blocked lose their output."""
    ids = blocked.select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_anti"), docs.join(ids, "doc_id", "left_semi")


def markers(lines: DataFrame, supported: DataFrame) -> DataFrame:
    """(doc_id, severity, code, marker): private \\z markers warn, others outside supported(marker) are errors."""
    d = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"\\([A-Za-z]+[0-9]*)\*?"), F.lit(1))).alias("m")).select("doc_id", F.lower("m").alias("marker")).distinct()
    d = d.join(supported.select(F.lower("marker").alias("marker")).distinct(), "marker", "left_anti")
    private = F.col("marker").startswith("z")
    return d.select("doc_id", F.when(private, "Warning").otherwise("Error").alias("severity"), F.when(private, "MARKER_PRIVATE_NAMESPACE").otherwise("MARKER_UNSUPPORTED").alias("code"), "marker")


def preflight(files: DataFrame) -> DataFrame:
    """(path, code, found) of files(path, text)."""
    t = F.col("text")
    row = lambda when, code, found: F.when(when, F.array(F.struct(F.lit(code).alias("code"), found.alias("found")))).otherwise(F.array().cast("array<struct<code:string,found:string>>"))
    jammed = F.regexp_extract(t, r"(?U)(\\v\s+[-0-9]+[^-\s0-9])", 1)
    foreign = F.transform(F.regexp_extract_all(t, F.lit(r"(?U)(\\[^a-z+\s])"), F.lit(1)), lambda m: F.struct(F.lit("USFM_FOREIGN_MARKER_CHAR").alias("code"), m.alias("found")))
    found = F.concat(
        row(F.octet_length(t) < P.SMALL_FILE, "USFM_SMALL_FILE", F.octet_length(t).cast("string")),
        row(t.rlike(r"(?U)\\\s"), "USFM_STRANDED_BACKSLASH", F.lit("")), row(jammed != "", "USFM_JAMMED_VERSE_NUMBER", F.trim(jammed)), foreign,
    )
    return files.select("path", F.explode(found).alias("x")).select("path", "x.*")


def capped(lines: DataFrame, most: int) -> DataFrame:
    """Lines before the first chapter above a limit."""
    from .sequences import until

    n = F.regexp_extract("line", r"^\s*\\c\s+(\d+)", 1).try_cast("int")
    return until(lines, F.coalesce(n > most, F.lit(False)), ["doc_id"], ["line_no"])


_INTRO = r"^(.+?\b\d+)\.\s+(.+)$"


def intros_split(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, sub_no, line): a chapter's label with its first words behind it becomes a label and a description."""
    rest = F.trim(F.substring("line", F.lit(5), F.char_length("line")))
    whole = F.col("line").startswith("\\cl ") & rest.rlike(f"(?U){_INTRO}")
    part = lambda i: F.trim(F.regexp_extract(rest, f"(?U){_INTRO}", i))
    both = F.array(F.concat(F.lit("\\cl "), part(1)), F.concat(F.lit("\\d "), part(2)))
    return lines.select("doc_id", "line_no", F.posexplode(F.when(whole, both).otherwise(F.array("line"))).alias("sub_no", "line"))


_KINDS = ("c", "cl", "p", "v", "plain", "d", "other")


def paragraph_step(state: int, symbol: int) -> tuple[int, int]:
    """An automaton over the lines of a document: state has 1 in a chapter, 2 after a verse, 4 with a paragraph; the output has 1
    where a paragraph is to open, 2 where plain text is to be a description."""
    kind = _KINDS[symbol]
    if kind == "c":
        return 1, 0
    if not state & 1 or kind in ("cl", "other"):
        return state, 0
    if kind == "p":
        return state | 4, 0
    opens = 0 if state & 4 else 1
    if kind == "v":
        return state | 6, opens
    if state & 2:
        return state, 0
    return state | 4, opens + (2 if kind == "plain" else 0)


def compatible(lines: DataFrame, legacy: bool = False) -> DataFrame:
    """(doc_id, line_no, line) in the form that other programs take: labels and their first words parted, and each \\ide line says
    UTF-8; or (legacy) a paragraph before the first verse or description of a chapter, plain text before the first verse as a description."""
    d = intros_split(lines)
    if not legacy:
        d = d.select("doc_id", "line_no", "sub_no", F.lit(0).alias("more"), F.when(F.col("line").startswith("\\ide "), "\\ide UTF-8").otherwise(F.col("line")).alias("line"))
    else:
        x = F.col("line")
        kind = F.when(x.startswith("\\c "), 0).when(x.startswith("\\cl "), 1).when(x == "\\p", 2).when(x.startswith("\\v "), 3).when(~x.startswith("\\") & (F.trim(x) != ""), 4).when(x.startswith("\\d "), 5).otherwise(6)
        d = scanned(d.withColumn("kind", kind), ["doc_id"], [F.col("line_no").asc(), F.col("sub_no").asc()], "kind", paragraph_step, 8, 0, "does")
        shown = F.when(F.col("does") >= 2, F.concat(F.lit("\\d "), F.trim("line"))).otherwise(F.col("line"))
        d = d.select("doc_id", "line_no", "sub_no", F.posexplode(F.when(F.col("does").isin(1, 3), F.array(F.lit("\\p"), shown)).otherwise(F.array(shown))).alias("more", "line"))
    return numbered(d, [F.col("line_no").asc(), F.col("sub_no").asc(), F.col("more").asc()], ["doc_id"], "no").select("doc_id", F.col("no").alias("line_no"), "line")


def source_verses(lines: DataFrame) -> DataFrame:
    """(doc_id, chapter, verse, text) of a source text: markers in front of later lines go, their text joins the verse; a verse that
    is there again replaces the one before."""
    t = F.trim("line")
    chapter, number = F.regexp_extract(t, r"^\\c\s+(\d+)", 1), F.regexp_extract(t, r"(?i)^\\v\s*(\d+)", 1)
    d = lines.select("doc_id", "line_no", t.alias("t"), F.when(chapter != "", F.struct("line_no", chapter.cast("int").alias("n"))).alias("c"), F.when(number != "", F.struct("line_no", number.cast("int").alias("n"))).alias("v"))
    d = all_carried(d, [("c", "chapter", True), ("v", "verse", True)], ["doc_id"], [F.col("line_no").asc()])
    d = d.where("c is null and verse.line_no > chapter.line_no")
    text = F.when(F.col("v").isNotNull(), F.trim(F.regexp_replace("t", r"(?i)^\\v\s*\d+\s*", ""))).otherwise(F.trim(F.regexp_replace("t", r"^\\[a-z0-9]+\*?\s*", "")))
    d = d.withColumn("text", text).where("v is not null or text <> ''")
    each = d.groupBy("doc_id", F.col("chapter.n").alias("chapter"), "verse").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    return each.groupBy("doc_id", "chapter", F.col("verse.n").alias("number")).agg(F.max_by("text", F.col("verse.line_no")).alias("text")).withColumnRenamed("number", "verse")


def _upper(c: Column) -> Column:
    """Upper case letter by letter: one that has none of its own length stays."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x: F.when(F.char_length(F.upper(x)) == 1, F.upper(x)).otherwise(x)), "")


#: Lines of a file that tell what it is.
HEAD_LINES = 24


def output_identity(lines: DataFrame) -> DataFrame:
    """(doc_id, book, title) from the first lines of a file, null where they don't tell."""
    d = lines.where(F.col("line_no") <= HEAD_LINES)
    word = F.regexp_extract("line", r"^\\id +([^ ]+)", 1)
    title = F.when(F.col("line").startswith("\\mt "), F.trim(F.substring("line", F.lit(5), F.char_length("line"))))
    return d.groupBy("doc_id").agg(F.min_by(_upper(F.trim(word)), F.when(word != "", F.col("line_no"))).alias("book"), F.min_by(title, F.when(title.isNotNull(), F.col("line_no"))).alias("title"))


def file_kind(path: Column) -> Column:
    """What a file is read as, by its suffix: project or usfm; null for others, which nothing reads."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.when(suffix == ".tstudio", "project").when(suffix.isin(".usfm", ".txt"), "usfm")


def job_identity(lines: DataFrame) -> DataFrame:
    """(doc_id, book, name, title, code): what the lines before the first chapter say. The last \\id counts; \\h always sets the title,
    \\toc1 and \\mt only while there is none; name and title stand in for each other. Without a book id the code says so."""
    stop = F.lower(F.regexp_replace("line", r"(?U)^\s+", "")).startswith("\\c ")
    m = F.lower(F.regexp_extract("line", r"(?U)^\s*\\([A-Za-z0-9]+)(?=\s|$)", 1))
    said = F.trim(F.regexp_replace("line", r"(?U)^\s*\\[A-Za-z0-9]+", ""))
    first = F.min(F.when(stop, F.col("line_no")))
    heads = F.array_sort(F.collect_list(F.when(m.isin("id", "h", "toc1", "mt"), F.struct("line_no", m.alias("m"), said.alias("v")))))
    d = lines.groupBy("doc_id").agg(first.alias("c"), heads.alias("x")).select("doc_id", F.filter("x", lambda x: F.col("c").isNull() | (x["line_no"] < F.col("c"))).alias("x"))
    empty = F.struct(F.lit("").alias("id"), F.lit("").alias("name"), F.lit("").alias("title"))

    def read(s: Column, x: Column) -> Column:
        rest = F.trim(F.regexp_replace(x["v"], r"(?U)^\S+", ""))
        book = F.struct(F.regexp_extract(x["v"], r"(?U)^(\S+)", 1).alias("id"), rest.alias("name"), s["title"].alias("title"))
        titled = F.struct(s["id"].alias("id"), s["name"].alias("name"), x["v"].alias("title"))
        return F.when(x["m"] == "id", book).when((x["m"] == "h") | (s["title"] == ""), titled).otherwise(s)

    d = d.select("doc_id", F.aggregate("x", empty, read).alias("s"))
    either = lambda a, b: F.coalesce(F.when(a != "", a), F.when(b != "", b))
    return d.select("doc_id", F.when(F.col("s.id") != "", F.col("s.id")).alias("book"), either(F.col("s.name"), F.col("s.title")).alias("name"), either(F.col("s.title"), F.col("s.name")).alias("title"), F.when(F.col("s.id") == "", "ID_MISSING").alias("code"))


def to_chunks(verse_rows: DataFrame, starts: DataFrame, keys=("doc_id", "book", "chapter")) -> DataFrame:
    """(keys, chunk_start, first_verse, last_verse, content): verses of a canonical chunk, joined in order."""
    from .lookups import floor

    d = floor(verse_rows, "verse", starts, "start", ["book", "chapter"], "chunk_start")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verse", F.concat(F.lit(r"\v "), F.col("verse").cast("string"), F.lit(" "), F.col("text")).alias("t")))), lambda x: x["t"]), " ")
    return d.groupBy(*keys, "chunk_start").agg(F.min("verse").alias("first_verse"), F.max("verse").alias("last_verse"), text.alias("content"))


def project_lines(book: Column, title: Column) -> Column:
    """The seven header lines of an exported project."""
    return F.array(F.concat(F.lit(r"\id "), book), F.lit(r"\ide UTF-8"), *[F.concat(F.lit(f"\\{m} "), title) for m in ("h", "toc1", "toc2", "toc3", "mt")])
