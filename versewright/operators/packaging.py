"""Marked-up books to project packages: what a packager reads, what it rejects, chunks and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versewright.functions import text as T
from versewright.sinks import files

from . import lookups
from .shared import stored

# A book without an id, and the resource of a book without one.
UNKNOWN, RESOURCE_NAME, RESOURCE_ID = "UNK", "Regular", "reg"


def _read(lines: DataFrame) -> DataFrame:
    """Trimmed lines with the chapter they belong to."""
    d = lines.select("doc_id", "line_no", F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("t")).where("t <> ''")
    n = F.when(F.col("t").startswith("\\c "), F.trim(F.substring("t", 4, 10_000)).try_cast("int"))
    d = d.withColumn("n", F.when(n > 0, n))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("chapter", F.last("n", True).over(w)).withColumn("seq", F.count("n").over(w))


def books(lines: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, book, title, project_name, resource_id, resource_name, rtl, chapter_titles): of \\id, of the first line of
    \\h, \\toc1 and \\mt that has text, and of \\cl lines; a book without a title has its id."""
    return _books(_read(lines), names)


def _books(d: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    t, no = F.col("t"), F.col("line_no")
    parts = F.split(t, " +")
    is_id = t.startswith("\\id ")
    head = t.startswith("\\h ") | t.startswith("\\toc1 ") | t.startswith("\\mt ")
    text = F.trim(F.regexp_replace(t, r"^\\\S+ ", ""))
    third = is_id & (F.size(parts) >= 3)
    g = d.groupBy("doc_id").agg(
        F.max_by(F.upper(F.get(parts, 1)), F.when(is_id & (F.size(parts) >= 2), no)).alias("book"), F.max_by(F.array_join(F.slice(parts, 3, 1000), " "), F.when(third, no)).alias("resource"),
        F.min_by(text, F.when(head & (text != ""), no)).alias("title"), F.max(T.is_rtl(t)).alias("rtl"),
    )
    own = d.where("seq > 0").where(F.col("t").startswith("\\cl ")).groupBy("doc_id", "chapter").agg(F.max_by(F.trim(F.substring("t", 5, 10_000)), "line_no").alias("x"))
    own = own.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter", "x")))).alias("chapter_titles"))
    book = F.coalesce("book", F.lit(UNKNOWN))
    resource = F.coalesce("resource", F.lit(RESOURCE_NAME))
    known = F.create_map(*[F.lit(x) for p in names.items() for x in p]) if names else None
    g = g.join(own, "doc_id", "left")
    return g.select(
        "doc_id", book.alias("book"), F.coalesce("title", book).alias("title"), (F.coalesce(F.try_element_at(known, book), book) if names else book).alias("project_name"),
        F.when(F.lower(resource) == RESOURCE_NAME.lower(), RESOURCE_ID).otherwise(T.identifier(resource)).alias("resource_id"), resource.alias("resource_name"), F.coalesce("rtl", F.lit(False)).alias("rtl"),
        F.coalesce("chapter_titles", F.create_map().cast("map<int,string>")).alias("chapter_titles"),
    )


def verses(lines: DataFrame) -> DataFrame:
    """(doc_id, seq, chapter, verse, text, line_no, pos): verses of lines that begin with a verse marker, in chapters; several of a line too.
    Other lines are left out, those that carry a verse on as well; so are verses without text."""
    return _verses(_read(lines))


def _verses(d: DataFrame) -> DataFrame:
    d = d.where(F.col("t").startswith("\\v ") & (F.col("seq") > 0))
    n = F.regexp_extract_all("t", F.lit(r"(?i)\\v\s*(\d+)"), F.lit(1))
    body = F.slice(F.split("t", r"(?i)\\v\s*\d+"), 2, 100_000)
    d = d.select("doc_id", "seq", "chapter", "line_no", F.posexplode(F.arrays_zip(n.alias("n"), body.alias("x"))).alias("pos", "z"))
    return d.select("doc_id", "seq", "chapter", F.col("z.n").try_cast("int").alias("verse"), F.trim("z.x").alias("text"), "line_no", "pos").where("verse > 0 and text <> ''")


def rejected(lines: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(doc_id, code, chapter, verse): why a document is not packaged: no chapters, chapters twice or not ascending, verses
    twice or descending in a chapter, verses before a chapter's first canonical chunk. Gaps are allowed. A row each."""
    d = stored(_read(lines), "lines")
    return _rejected(d, stored(_verses(d), "verses"), starts)


def _rejected(d: DataFrame, v: DataFrame, starts: DataFrame | None) -> DataFrame:
    none = F.lit(None).cast("int")
    row = lambda df, code, c, n: df.select("doc_id", F.lit(code).alias("code"), c.alias("chapter"), n.alias("verse"))
    c = d.where("n is not null").select("doc_id", "line_no", "n")
    out = row(d.select("doc_id").distinct().join(c.select("doc_id").distinct(), "doc_id", "left_anti"), "NO_CHAPTERS", none, none)
    out = out.unionByName(row(c.groupBy("doc_id", "n").count().where("count > 1"), "CHAPTER_DUPLICATE", F.col("n"), none))
    late = c.withColumn("p", F.lag("n").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("n < p")
    out = out.unionByName(row(late, "CHAPTER_OUT_OF_ORDER", F.col("n"), none))
    out = out.unionByName(row(v.groupBy("doc_id", "seq", "chapter", "verse").count().where("count > 1"), "VERSE_DUPLICATE", F.col("chapter"), F.col("verse")))
    down = v.withColumn("p", F.lag("verse").over(Window.partitionBy("doc_id", "seq").orderBy("line_no", "pos"))).where("verse < p")
    out = out.unionByName(row(down, "VERSE_OUT_OF_ORDER", F.col("chapter"), F.col("verse")))
    if starts is not None:
        lowest = starts.groupBy("book", "chapter").agg(F.min("start").alias("lo"))
        early = v.join(_books(d).select("doc_id", "book"), "doc_id").join(lookups.small(lowest), ["book", "chapter"]).where("verse < lo")
        out = out.unionByName(row(early, "VERSE_BEFORE_FIRST_CHUNK", F.col("chapter"), F.col("verse")))
    return out


def chunks(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, book, chapter, chunk_start, content): verses by canonical chunk, in order, each with its marker; a chapter
    without canonical chunks has a chunk for each verse."""
    d = stored(_read(lines), "lines")
    return _chunks(_verses(d), _books(d), starts)


def _chunks(v: DataFrame, about: DataFrame, starts: DataFrame) -> DataFrame:
    v = v.join(about.select("doc_id", "book"), "doc_id")
    d = lookups.floor(v, "verse", starts, "start", ["book", "chapter"], "home")
    mapped = starts.select("book", "chapter").distinct().withColumn("mapped", F.lit(True))
    d = d.join(lookups.small(mapped), ["book", "chapter"], "left").withColumn("chunk_start", F.when(F.col("mapped"), F.col("home")).otherwise(F.col("verse"))).where("chunk_start is not null")
    text = F.concat(F.lit("\\v "), F.col("verse").cast("string"), F.lit(" "), F.col("text"))
    g = d.groupBy("doc_id", "book", "chapter", "chunk_start").agg(F.array_sort(F.collect_list(F.struct("verse", "line_no", "pos", text.alias("t")))).alias("x"))
    return g.select("doc_id", "book", "chapter", "chunk_start", F.array_join(F.transform("x", lambda s: s["t"]), " ").alias("content"))


def package_files(lines: DataFrame, starts: DataFrame, language: str, timestamp: int, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, issues): the files of a package for each document without an issue, and the issues of the others."""
    d = stored(_read(lines), "lines")
    v = stored(_verses(d), "verses")
    bad = stored(_rejected(d, v, starts), "issues")
    ids = bad.select("doc_id").distinct()
    about = stored(_books(d.join(ids, "doc_id", "left_anti"), names).withColumn("language", F.lit(language)), "books")
    good = stored(_chunks(v.join(ids, "doc_id", "left_anti"), about, starts), "chunks")
    return files.project_files(good, about.drop("book"), timestamp), bad
