"""Files as rows: marked-up text, archives and their entries, word-processor paragraphs, reference tables.

Files are read through Spark's binaryFile source, so any store that Spark reaches will do; nothing is ever
extracted to a disk. An archive must fit a row (2 GB); its entries are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def texts(spark: SparkSession, path: str, glob: str = "*.{usfm,txt}") -> DataFrame:
    """(path, text, had_bom): UTF-8, without its BOM bytes; invalid bytes are U+FFFD."""
    bom = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    t = F.expr("make_valid_utf8(cast(content as string))")
    return binary(spark, path, glob).select("path", F.when(bom, F.regexp_replace(t, "^﻿", "")).otherwise(t).alias("text"), bom.alias("had_bom"))


def lines(files: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of (path, text); line_no starts at 1."""
    d = files.select(F.col("path").alias("doc_id"), F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    return d.select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


def entries(archives: DataFrame) -> DataFrame:
    """(archive, path, content) of the files in zip archives(path, content). A broken archive has no entries here; broken()
    has a row for it."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(raw))
                except zipfile.BadZipFile:
                    continue
                for info in z.infolist():
                    if not info.is_dir():
                        yield pd.DataFrame([(name, info.filename.replace("\\", "/"), z.read(info))], columns=["archive", "path", "content"])

    return archives.select("path", "content").mapInPandas(unzip, "archive string, path string, content binary")


RUNS = "array<struct<text:string,style:string,superscript:boolean,kind:string>>"


def paragraphs(archives: DataFrame) -> DataFrame:
    """(doc_id, para_no, sub_no, text, style, is_numbered, runs) of .docx archives(path, content).

    Breaks part a paragraph into lines that share its number; tabs are kept as tabs; a numbering id of 0
    is no numbering. Documents without a body have no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                rows = [(name, *r) for r in body(raw)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "para_no", "sub_no", "text", "style", "is_numbered", "runs"])

    return archives.select("path", "content").mapInPandas(read, f"doc_id string, para_no int, sub_no int, text string, style string, is_numbered boolean, runs {RUNS}")


def body(raw: bytes) -> list[tuple]:
    import io
    import zipfile
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out = []
    for no, p in enumerate(root.findall(f"{W}body/{W}p"), 1):
        style = p.find(f"{W}pPr/{W}pStyle")
        num = p.find(f"{W}pPr/{W}numPr/{W}numId")
        numbered = num is not None and num.get(f"{W}val") not in (None, "0")
        parts: list[list[dict]] = [[]]
        for r in p.iter(f"{W}r"):
            char = r.find(f"{W}rPr/{W}rStyle")
            up = r.find(f"{W}rPr/{W}vertAlign")
            about = {"style": None if char is None else char.get(f"{W}val"), "superscript": up is not None and up.get(f"{W}val") == "superscript"}
            for x in r:
                if x.tag == f"{W}t":
                    parts[-1].append({"text": x.text or "", "kind": "text", **about})
                elif x.tag == f"{W}tab":
                    parts[-1].append({"text": "\t", "kind": "tab", **about})
                elif x.tag == f"{W}br":
                    parts.append([])
                elif x.tag == f"{W}footnoteReference":
                    parts[-1].append({"text": x.get(f"{W}id") or "", "kind": "footnote", **about})
        for sub, runs in enumerate(parts):
            text = "".join(r["text"] for r in runs if r["kind"] != "footnote")
            out.append((no, sub, text, None if style is None else style.get(f"{W}val"), numbered, runs))
    return out


def broken(archives: DataFrame, needed: str | None = None) -> DataFrame:
    """(path, code): archives(path, content) that can't be read: ZIP_INVALID, or DOCX_ENTRY_MISSING, DOCX_XML_PARSE_FAILED and
    DOCX_BODY_MISSING for the entry that is needed of each (word/document.xml for word-processor documents)."""

    @F.pandas_udf("string")
    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda raw: _broken(raw, needed))

    return archives.select("path", check("content").alias("code")).where("code is not null")


def _broken(raw: bytes | None, needed: str | None) -> str | None:
    import io
    import zipfile
    from xml.etree import ElementTree

    try:
        z = zipfile.ZipFile(io.BytesIO(raw or b""))
        if z.testzip() is not None:
            return "ZIP_INVALID"
        if needed is None:
            return None
        root = ElementTree.fromstring(z.read(needed))
    except zipfile.BadZipFile:
        return "ZIP_INVALID"
    except KeyError:
        return "DOCX_ENTRY_MISSING"
    except ElementTree.ParseError:
        return "DOCX_XML_PARSE_FAILED"
    return "DOCX_BODY_MISSING" if needed == DOCUMENT and root.find(f"{W}body") is None else None


DOCUMENT = "word/document.xml"


def _parts(archives: DataFrame, entry: str, schema: str, read) -> DataFrame:
    """Rows that read(root) makes of one XML entry of each archive; archives without it have none."""
    names = [c.split()[0] for c in schema.split(",")]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        from xml.etree import ElementTree

        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read(entry))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                if rows := [(name, *r) for r in read(root)]:
                    yield pd.DataFrame(rows, columns=names)

    return archives.select("path", "content").mapInPandas(go, schema)


def styles(archives: DataFrame) -> DataFrame:
    """(doc_id, kind, style_id): the paragraph and character styles of word-processor documents."""
    kinds = ("paragraph", "character")
    read = lambda root: [(x.get(f"{W}type"), x.get(f"{W}styleId")) for x in root.iter(f"{W}style") if x.get(f"{W}type") in kinds and x.get(f"{W}styleId")]
    return _parts(archives, "word/styles.xml", "doc_id string,kind string,style_id string", read)


def properties(archives: DataFrame) -> DataFrame:
    """(doc_id, name, value): custom properties with a name and a value; the last of a name counts."""
    ns = "{http://schemas.openxmlformats.org/officeDocument/2006/custom-properties}property"

    def read(root) -> list[tuple[str, str]]:
        found = {x.get("name"): "".join(x.itertext()).strip() for x in root.iter(ns) if (x.get("name") or "").strip() and "".join(x.itertext()).strip()}
        return list(found.items())

    return _parts(archives, "docProps/custom.xml", "doc_id string,name string,value string", read)


def merged(paragraph_rows: DataFrame, order: DataFrame) -> DataFrame:
    """Paragraphs of a folder's chapter files as one document: order(doc_id, merged_id, rank) says which file belongs where;
    files whose name begins with ~$ are left out. Paragraphs are numbered anew."""
    from pyspark.sql import Window

    d = paragraph_rows.where(~F.col("doc_id").rlike(r"(^|/)~\$[^/]*$")).join(order, "doc_id")
    no = F.dense_rank().over(Window.partitionBy("merged_id").orderBy("rank", "doc_id", "para_no"))
    return d.withColumn("para_no", no).withColumn("doc_id", F.col("merged_id")).drop("merged_id", "rank")


def footnotes(archives: DataFrame) -> DataFrame:
    """(doc_id, id, text); ids below zero and blank notes are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        from xml.etree import ElementTree

        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/footnotes.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                notes = [(name, n.get(f"{W}id"), "".join(t.text or "" for t in n.iter(f"{W}t"))) for n in root.iter(f"{W}footnote")]
                notes = [n for n in notes if n[1] and not n[1].startswith("-") and n[2].strip()]
                if notes:
                    yield pd.DataFrame(notes, columns=["doc_id", "id", "text"])

    return archives.select("path", "content").mapInPandas(read, "doc_id string, id string, text string")


def with_footnotes(parts: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, para_no, sub_no, text, missing): notes put in line at their references; ids without a note."""
    r = parts.select("doc_id", "para_no", "sub_no", F.posexplode_outer("runs").alias("i", "r"))
    r = r.join(notes.select("doc_id", F.col("id").alias("nid"), F.col("text").alias("note")), (r["doc_id"] == notes["doc_id"]) & (F.col("r.kind") == "footnote") & (F.col("r.text") == F.col("nid")), "left").select(r["doc_id"], "para_no", "sub_no", "i", "r", "note")
    shown = F.when(F.col("r.kind") == "footnote", F.when(F.col("note").isNotNull(), F.concat(F.lit(r"\f + \ft "), "note", F.lit(r"\f*"))).otherwise("")).otherwise(F.col("r.text"))
    lost = F.when((F.col("r.kind") == "footnote") & F.col("note").isNull(), F.col("r.text"))
    g = r.groupBy("doc_id", "para_no", "sub_no").agg(F.array_sort(F.collect_list(F.struct("i", shown.alias("t")))).alias("x"), F.array_sort(F.collect_set(lost)).alias("missing"))
    return g.select("doc_id", "para_no", "sub_no", F.array_join(F.transform("x", lambda s: s["t"]), "").alias("text"), "missing")


def versification(spark: SparkSession, path: str, profile: str) -> DataFrame:
    """(profile, book, chapter, max_verse) from JSON with maxVerses: book to a list of numbers or numerals."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "maxVerses map<string,array<string>>").alias("m"))
    d = raw.select(F.explode("m.maxVerses").alias("book", "v")).select("book", F.posexplode("v").alias("i", "n"))
    return d.select(F.lit(profile).alias("profile"), "book", (F.col("i") + 1).alias("chapter"), F.col("n").try_cast("int").alias("max_verse"))


def invalid_versification(dim: DataFrame) -> DataFrame:
    """Rows whose count isn't a positive number."""
    return dim.where("max_verse is null or max_verse <= 0")


def check_versification(dim: DataFrame, profile: str, expected: str, books: int = 39) -> DataFrame:
    """(code, found): a versification that isn't the one expected, has another number of books, or counts that aren't positive."""
    n = dim.agg(F.countDistinct("book").alias("n"), F.count_if(F.col("max_verse").isNull() | (F.col("max_verse") <= 0)).alias("bad"))
    codes = F.array_compact(F.array(
        F.when(F.lit(profile) != expected, F.struct(F.lit("PROFILE_ID").alias("code"), F.lit(profile).alias("found"))),
        F.when(F.col("n") != books, F.struct(F.lit("BOOK_COUNT").alias("code"), F.col("n").cast("string").alias("found"))),
        F.when(F.col("bad") > 0, F.struct(F.lit("COUNT_NOT_POSITIVE").alias("code"), F.col("bad").cast("string").alias("found"))),
    ))
    return n.select(F.explode(codes).alias("x")).select("x.*")


# What a language profile has, and what it has where it says nothing.
PROFILE = "id string, name string, bookAliases map<string,array<string>>, headingPrefixes array<string>, inlineSplitPhrases array<string>, psalmChapterKeywords array<string>, psalmSuperscriptionStarts array<string>, psaMainTitle string"
DEFAULT_PROFILE = "global-starter"


def profiles(spark: SparkSession, paths: list[str], defaults: dict[str, list[str]] | None = None) -> DataFrame:
    """Language profiles from JSON files: the first file of an id (without case, by path) wins; a file without an id takes its
    stem, one without aliases or that is no JSON is left out. Lists are trimmed, distinct and without blanks; an empty one
    is the default's. columns: those of PROFILE."""
    from pyspark.sql import Window

    d = spark.read.option("wholetext", "true").text(paths).select("value", F.input_file_name().alias("file"))
    d = d.select("file", F.from_json("value", PROFILE, {"allowComments": "true", "mode": "PERMISSIVE"}).alias("p")).select("file", "p.*").where(F.size("bookAliases") > 0)
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    d = d.withColumn("id", F.coalesce(F.nullif(F.trim("id"), F.lit("")), stem)).withColumn("name", F.coalesce(F.trim("name"), "id"))

    def clean(c: str):
        full = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
        once = F.filter(full, lambda x, i: F.array_position(F.transform(full, lambda y: F.lower(y)), F.lower(x)) == i + 1)
        other = F.array(*[F.lit(x) for x in (defaults or {}).get(c, [])]).cast("array<string>")
        return F.when(F.coalesce(F.size(once), F.lit(0)) > 0, once).otherwise(other)

    for c in ("headingPrefixes", "inlineSplitPhrases", "psalmChapterKeywords", "psalmSuperscriptionStarts"):
        d = d.withColumn(c, clean(c))
    return d.withColumn("n", F.row_number().over(Window.partitionBy(F.lower("id")).orderBy("file"))).where("n = 1").drop("n", "file")


def profile(all_: DataFrame, profile_id: str | None = None) -> DataFrame:
    """The profile of an id (without case); without one the default's, or the first by id. An unknown id is an error that names
    those that are there."""
    rows = [r["id"] for r in all_.select("id").orderBy("id").collect()]  # a profile for each language file
    want = (profile_id or (DEFAULT_PROFILE if DEFAULT_PROFILE in {r.lower() for r in rows} else rows[0] if rows else "")).lower()
    if rows and want not in {r.lower() for r in rows}:
        raise ValueError(f"Unknown profile '{profile_id}'. Available profiles: {', '.join(rows)}.")
    return all_.where(F.lower("id") == want)


def aliases(profile_rows: DataFrame) -> DataFrame:
    """(book, alias, priority): books in capitals, names trimmed, lower case, distinct."""
    d = profile_rows.select(F.explode("bookAliases").alias("book", "names")).where("trim(book) <> ''")
    d = d.select(F.upper(F.trim("book")).alias("book"), F.posexplode(F.array_distinct(F.filter(F.transform("names", lambda x: F.lower(F.trim(x))), lambda x: x != ""))).alias("priority", "alias"))
    return d.select("book", "alias", "priority")
