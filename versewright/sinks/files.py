"""Rows as files: marked-up text, verse lines, project packages, reports.

Every file is one row (path, content) first; ``write`` puts rows into a store. A document must fit a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewright.functions import patterns as P
from versewright.functions import text as T


def usfm(lines: DataFrame) -> DataFrame:
    """(doc_id, content): lines in order, trimmed on the right, behind a BOM."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", F.rtrim("line").alias("line"))))
    g = lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("t"))
    return g.select("doc_id", F.encode(F.concat(F.lit("﻿"), "t", F.lit("\n")), "UTF-8").alias("content"))


def verse_lines(verses: DataFrame) -> DataFrame:
    """(doc_id, book, content): a heading line for the book, then chapter:verse, a tab and the text."""
    rows = F.array_sort(F.collect_list(F.struct("chapter", "verse", F.concat(F.col("chapter").cast("string"), F.lit(":"), F.col("verse").cast("string"), F.lit("\t"), "text").alias("t"))))
    g = verses.groupBy("doc_id", "book").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("t"))
    return g.select("doc_id", "book", F.concat(F.lit("# "), "book", F.lit("\n"), "t", F.lit("\n")).alias("content"))


def file_name(language, book, resource, producer=None):
    """{language}_{book}_text_{resource}[_{producer}].usfm, in lower case, each part made fit for a file name."""
    parts = [T.file_stem(language), T.file_stem(book), F.lit("text"), T.file_stem(resource)] + ([T.file_stem(producer)] if producer is not None else [])
    return F.concat(F.concat_ws("_", *parts), F.lit(".usfm"))


# What a package's manifests say.
PACKAGE_VERSION, OUTER_VERSION = 8, 2
LICENSE = "Generated by versewright."
LANGUAGE_NAMES = {"skr": "سرائیکی", "urd": "اردو", "ur": "اردو", "rus": "Russian", "ru": "Russian"}
SOURCE_TRANSLATION = {"language_id": "en", "resource_id": "ulb", "checking_level": "3", "date_modified": 20170329, "version": "9"}


def _generator():
    return F.struct(F.lit(P.GENERATOR_NAME).alias("name"), F.lit(P.GENERATOR_BUILD).alias("build"))


def folder_name(language, book, resource):
    """The name of a project's folder and package."""
    return F.concat_ws("_", T.identifier(language, "und"), F.lower(book), F.lit("text"), resource)


def project_files(chunk_rows: DataFrame, names: DataFrame, timestamp: int) -> DataFrame:
    """(doc_id, path, content) of a package's files: outer and inner manifest, licence, front title, chapter titles, chunks.

    chunk_rows(doc_id, book, chapter, chunk_start, content); names(doc_id, language, title, project_name, resource_id,
    resource_name, rtl) and, if chapters have titles of their own, chapter_titles map<int,string>. The list of finished chunks has the front title, then each
    chapter's title and chunks in their order; direction follows rtl. Documents without chunks have no files.
    """
    d = chunk_rows.where("chunk_start is not null").join(names, "doc_id").withColumn("folder", folder_name(F.col("language"), F.col("book"), F.col("resource_id")))
    ch, st = T.two_digits(F.col("chapter")), T.two_digits(F.col("chunk_start"))
    own = F.try_element_at("chapter_titles", F.col("chapter")) if "chapter_titles" in names.columns else F.lit(None).cast("string")
    title = F.coalesce(F.when(F.trim(own) != "", F.trim(own)), F.concat(F.when(T.is_rtl(F.col("title")), f"{P.CHAPTER_WORD} ").otherwise("Chapter "), F.col("chapter").cast("string")))
    file = lambda df, path, content: df.select("doc_id", F.concat_ws("/", "folder", path).alias("path"), F.concat(content, F.lit("\n")).alias("content"))
    chunks = file(d, F.concat(ch, F.lit("/"), st, F.lit(".txt")), F.trim("content"))
    by_chapter = d.select("doc_id", "folder", "chapter", ch.alias("ch"), title.alias("chapter_title")).distinct()
    titles = file(by_chapter, F.concat("ch", F.lit("/title.txt")), F.col("chapter_title"))
    heads = d.select("doc_id", "chapter", F.lit(0).alias("chunk_start"), F.concat(ch, F.lit("-title")).alias("t")).distinct()
    each = d.select("doc_id", "chapter", "chunk_start", F.concat(ch, F.lit("-"), st).alias("t")).unionByName(heads)
    done = each.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("chapter", "chunk_start", "t"))).alias("x"))
    about = d.select("doc_id", "folder", "book", *[c for c in names.columns if c not in ("doc_id", "chapter_titles")]).distinct().join(done, "doc_id")
    code = T.identifier(F.col("language"), "und")
    shown = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LANGUAGE_NAMES.items() for x in p]), code), code)
    direction = F.when(F.col("rtl"), "rtl").otherwise("ltr")
    inner = F.struct(
        F.lit(PACKAGE_VERSION).alias("package_version"), F.lit("usfm").alias("format"), _generator().alias("generator"),
        F.struct(code.alias("id"), shown.alias("name"), direction.alias("direction")).alias("target_language"), F.struct(F.lower("book").alias("id"), F.col("project_name").alias("name")).alias("project"),
        F.struct(F.lit("text").alias("id"), F.lit("Text").alias("name")).alias("type"), F.struct(F.col("resource_id").alias("id"), F.col("resource_name").alias("name")).alias("resource"),
        F.array(F.struct(*[F.lit(v).alias(k) for k, v in SOURCE_TRANSLATION.items()])).alias("source_translations"), F.create_map().cast("map<string,string>").alias("parent_draft"), F.array().cast("array<string>").alias("translators"),
        F.concat(F.array(F.lit("front-title")), F.transform("x", lambda x: x["t"])).alias("finished_chunks"),
    )
    outer = F.struct(
        _generator().alias("generator"), F.lit(OUTER_VERSION).alias("package_version"), F.lit(timestamp).cast("long").alias("timestamp"),
        F.array(F.struct(F.col("folder").alias("path"), F.col("folder").alias("id"), F.struct(F.lit("").alias("stdout"), F.lit("").alias("stderr"), F.lit(None).cast("string").alias("error")).alias("commit_hash"), direction.alias("direction"))).alias("target_translations"),
    )
    as_json = lambda c: F.to_json(c, {"ignoreNullFields": "false", "pretty": "true"})
    front = file(about, F.lit("front/title.txt"), F.col("title"))
    rights = file(about, F.lit("LICENSE.md"), F.lit(LICENSE))
    manifest = file(about, F.lit("manifest.json"), as_json(inner))
    top = about.select("doc_id", F.lit("manifest.json").alias("path"), F.concat(as_json(outer), F.lit("\n")).alias("content"))
    return chunks.unionByName(titles).unionByName(front).unionByName(rights).unionByName(manifest).unionByName(top)


def packages(files: DataFrame, suffix: str = ".tstudio") -> DataFrame:
    """(path, content): one zip archive for each doc_id, its files in order of their paths."""

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(pdf["path"], pdf["content"])):
                z.writestr(zipfile.ZipInfo(path), content)
        return pd.DataFrame([(f"{key[0]}{suffix}", out.getvalue())], columns=["path", "content"])

    return files.groupBy("doc_id").applyInPandas(pack, "path string, content binary")


def write(files: DataFrame, folder: str) -> DataFrame:
    """Write (path, content) below a folder, each under a name of its own first; (path, bytes) of what was written.

    A file that is there already is an error: outputs never replace inputs.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                to = f"{root}/{path}"
                if store.get_file_info(to).type != fs.FileType.NotFound:
                    raise FileExistsError(to)
                store.create_dir(to.rpartition("/")[0], recursive=True)
                part = f"{to}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, to)
                yield pd.DataFrame([(path, len(content))], columns=["path", "bytes"])

    return files.select("path", "content").mapInPandas(put, "path string, bytes long")


def report(issues: DataFrame, most: int | None = None) -> DataFrame:
    """(line) of a report: counts by code, then issues in a fixed order, ``most`` of them if given."""
    counts = issues.groupBy("code").agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), "code", F.concat("code", F.lit(": "), F.col("n").cast("string")).alias("line"))
    rows = issues.select(F.lit(1).alias("part"), "code", F.concat_ws(" ", "severity", "code", "doc_id").alias("line")).orderBy("code", "line")
    return counts.unionByName(rows.limit(most) if most is not None else rows).orderBy("part", "code", "line").select("line")


def html_escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def canon_report(issues: DataFrame) -> DataFrame:
    """Issues that a report of the canon has, in their order: books found, canon scope, counts, chapters out of place."""
    return issues.where(F.col("code").isin(*CANON_CODES)).orderBy("code", "doc_id")


# The codes of a report of the canon.
CANON_CODES = ("CANON_SELECTED", "VERSIFICATION_PROFILE_SELECTED", "BOOKS_DETECTED_OT", "BOOKS_DETECTED_NT", "CANON_PROFILE_SCOPE", "CHAPTER_COUNT_MISMATCH", "BOOK_ORDER_MISMATCH")


def issues_json(issues: DataFrame, path: str) -> None:
    """Issues as JSON lines below a new folder."""
    issues.write.mode("errorifexists").json(path)


def issues_text(issues: DataFrame) -> DataFrame:
    """(line): one line for each issue, in a fixed order: severity, code, document, message."""
    message = F.coalesce(F.col("message"), F.lit("")) if "message" in issues.columns else F.lit("")
    return issues.select(F.trim(F.concat_ws(" | ", F.col("severity"), F.col("code"), F.col("doc_id"), message)).alias("line")).orderBy("line")


def html_report(rows: DataFrame, title: str) -> DataFrame:
    """(section, row_no, html) of audit.report_rows(): a table row each, escaped; the head of a section has row_no 0."""
    cell = lambda c: F.concat(F.lit("<td>"), html_escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>"))
    cols = ("row_no", "path", "reference", "line", "column", "label", "quantity", "original", "replacement")
    body = rows.select("section", "row_no", F.concat(F.lit("<tr>"), *[cell(F.col(c)) for c in cols], F.lit("</tr>")).alias("html"))
    head = rows.select("section").distinct().select("section", F.lit(0).alias("row_no"), F.concat(F.lit(f"<h2>{title}: "), html_escaped(F.col("section")), F.lit("</h2>")).alias("html"))
    return head.unionByName(body).orderBy("section", "row_no")


def unique_folder(spark, parent: str, name: str) -> str:
    """parent/name, or the first of "name (2)", "name (3)", … that isn't there."""
    from itertools import count

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for i in count(1):
        at = f"{parent.rstrip('/')}/{name if i == 1 else f'{name} ({i})'}"
        p = jvm.org.apache.hadoop.fs.Path(at)
        if not p.getFileSystem(conf).exists(p):
            return at
