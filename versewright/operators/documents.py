"""Whole-document checks and repairs: direct speech against a source, inferred verses, coverage, remaps, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versewright.functions import patterns as P
from versewright.functions import text as T

from . import lookups, sequences

# The word and the quotes of a language's direct speech, and what may follow a phrase's end.
SPEECH_WORD = "کہ"
PHRASE_ENDS, PHRASE_TAIL = ".۔!?؟:;؛", "'\"’”»)\\]}"


def source_text(chunks: DataFrame, source: DataFrame) -> DataFrame:
    """chunks(…, book, chapter, start, text) with ``source``: the source's verses from the least to the greatest number
    in the chunk, its start if it has none; blank verses are skipped.

    Where both sides have an archive and a project_root, a chunk has only its own project's source. Equal ranges are looked up once.
    """
    keys = [c for c in ("archive", "project_root", "book", "chapter") if c in chunks.columns and c in source.columns]
    n = T.verse_numbers(F.col("text"))
    d = chunks.withColumn("__lo", F.coalesce(F.array_min(n), F.col("start"))).withColumn("__hi", F.coalesce(F.array_max(n), F.col("start")))
    wanted = d.select(*keys, "__lo", "__hi").distinct()
    hit = wanted.join(source.select(*keys, "verse", F.col("text").alias("t")), keys).where("verse between __lo and __hi and trim(t) <> ''")
    text = hit.groupBy(*keys, "__lo", "__hi").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("verse", "t"))), lambda x: x["t"]), " ").alias("source"))
    return d.join(text, [*keys, "__lo", "__hi"], "left").drop("__lo", "__hi")


def direct_speech(text: Column, source: Column) -> Column:
    """The conjunction before an opening quote goes if the source has whole quotes and the text closes its own; else the
    opening quote goes. Texts without both, or without a source, stay."""
    lead = rf"(?U)(?<!\S){SPEECH_WORD}\s+’+"
    closed = text.rlike(rf"(?s){lead}.*‘")
    no_word = F.regexp_replace(text, rf"(?U)(?<!\S){SPEECH_WORD}\s+(?=’)", "")
    no_quote = F.regexp_replace(text, rf"(?U)(?<!\S)({SPEECH_WORD})\s+’+", "$1 ")
    applies = text.contains(SPEECH_WORD) & text.rlike("[’‘]") & (F.trim(F.coalesce(source, F.lit(""))) != "")
    return F.when(applies, F.when(T.complete_quotes(source) & closed, no_word).otherwise(no_quote)).otherwise(text)


def ends_phrase(text: Column) -> Column:
    """Whether a text ends with a phrase's stop, closing quotes and brackets aside."""
    return F.coalesce(text.rlike(rf"(?U)[{PHRASE_ENDS}][\s{PHRASE_TAIL}]*$"), F.lit(False))


def leading_verse(text: Column) -> Column:
    """The number that a text begins with, to MOST_VERSES; null without one."""
    n = T.ascii_digits(F.regexp_extract(text, rf"(?U)^\s*({P.DIGITS}{{1,3}})(?:[\s.)۔:]|$)", 1)).try_cast("int")
    return F.when((n >= 1) & (n <= P.MOST_VERSES), n)


def inferred_verses(paragraphs: DataFrame, chapter: str = "chapter", most: str = "max_verse") -> DataFrame:
    """paragraphs(doc_id, para_no, text, chapter, verse, max_verse) with ``infer``: "first" where a chapter's text stands
    before its verse 2, "next" where an unnumbered paragraph follows a finished phrase below the chapter's count."""
    d = sequences.neighbours(paragraphs, "text", ["doc_id"], ["para_no"])
    plain = (F.char_length(F.trim("text")) >= 3) & leading_verse(F.col("text")).isNull()
    first = (F.col(chapter) > 0) & (F.coalesce("verse", F.lit(0)) == 0) & (F.col(most) >= 2) & plain & (leading_verse(F.col("after")) == 2)
    nxt = (F.col(chapter) > 0) & (F.col("verse") > 0) & (F.coalesce(F.col(most), F.lit(0)).isin(0) | (F.col("verse") < F.col(most))) & plain & ends_phrase(F.col("before"))
    return d.withColumn("infer", F.when(first, "first").when(nxt, "next")).drop("before", "after")


def canon_issues(verses: DataFrame, versification: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, book, code, chapter, verse): chapters and verses that a canon has and the text not, or the other way round. keys tell
    documents apart: each is held against the canon alone."""
    keys = list(keys)
    have_v, have_c = verses.select(*keys, "book", "chapter", "verse").distinct(), verses.select(*keys, "book", "chapter").distinct()
    books = have_c.select(*keys, "book").distinct()
    canon = lookups.small(versification.select("book", "chapter", "max_verse"))
    want = books.join(canon, "book").select(*keys, "book", "chapter", "max_verse")
    none = F.lit(None).cast("int")
    row = lambda d, code, verse: d.select(*keys, "book", F.lit(code).alias("code"), "chapter", verse.alias("verse"))
    at = [*keys, "book", "chapter"]
    lost_c = row(lookups.missing(want, have_c, at), "CANON_CHAPTER_MISSING", none)
    more_c = row(have_c.join(want.select(*keys, "book").distinct(), [*keys, "book"], "left_semi").join(want.select(*at), at, "left_anti"), "CANON_CHAPTER_EXTRA", none)
    numbers = lookups.expected_numbers(want.join(have_c, at, "left_semi"), at, "max_verse", "verse")
    lost_v = row(lookups.missing(numbers, have_v, [*at, "verse"]), "CANON_VERSE_MISSING", F.col("verse"))
    more_v = row(have_v.join(want, at).where("verse > max_verse"), "CANON_VERSE_EXTRA", F.col("verse"))
    unknown = books.join(versification.select("book").distinct(), "book", "left_anti").select(*keys, "book", F.lit("NO_VERSIFICATION").alias("code"), none.alias("chapter"), none.alias("verse"))
    return lost_c.unionByName(more_c).unionByName(lost_v).unionByName(more_v).unionByName(unknown)


def shifted(verses: DataFrame, chapter: int, pattern: str, keys=("doc_id", "book")) -> DataFrame:
    """Verses with a remap: where verse 1 of a chapter matches a pattern and the chapter before ends one verse short,
    that verse goes to the end of the chapter before and the rest of the chapter moves down by one."""
    w = Window.partitionBy(*keys)
    here = F.col("chapter") == chapter
    moves = F.max((here & (F.col("verse") == 1) & F.col("text").rlike(pattern)).cast("int")).over(w) == 1
    last = F.max(F.when(F.col("chapter") == chapter - 1, F.col("verse"))).over(w)
    d = verses.withColumn("__m", F.coalesce(moves & last.isNotNull(), F.lit(False)) & here).withColumn("__l", last)
    goes = F.col("__m") & (F.col("verse") == 1)
    d = d.withColumn("chapter", F.when(goes, F.lit(chapter - 1)).otherwise(F.col("chapter")))
    return d.withColumn("verse", F.when(goes, F.col("__l") + 1).when(F.col("__m"), F.col("verse") - 1).otherwise(F.col("verse"))).drop("__m", "__l")


def file_order(path: Column) -> list[Column]:
    """Sort keys for chapter files: the first number in the name that touches no letter, none last; then the path."""
    name = F.element_at(F.split(path, "/"), -1)
    number = F.regexp_extract(name, r"(?<![\p{L}\d])(\d{1,3})(?!\p{L})", 1).try_cast("int")
    return [number.asc_nulls_last(), F.lower(path).asc(), path.asc()]


def source_of(paths: DataFrame, book: str) -> DataFrame:
    """paths(path) that hold a book's source: NN-BOOK.usfm or a name with _BOOK_ in it."""
    return paths.where(F.col("path").rlike(rf"(?i)(?:^|/)(?:[^/]*-{book}|[^/]*_{book}_[^/]*)\.usfm$"))


def book_of_file(path: Column, books: list[str]) -> Column:
    """The first listed book id that stands alone in a file's name."""
    name = F.upper(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(*[F.when(name.rlike(rf"(?<![A-Z0-9]){b}(?![A-Z0-9])"), F.lit(b)) for b in books])


def dominant_script(titles: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, script): the script with most letters in a document's first titles; ties go to Arabic, then Cyrillic."""
    d = sequences.first_per_key(titles, ["doc_id"], ["title_no"], most)
    n = lambda keep: F.sum(F.char_length(F.regexp_replace("title", f"[^{keep}]", "")))
    g = d.groupBy("doc_id").agg(n(P.ARABIC_NARROW).alias("a"), n(r"Ѐ-ӿ").alias("c"), n("A-Za-z").alias("l"))
    a, c, x = F.col("a"), F.col("c"), F.col("l")
    return g.select("doc_id", F.when((a > 0) & (a >= c) & (a >= x), "Arabic").when((c > 0) & (c >= x), "Cyrillic").when(x > 0, "Latin").alias("script"))
