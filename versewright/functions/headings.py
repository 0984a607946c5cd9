"""Book titles, chapter headings and what stands before them: as columns, and for single strings in a sequential pass."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as T

# Words, patterns and limits by which headings are told.
CHAPTER_WORDS = ("Глава", "Chapter", "باب")
BOOK_WORDS = ("Книга", "КНИГА", "Book")
PROPHET_WORDS = ("Книга(?:\\s+пророка)?", "КНИГА(?:\\s+ПРОРОКА)?", "Book")
ORDINALS = ("ПЕРВАЯ", "ВТОРАЯ", "ТРЕТЬЯ", "ЧЕТВЕРТАЯ")
ROMAN = ("I", "II", "III", "IV")
PSALTER = ("ПСАЛТЫРЬ", "Псалтирь")
TRANSLATION_LABELS = ("سرائیکی\\s*ترجمہ", "اُردو\\s*ترجمہ", "اردو\\s*ترجمہ", "translation")
KNOWN_PARTS = ("سموئیل", "سمو", "samuel")
TITLE_STOPS = ".!?:;,\""
ALIAS_STOPS = ".!?:;,\"۔\\"
MOST_BOOKS, ALIAS_WORDS, ALIAS_CHARS, TITLE_WORDS = 4, 5, 40, 8
HEADING_CHARS = 140
_D = "[0-9٠-٩۰-۹]"
_ANY = "|".join
_LETTERS = r"[\p{L}\p{M}]"
_COUNT = rf"(?:(?:\d+|{_ANY(ORDINALS + ROMAN)})\s+)?"
_LATIN = r"\((?:\d+\s*)?[A-Za-z][^)]+\)"
CHAPTER = rf"(?iU)^(?:{_ANY(CHAPTER_WORDS)})\s*({_D}+)\b"
TITLE = rf"(?iU)^{_COUNT}(?:{_ANY(BOOK_WORDS)})\s+.+(?:{_LATIN})?\s*$"
TITLE_LATIN = rf"(?iU)^{_COUNT}(?:{_ANY(BOOK_WORDS)})\s+.+{_LATIN}\s*$"
STANDALONE = rf"(?U)^(?:\d+\s+[^()]{{1,120}}|{_ANY(PSALTER)})\s*{_LATIN}\s*$"
PLAIN = rf"(?iU)^(?:(?:\d+|{_ANY(ORDINALS + ('ЧЕТВЁРТАЯ',) + ROMAN)})\s+)?(?:{_ANY(PROPHET_WORDS)})\s+[\p{{L}}\p{{M}}\s\-]{{2,140}}$"
EQUIVALENT = r"(?iU)^(?:\d+\s+)?(?:Книга\s+)?[\p{L}\p{M}\s\-]{2,80}\s*=\s*(?:\d+\s*)?[A-Za-z][A-Za-z\s\-]{1,80}$"
NUMERIC = rf"(?iU)^(?:\d+|{_ANY(ROMAN)})\s*[.\-۔]?\s*(?:Книга\s+|Book\s+)?{_LETTERS}[\p{{L}}\p{{M}}\s\-]{{1,80}}$"
LABEL = rf"(?iU)^(?:{_ANY(TRANSLATION_LABELS)})$"
CREDIT = r"(?U)^[\p{L}\p{M}\s]{2,80}$"
VERSE_LEAD = rf"(?iU)^(?:\\v\s*)?({_D}{{1,3}})\b"


def words(text: Column) -> Column:
    """How many runs of letters and marks a text has."""
    return F.size(F.regexp_extract_all(text, F.lit(f"({_LETTERS}+)"), F.lit(1)))


def chapter_number(text: Column) -> Column:
    """The number of a chapter heading that a text begins with, in any digit script; null if it isn't one."""
    return T.script_number(F.regexp_extract(text, CHAPTER, 1))


def is_chapter(text: Column) -> Column:
    return text.rlike(CHAPTER)


def verse_like(text: Column) -> Column:
    """A leading number with a sentence behind it: seven words, or forty characters with a blank."""
    return F.coalesce(text.rlike(r"(?U)^\s*\d{1,3}(?:[.)])?\s+") & ((words(text) >= 7) | (text.contains(" ") & (F.char_length(text) > 40))), F.lit(False))


def numeric_title(text: Column, known: Column | None = None) -> Column:
    """A numbered title: 1 to 4 or a Roman numeral, then a few words; ``known`` is whether a book can be told from it,
    which a scan asks for and a conversion doesn't."""
    n = T.ascii_digits(text)
    low = F.coalesce(F.regexp_extract(F.ltrim(n), r"^(\d+)", 1).try_cast("int") <= MOST_BOOKS, F.lit(True))
    shape = n.rlike(NUMERIC) & ~text.rlike(f"[{TITLE_STOPS}]") & low
    return shape & ~is_chapter(text) if known is None else shape & ~verse_like(text) & (words(text) <= TITLE_WORDS) & known


def alias_only(text: Column, scan: bool = True) -> Column:
    """Up to five words and forty characters without punctuation: a heading, if an alias names it."""
    short = (F.char_length(F.trim(text)) <= ALIAS_CHARS) & ~text.rlike("[" + re.escape(ALIAS_STOPS).replace('"', '\\"') + "]")
    plain = short & ~is_chapter(text) & words(text).between(1, ALIAS_WORDS)
    return plain & ~verse_like(text) if scan else plain


def scanned_title(text: Column, known: Column) -> Column:
    """Whether a scan takes a text for a book's title; ``known``: a book can be told from it."""
    shape = text.rlike(TITLE) | text.rlike(STANDALONE) | text.rlike(EQUIVALENT) | numeric_title(text, known) | (alias_only(text) & known)
    return F.coalesce(~text.contains(",") & ~is_chapter(text) & shape, F.lit(False))


def converted_title(text: Column, known: Column) -> Column:
    """Whether a conversion takes a text for a book's title: here the Latin name in brackets must be there."""
    shape = text.rlike(TITLE_LATIN) | text.rlike(PLAIN) | text.rlike(STANDALONE) | text.rlike(EQUIVALENT) | (alias_only(text, False) & known)
    return F.coalesce(~text.contains(",") & ~is_chapter(text) & shape, F.lit(False))


def heading_boundary(text: Column, known: Column) -> Column:
    """A text that looks like a book's title, whether or not a book is known for it: where the book before ends."""
    return scanned_title(text, known) & ~verse_like(text)


def ignorable(text: Column, known: Column) -> Column:
    """A line before the first chapter that says nothing of the text: a label of the translation, or two to six words
    without punctuation that name no book."""
    key = T.alias_key(text)
    part = F.lit(False)
    for p in KNOWN_PARTS:
        part = part | key.contains(p)
    few = (F.char_length(key) > 1) & ~part & words(text).between(2, 6) & ~text.rlike("[,،.۔:;]")
    return F.coalesce(~is_chapter(text) & ~text.rlike(VERSE_LEAD) & (text.rlike(LABEL) | (~known & few)), F.lit(False))


def credit_line(text: Column) -> Column:
    """The conversion's variant: a label, or two to six words in the shape of a translator's credit."""
    few = text.rlike(CREDIT) & ~text.rlike("[،,.۔]") & T.script_number(text).isNull() & words(text).between(2, 6)
    return F.coalesce(text.rlike(LABEL) | few, F.lit(False))


def likely_book_heading(text: Column, prefixes: list[str], known: Column) -> Column:
    """A short line without a stop inside it that begins with one of a profile's prefixes or names a known book."""
    t = F.trim(text)
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.lower(t).startswith(p.lower())
    return F.coalesce((t != "") & (F.char_length(t) <= HEADING_CHARS) & ~t.rlike(r"[.!?۔؟]\s+\S") & (starts | known), F.lit(False))


def superscription(text: Column, phrases: list[str]) -> Column:
    """A psalm's heading: in square brackets, or with one of a profile's phrases in front."""
    t = F.lower(F.ltrim(text))
    out = t.startswith("[")
    for p in phrases:
        out = out | t.startswith(p.lower())
    return F.coalesce(out, F.lit(False))


def psalm_number(text: Column, word: str = "Псалом") -> Column:
    """The number behind a psalm's word; null without one."""
    return T.script_number(F.regexp_extract(text, rf"(?iU)^\s*{re.escape(word)}\s+({_D}+)\b", 1))


def heading_key(text: Column) -> Column:
    """What headings are compared by: one line, no direction marks and diacritics, lower case."""
    return F.lower(T.without_diacritics(T.one_line(T.BIDI.apply(F.replace(text, F.lit("\u00a0"), F.lit(" "))))))


def chapter_line(text: Column) -> Column:
    """A chapter heading as it is shown: spacing set right; digits are Persian where the script is Arabic."""
    c = T.paragraph_text(text)
    return F.when(T.has_arabic(c, wide=False), T.persian_digits(F.trim(c))).otherwise(F.trim(c))
