"""Word-processor paragraphs to marked-up lines by their shape.

What a paragraph is on its own (a title, a chapter heading, a number, verses run together) is columns. What it means
there depends on the paragraphs before it: that is a finite automaton over paragraphs (is there a title, an open chapter, an
open paragraph, a verse to go on with, a number that waits for its text, and did the verse end a phrase), run as a
prefix scan. Numbers and texts that a paragraph takes from earlier ones are carried forward. So one long document is
spread over many tasks like many short ones.
"""

from __future__ import annotations

import re
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewright.functions import headings as H
from versewright.functions import patterns as P
from versewright.functions import quotes as Q
from versewright.functions import text as T

from .ordered import all_carried, numbered, scanned
from .shared import stored

# Marker patterns, and what ends a phrase or opens a sentence.
_D = "[0-9٠-٩۰-۹]"
_DASHES = r"^(?:(?:[-–—]+\s*)*)"
_SLASH = r"(?:[vV]\s*/?|/\s*[vV])"
MARKER_ALONE = (rf"(?iU)^\\v\s*({_D}{{1,3}})\s*[\\.)۔:]?\s*$", rf"(?U){_DASHES}{_SLASH}\s*({_D}{{1,3}})\s*[-–—]?\s*$")
NUMBER_ALONE = rf"(?U)^({_D}{{1,3}})\s*[.)۔:]?\s*$"
MARKER_INLINE = (rf"(?iU)^\\v\s*({_D}{{1,3}})(?!{_D})\s*[\\.)۔:]?\s*(.+)$", rf"(?U){_DASHES}{_SLASH}\s*({_D}{{1,3}})\s*[-–—]?\s+(.+)$")
MARKER_INSIDE = rf"(?iU)\\v\s*(?![0٠۰]{{1,3}}(?!{_D}))({_D}{{1,3}})(?!{_D})\s*[\\.)۔:]?\s*"
VERSE = rf"(?U)^({_D}{{1,3}})(?:\s*[.)۔:]\s*|\s+)(.+)$"
VERSE_LOOSE = rf"(?U)^({_D}{{1,3}})(.+)$"
LEADING = r"""(?U)^[\s"'«“\[(]*(\d{1,3})\s*[.)]?\s*(\S.*)$"""
TITLE_CHAPTER = rf"(?iU)^(.+?)\s+({'|'.join(H.CHAPTER_WORDS)})\s*({_D}+)\s*$"
_HEAD = rf"(?:[\p{{L}}\p{{M}}]+\s+){{0,4}}(?:{'|'.join(H.CHAPTER_WORDS)})\s*({_D}+)"
EMBEDDED_CHAPTER = rf"(?iU)^(.+?)\s+({_HEAD})\s+((?:\\[vV]\s*{_D}|{_D}{{1,3}}\s*[.)۔:]).*)$"
INLINE_TITLE = rf"(?U)^(.*?[.!?])\s+((?:(?:\d+|{'|'.join(H.ORDINALS + H.ROMAN)})\s+)?(?:(?:{'|'.join(H.BOOK_WORDS)})\s+[^()]{{1,140}}|(?:\d+\s+[^()]{{1,120}}|{'|'.join(H.PSALTER)}))\((?:\d+\s*)?[A-Za-z][^)]+\))\s*(.*)$"
PHRASE_END, OPENERS = ".!?;:”»", "\"'«“[("
LONGEST_MARKER, LEAST_SENTENCE = 999, 8


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _number(c: Column) -> Column:
    return T.script_number(c)


def _first(text: Column, patterns, group: int = 1) -> Column:
    """A group of the first pattern that a text matches; null without one."""
    out = F.when(text.rlike(patterns[0]), F.regexp_extract(text, patterns[0], group))
    for p in patterns[1:]:
        out = out.when(text.rlike(p), F.regexp_extract(text, p, group))
    return out


def body_lead(text: Column) -> Column:
    """A verse's text without stops in front."""
    return F.regexp_replace(strip(text), r"(?U)^[.)۔:]+\s*", "")


def verse_lead(text: Column) -> Column:
    """An initial that was set twice counts once: a capital and its small letter, or a doubled pair before a blank."""
    t = F.regexp_replace(text, r"(?U)^\s+", "")
    a, b, c = (F.substring(t, i, 1) for i in (1, 2, 3))
    twice = t.rlike(r"(?s)^\p{L}\p{L}.") & (F.lower(a) == F.lower(b))
    out = F.when(twice & c.rlike(r"(?U)\s"), F.substring(t, F.lit(4), F.char_length(t))).when(twice & c.rlike(r"\p{L}"), F.concat(a, F.substring(t, F.lit(3), F.char_length(t)))).otherwise(t)
    return F.regexp_replace(out, r"(?U)^\s+", "")


def pending_text(text: Column, number: Column) -> Column:
    """The text behind a marker that stood alone: without that number, or without the last digit of it, in front."""
    whole, digit = rf"(?U)^\s*({_D}{{1,3}})\s*[.)۔:]?\s+(.+)$", rf"(?U)^\s*({_D})\s+(.+)$"
    same = text.rlike(whole) & (_number(F.regexp_extract(text, whole, 1)) == number)
    last = text.rlike(digit) & (number >= 10) & (_number(F.regexp_extract(text, digit, 1)) == number % 10)
    return F.when(same, strip(F.regexp_extract(text, whole, 2))).when(last, strip(F.regexp_extract(text, digit, 2))).otherwise(strip(text))


def explicit_verses(first: Column, text: Column) -> tuple[Column, Column]:
    """(array of (n, text) of verses parted by markers, the number of a marker that nothing follows). A marker with the
    number 0 is text."""
    n = F.transform(F.regexp_extract_all(text, F.lit(MARKER_INSIDE), F.lit(1)), _number)
    pieces = F.transform(F.split(text, MARKER_INSIDE), strip)
    every = F.zip_with(F.concat(F.array(first), n), pieces, lambda a, b: F.struct(a.alias("n"), b.alias("text")))
    return F.filter(every, lambda v: v["text"] != ""), F.when((F.size(n) > 0) & (F.element_at(pieces, -1) == ""), F.element_at(n, -1))


_VERSES = "array<struct<n:int,text:string>>"


def merged_verses(first: Column, text: Column) -> Column:
    """Verses run together, as quotes.split_verses parts them, with what only conversions meet: a last digit of the
    number that leaked in front or behind a marker, and a next number at a boundary that the first way missed."""

    @F.pandas_udf(_VERSES)
    def part(n: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"n": a, "text": b} for a, b in _merged(int(k), t)] for k, t in zip(n, s)], index=s.index, dtype=object)

    return part(F.coalesce(first, F.lit(0)), F.when(first.isNotNull(), text))


def _merged(first: int, text: str) -> list[tuple[int, str]]:
    tail = re.match(rf"^({_D})(?!{_D})\s*[.)۔:]?\s*", text)
    if first >= 10 and tail and 0 < int(tail[1]) == first % 10:
        text = text[tail.end() :]
    out: list[tuple[int, str]] = []
    for n, t in Q.split_verses(first, text):
        if out and n >= 10:  # the piece before ends in this number's last digit, with a boundary before it
            m = re.search(rf"(?:^|(?<=[{re.escape(P.VERSE_BOUNDARY)}]))\s*({_D})\s*$", out[-1][1])
            if m and 0 < int(m[1]) == n % 10:
                out[-1] = (out[-1][0], out[-1][1][: m.start()].rstrip())
        out.append((n, t))
    out = [x for x in out if x[1]] or [(first, text.strip())]
    if len(out) == 1:
        for m in re.finditer(str(first + 1), text):
            before = text[: m.start()]
            glued = before[-1:] and not before[-1].isspace()
            edge = before[-1:] in P.VERSE_BOUNDARY if glued else before.rstrip()[-1:] in ("", *P.VERSE_BOUNDARY)
            left, right = before.strip(), re.sub(r"^\s*[.)۔:]?\s*", "", text[m.end() :]).strip()
            if before and not before[-1].isdigit() and edge and left and right:
                return [(first, left), (first + 1, right)]
    return out


def shown(heading: Column) -> Column:
    """A chapter heading's line; digits are Persian where the script is Arabic."""
    t = strip(heading)
    return F.when(T.has_arabic(t, wide=False), T.persian_digits(t)).otherwise(F.regexp_replace(t, r"(?U)\s+", " "))


def heading_key(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), f"[{P.DIACRITICS}{P.BIDI}]", "")))


def alias_pattern(aliases: list[str]) -> str | None:
    """A pattern that a heading's key matches if it holds one of a profile's aliases."""
    keys = {"".join(c for c in a.translate(str.maketrans(P.ARABIC_DIGITS + P.PERSIAN_DIGITS, "0123456789" * 2)).lower() if c.isalnum()) for a in aliases}
    return "|".join(re.escape(k) for k in sorted(keys - {""}, key=lambda k: (-len(k), k))) or None


def _is_title(text: Column, pattern: str | None) -> Column:
    known = F.lit(False) if pattern is None else T.alias_key(T.ascii_digits(text)).rlike(pattern)
    return F.coalesce(H.converted_title(text, known), F.lit(False)) | F.coalesce(H.numeric_title(text), F.lit(False))


# ---- one paragraph, several parts: a title or a chapter heading that stands inside it

_PARTS = "array<struct<kind:string,n:int,text:string>>"


def _part(kind: str, text: Column, n: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if n is None else n).cast("int").alias("n"), text.alias("text"))


def _parted(text: Column, pattern: str | None) -> Column:
    """The parts of a text if it has a title or chapter heading inside it, else null."""
    group = lambda p, i: strip(F.regexp_extract(text, p, i))
    inside = text.rlike(INLINE_TITLE) & _converted(group(INLINE_TITLE, 2), pattern)
    both = text.rlike(TITLE_CHAPTER) & _is_title(group(TITLE_CHAPTER, 1), pattern) & _number(group(TITLE_CHAPTER, 3)).isNotNull()
    chapter = text.rlike(EMBEDDED_CHAPTER) & _number(group(EMBEDDED_CHAPTER, 3)).isNotNull() & ~_is_title(text, pattern)
    return (
        F.when(inside, F.array(_part("text", group(INLINE_TITLE, 1)), _part("mt", group(INLINE_TITLE, 2)), _part("text", group(INLINE_TITLE, 3))))
        .when(both, F.array(_part("mt", group(TITLE_CHAPTER, 1)), _part("c", F.concat_ws(" ", group(TITLE_CHAPTER, 2), group(TITLE_CHAPTER, 3)), _number(group(TITLE_CHAPTER, 3)))))
        .when(chapter, F.array(_part("text", group(EMBEDDED_CHAPTER, 1)), _part("c", group(EMBEDDED_CHAPTER, 2), _number(group(EMBEDDED_CHAPTER, 3))), _part("text", group(EMBEDDED_CHAPTER, 4))))
    )


def _converted(text: Column, pattern: str | None) -> Column:
    known = F.lit(False) if pattern is None else T.alias_key(T.ascii_digits(text)).rlike(pattern)
    return F.coalesce(H.converted_title(text, known), F.lit(False))


def parts(paragraphs: DataFrame, pattern: str | None) -> DataFrame:
    """(doc_id, para_no, part_no, listed, kind, n, text): paragraphs with what stands inside them set apart: kind is text, mt (a
    title) or c (a chapter heading). Repeated until nothing more stands inside a text."""
    t = F.col("x.text")  # cheap signs first: few texts have them, and the patterns try many places
    hint = (t.contains("(") & t.rlike(INLINE_TITLE)) | (t.rlike(f"(?iU){'|'.join(H.CHAPTER_WORDS)}") & (t.rlike(TITLE_CHAPTER) | t.rlike(EMBEDDED_CHAPTER)))
    d = paragraphs.select("doc_id", "para_no", "listed", F.array(F.lit(0)).alias("at"), _part("text", F.col("text")).alias("x"))
    done = None
    for _ in range(1_000_000):  # each round makes the texts of the next shorter
        d = stored(d.withColumn("p", F.when((F.col("x.kind") == "text") & hint, _parted(F.col("x.text"), pattern))), "parts")
        whole = d.where("p is null").select("doc_id", "para_no", "listed", "at", "x")
        done = whole if done is None else done.unionByName(whole)
        more = d.where("p is not null").select("doc_id", "para_no", "listed", "at", F.posexplode("p").alias("i", "x")).where("x.text <> ''")
        if more.isEmpty():
            break
        d = more.select("doc_id", "para_no", F.lit(False).alias("listed"), F.concat("at", F.array("i")).alias("at"), "x")
    return done.select("doc_id", "para_no", "listed", "at", "x.*")


# ---- what a part is on its own, and the automaton

_TITLE, _CHAPTER, _OPEN, _VERSE, _PENDING, _ENDED = (1 << i for i in range(6))
STATES = 64
KINDS = ("mt", "c", "fresh", "same", "chapter", "alone", "inline", "numbered", "numberless", "plain")
FACTS = ("ends", "some", "alone", "later_ends", "later_some", "later_alone", "starts", "listed", "credit", "chapter_word")
ACTIONS = ("none", "title", "chapter", "alone", "inline", "after", "numbered", "listed", "label", "guess", "append", "heading", "opening", "unmapped", "preface")
_OPENS, _NAMES = 16, 32


def step(state: int, symbol: int, keep: bool, named: bool) -> tuple[int, int]:
    """State after a part and what is done with it: ACTIONS, and 16 if a paragraph opens, 32 if the book's name is the title."""
    kind = KINDS[symbol % len(KINDS)]
    bits = symbol // len(KINDS)
    fact = {f: bits >> i & 1 for i, f in enumerate(FACTS)}
    act = lambda name, more=0: ACTIONS.index(name) + more
    verse = lambda ended: state & ~_ENDED | _OPEN | _VERSE | (_ENDED if ended else 0)
    if kind in ("mt", "fresh"):
        return (state | _TITLE) & ~(_CHAPTER | _OPEN | _VERSE), act("title")
    if kind == "c":
        return (state | _CHAPTER) & ~(_PENDING | _OPEN | _VERSE), act("chapter")
    if kind == "same" or (fact["credit"] and state & _TITLE and not state & _CHAPTER):
        return state, act("none")
    more = 0
    if not state & _TITLE:
        if not (named and fact["chapter_word"]):
            return state, act("preface")
        state, more = state | _TITLE, _NAMES
    if kind == "chapter":
        return (state | _CHAPTER) & ~(_PENDING | _OPEN | _VERSE), act("chapter", more)
    if kind == "alone":
        return state | _PENDING, act("alone", more)
    opens = more if state & _OPEN else more + _OPENS
    if kind == "inline" or state & _PENDING:
        own = "" if kind == "inline" else "later_"
        after = verse(fact[own + "ends"]) if fact[own + "some"] else state | _OPEN
        return (after | _PENDING if fact[own + "alone"] else after & ~_PENDING), act("inline" if kind == "inline" else "after", opens)
    if kind == "numbered":
        return verse(fact["ends"]), act("numbered", opens)
    if kind == "numberless":
        return state, act("none", more)
    if not keep and state & _CHAPTER and fact["listed"] and state & _VERSE:
        return verse(fact["ends"]), act("listed", opens)
    if not state & _CHAPTER:
        return state, act("label", more)
    if state & _VERSE:
        if keep and fact["starts"] and state & _ENDED:
            return verse(fact["ends"]), act("guess", opens)
        return state & ~_ENDED | (_ENDED if fact["ends"] else 0), act("append", more)
    if state & _OPEN:
        return state, act("unmapped", more)
    if keep:
        return (state | _OPEN) & ~_VERSE, act("heading", opens)
    return verse(fact["ends"]), act("opening", opens)


def _ends(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+$", "").rlike(f"[{re.escape(PHRASE_END)}]$"), F.lit(False))


def _last_ends(verses: Column) -> Column:
    return _ends(F.try_element_at(verses, F.lit(-1))["text"])


def _led(verses: Column) -> Column:
    return F.transform(verses, lambda v: F.struct(v["n"].alias("n"), body_lead(v["text"]).alias("text")))


def facts(d: DataFrame, pattern: str | None, keep: bool) -> DataFrame:
    """parts() with what each one is on its own: title, chapter, alone, inline and its verses, numbered and its verses."""
    t = F.col("text")
    plain = F.col("kind") == "text"
    inline = F.when(_number(_first(t, MARKER_INLINE)).isNotNull() & (strip(_first(t, MARKER_INLINE, 2)) != ""), _number(_first(t, MARKER_INLINE)))
    d = d.withColumns({
        "is_title": plain & _is_title(t, pattern), "chapter": F.when(plain, H.chapter_number(t)), "word": plain & H.is_chapter(t),
        "alone": F.when(plain, _number(_first(t, (*MARKER_ALONE, NUMBER_ALONE)))), "inline": F.when(plain, inline), "inline_text": strip(_first(t, MARKER_INLINE, 2)),
        "credit": plain & H.credit_line(t),
    })
    lead = t.rlike(LEADING) & _number(F.regexp_extract(t, LEADING, 1)).isNotNull()
    patterns = (VERSE, VERSE_LOOSE) if keep else (VERSE,)
    n, body = _number(_first(t, patterns)), _first(t, patterns, 2)
    if keep:
        n, body = F.when(lead, _number(F.regexp_extract(t, LEADING, 1))).otherwise(n), F.when(lead, F.regexp_extract(t, LEADING, 2)).otherwise(body)
    free = plain & ~F.col("is_title") & F.col("chapter").isNull() & F.col("alone").isNull() & F.col("inline").isNull()
    d = d.withColumns({"free": free, "led": free & body.isNotNull(), "number": F.when(free, n), "body": strip(body if keep else verse_lead(body))})
    v, alone = explicit_verses(F.col("inline"), F.col("inline_text"))
    d = d.withColumns({"verses": F.when(F.col("inline").isNotNull(), _led(v)).otherwise(_led(merged_verses(F.col("number"), F.col("body")))), "inline_alone": F.when(F.col("inline").isNotNull(), alone)})
    # the number that a part leaves waiting, if it is read as verses: that of a marker at its end
    last = F.when(t.rlike(r"(?i)\\v"), explicit_verses(F.lit(0), t)[1])
    return d.withColumn("waits", F.coalesce("alone", "inline_alone", F.when(F.col("free"), last)))


# ---- lines


def from_shape(paragraphs: DataFrame, aliases: list[str], keep: bool = False, book_title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines(doc_id, line_no, line), issues(doc_id, code, found)) of paragraphs(doc_id, para_no, text, is_numbered) by their
    shape; notes stand in line. aliases are the names by which a profile knows books; keep preserves numbers as they stand;
    book_title is the title of a document that begins with a chapter.

    Null and blank paragraphs say nothing; para_no must be unique in a document. A document of any length is spread over tasks.
    """
    pattern, order = alias_pattern(aliases), [F.col("para_no").asc(), F.col("at").asc()]
    d = paragraphs.select("doc_id", "para_no", F.coalesce("is_numbered", F.lit(False)).alias("listed"), strip(T.paragraph_text(F.coalesce("text", F.lit("")))).alias("text"))
    d = stored(d, "texts").where("text <> ''")  # else a text is worked out again wherever a pattern looks at it
    d = facts(parts(d, pattern), pattern, keep)
    titled = F.when((F.col("kind") == "mt") | F.col("is_title"), heading_key(F.col("text")))
    d = d.withColumns({"title_key": titled, "worded": F.when(F.col("word") & ~F.col("is_title"), F.lit(True))})
    d = stored(d, "facts")  # dealing out by ranges reads its input twice
    d = all_carried(d, [("waits", "pending", False), ("title_key", "title_before", False), ("worded", "word_before", False)], ["doc_id"], order)
    if book_title:
        d = d.withColumn("title_before", F.coalesce("title_before", F.when(F.col("word_before"), heading_key(F.lit(book_title)))))

    later, later_alone = explicit_verses(F.col("pending"), pending_text(F.col("text"), F.col("pending")))
    d = d.withColumns({"later": F.when(F.col("free") & F.col("pending").isNotNull(), _led(later)), "later_alone": F.when(F.col("free") & F.col("pending").isNotNull(), later_alone)})
    sentence = (F.char_length("text") >= LEAST_SENTENCE) & ~F.col("text").rlike(VERSE_LOOSE) & F.col("text").rlike(rf"^(?:\p{{L}}|[{re.escape(OPENERS)}])")
    kind = F.when(F.col("kind") == "mt", "mt").when(F.col("kind") == "c", "c").when(F.col("is_title"), F.when(F.col("title_key").eqNullSafe(F.col("title_before")), "same").otherwise("fresh"))
    kind = kind.when(F.col("chapter").isNotNull(), "chapter").when(F.col("alone").isNotNull(), "alone").when(F.col("inline").isNotNull(), "inline").when(F.col("number").isNotNull(), "numbered").when(F.col("led"), "numberless").otherwise("plain")
    bits = {
        "ends": F.when(F.col("verses").isNotNull(), _last_ends(F.col("verses"))).otherwise(_ends(F.col("text"))), "some": F.size("verses") > 0, "alone": F.col("inline_alone").isNotNull(),
        "later_ends": _last_ends(F.col("later")), "later_some": F.size("later") > 0, "later_alone": F.col("later_alone").isNotNull(), "starts": sentence, "listed": F.col("listed"), "credit": F.col("credit"), "chapter_word": F.col("word"),
    }
    number = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("what"))
    symbol = number + sum((F.when(F.coalesce(bits[f], F.lit(False)), len(KINDS) << i).otherwise(0) for i, f in enumerate(FACTS)), F.lit(0))
    d = d.withColumn("what", kind).withColumn("symbol", symbol.cast("int"))
    d = scanned(d, ["doc_id"], order, "symbol", partial(step, keep=keep, named=bool(book_title)), STATES, 0, "done")
    names = F.array(*[F.lit(a) for a in ACTIONS])
    d = d.select("doc_id", "para_no", "at", "n", "text", "chapter", "inline", "pending", "number", "verses", "later", F.get(names, F.col("done").bitwiseAND(15)).alias("does"), (F.col("done").bitwiseAND(_OPENS) > 0).alias("opens"), (F.col("done").bitwiseAND(_NAMES) > 0).alias("names"))
    return _lines(stored(d, "paragraphs"), keep, book_title)


def _line(kind: str, n: Column | None, text: Column | None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if n is None else n).cast("int").alias("n"), (F.lit("") if text is None else text).alias("text"))


def _lines(d: DataFrame, keep: bool, book_title: str | None) -> tuple[DataFrame, DataFrame]:
    """Lines and issues of parts with what is done with each."""
    does = F.col("does")
    verses = lambda c: F.transform(c, lambda v: _typed("v", v["n"], v["text"]))
    none = F.array().cast("array<struct<kind:string,n:int,text:string>>")
    made = (
        F.when(does == "title", F.array(_line("mt", None, F.col("text"))))
        .when(does == "chapter", F.array(_line("c", F.coalesce("n", "chapter"), None), _line("cl", None, shown(F.col("text")))))
        .when(does == "inline", F.concat(F.array(_line("e", F.col("inline"), None)), verses(F.col("verses")))).when(does == "after", F.concat(F.array(_line("e", F.col("pending"), None)), verses(F.col("later"))))
        .when(does == "numbered", verses(F.col("verses"))).when(does.isin("listed", "guess"), F.array(_line("g", None, F.col("text")))).when(does == "label", F.array(_line("cl", None, F.col("text"))))
        .when(does == "append", F.array(_line("+", None, F.col("text")))).when(does == "heading", F.array(_line("d", None, F.col("text")))).when(does == "opening", F.array(_line("v", F.lit(1), F.col("text")))).otherwise(none)
    )
    every = F.concat(F.when(F.col("names"), F.array(_line("mt", None, F.lit(book_title)))).otherwise(none), F.when(F.col("opens"), F.array(_line("p", None, None))).otherwise(none), made)
    x = d.select("doc_id", "para_no", "at", "does", F.posexplode(every).alias("sub", "x")).select("doc_id", F.struct("para_no", "at", "sub").alias("id"), "does", "x.*")
    owner, chain = F.when(F.col("kind").isin("v", "g"), F.col("id")), F.when(F.col("kind").isin("v", "mt", "c", "d"), F.struct("id", "n"))
    x = x.withColumns({"own": owner, "link": chain})
    x = all_carried(x, [("own", "owner", True), ("link", "chain", True)], ["doc_id"], [F.col("id").asc()])

    guesses = numbered(x.where("kind = 'g'").select("doc_id", "id", "chain", "does"), [F.col("id").asc()], ["doc_id", "chain"], "nth")
    guesses = guesses.select("doc_id", F.col("id").alias("owner"), "chain", "does", (F.col("chain.n") + F.col("nth")).cast("int").alias("guessed"))
    texts = x.where("kind in ('v', 'g', '+')").groupBy("doc_id", "owner").agg(F.max("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda r: r["text"]), " ").alias("text"))
    texts = texts.join(guesses.select("doc_id", "owner", "guessed"), ["doc_id", "owner"], "left").select("doc_id", F.col("owner").alias("id"), F.coalesce("n", "guessed").alias("n"), "text")
    if keep:  # a verse that was guessed has its number after all: its text belongs to the verse before it
        last = guesses.groupBy("doc_id", "chain").agg(F.max(F.struct("owner", "guessed")).alias("g")).where(F.col("g.guessed") <= LONGEST_MARKER)
        again = x.where("kind = 'e'").select("doc_id", "chain", "n").distinct()
        back = last.join(again, ["doc_id", "chain"]).where("n = g.guessed").select("doc_id", F.col("chain.id").alias("to"), F.col("g.owner").alias("id"))
        back = back.join(texts.select("doc_id", "id", F.col("text").alias("taken")), ["doc_id", "id"])
        texts = texts.join(back.select("doc_id", "id"), ["doc_id", "id"], "left_anti").join(back.select("doc_id", F.col("to").alias("id"), "taken"), ["doc_id", "id"], "left")
        whole = F.regexp_replace(F.concat_ws(" ", F.concat(F.lit("\\v "), F.col("n").cast("string"), F.lit(" "), F.col("text")), strip(F.col("taken"))), r"(?U)\s+$", "")
        texts = texts.select("doc_id", "id", F.when(F.col("taken").isNull(), F.concat(F.lit("\\v "), F.col("n").cast("string"), F.lit(" "), F.col("text"))).otherwise(whole).alias("line"))
    else:
        texts = texts.select("doc_id", "id", F.concat(F.lit("\\v "), F.col("n").cast("string"), F.lit(" "), F.col("text")).alias("line"))
    plain = F.when(F.col("kind") == "p", "\\p").when(F.col("kind") == "c", F.concat(F.lit("\\c "), F.col("n").cast("string"))).otherwise(F.concat(F.lit("\\"), "kind", F.lit(" "), "text"))
    lines = x.where("kind in ('mt', 'c', 'cl', 'p', 'd')").select("doc_id", "id", plain.alias("line")).unionByName(texts)
    lines = numbered(lines, [F.col("id").asc()], ["doc_id"], "line_no").select("doc_id", "line_no", "line")

    say = lambda rows, code, found: rows.select("doc_id", code.alias("code"), found.alias("found"))
    codes = F.array_compact(F.array(
        F.when(F.col("names"), F.struct(F.lit("BOOK_HEADING_INFERRED_FROM_SELECTION").alias("code"), F.lit(book_title).cast("string").alias("found"))),
        F.when(does == "unmapped", F.struct(F.lit("PARAGRAPH_UNMAPPED").alias("code"), F.col("text").alias("found"))), F.when(does == "opening", F.struct(F.lit("VERSE_INFERRED").alias("code"), F.col("text").alias("found"))),
        F.when((does == "numbered") & (F.size("verses") > 1), F.struct(F.lit("VERSE_SPLIT_RECOVERED").alias("code"), (F.size("verses") - 1).cast("string").alias("found"))),
    ))
    issues = d.select("doc_id", F.explode(codes).alias("x")).select("doc_id", "x.*")
    issues = issues.unionByName(say(guesses, F.when(F.col("does") == "listed", "VERSE_INFERRED_FROM_LIST_NUMBERING").otherwise("VERSE_INFERRED_FROM_PARAGRAPH_BOUNDARY"), F.col("guessed").cast("string")))
    before = d.where("does = 'preface'").groupBy("doc_id").agg(F.count("*").cast("string").alias("found"))
    return lines, issues.unionByName(before.select("doc_id", F.lit("PREFACE_IGNORED").alias("code"), "found"))


def _typed(kind: str, n: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), text.alias("text"))
