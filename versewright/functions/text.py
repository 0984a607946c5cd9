"""Text rules as Column expressions, and pipelines of them.

A rule is data: a name, a function from Column to Column, and what it is called in reports. A pipeline
applies rules in order and can keep the text behind each, so that changes can be audited stage by stage.
Patterns run in java.util.regex with (?dU): Unicode classes, and only \\n ends a line.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P


@dataclass(frozen=True)
class Rule:
    """``label`` is the audit's name of the stage, if it isn't the rule's name. A rule that runs in Python says so."""

    name: str
    apply: Callable[[Column], Column]
    label: str = ""
    python: bool = False


def swap(name: str, pattern: str, by: str, flags: str = "dU", label: str = "") -> Rule:
    """A rule that replaces each match."""
    return Rule(name, lambda c: F.regexp_replace(c, f"(?{flags})" + pattern, by), label)


def apply(rules, text: Column) -> Column:
    return reduce(lambda c, r: r.apply(c), rules, text)


def staged(df: DataFrame, rules, text_col: str = "text") -> DataFrame:
    """df with columns s0 (the text) to sn (behind the nth rule)."""
    out = df.withColumn("s0", F.col(text_col))
    for i, r in enumerate(rules, 1):
        c = r.apply(F.col(f"s{i - 1}"))
        # exploded: the optimizer puts no stage with Python in place of its name, nor a filter below it
        out = out.withColumn(f"s{i}", F.explode(F.array(c)) if r.python else c)
    return out


def between(name: str, left: str, what: str, right: str, by: str) -> Rule:
    """A rule for the place between two neighbours, patterns of what stands left and right: what is there becomes ``by``."""
    return swap(name, (f"(?<={left})" if left else "") + what + (f"(?={right})" if right else ""), by)


# ---- punctuation (P) and quotes (Q): rules by the neighbours of a place

_MARKER_STOPS = swap("verse_stop", rf"(\\v\s*{P.DIGITS}+)\s*[{P.FULL_STOPS}:]+\s*", "$1 ", "dUi")
SPACING = (
    _MARKER_STOPS,
    between("stop_after_mark", f"[{P.MARKS}]", f"[{P.FULL_STOPS}]", "", ""),
    swap("double_stop", P.DOUBLE_STOP, "."),
    between("space_before_stop", "", r"\s+", f"[{P.STOPS}]", ""),
    _MARKER_STOPS,
    between("space_in_open_bracket", r"\(", r"\s+", "", ""),
    between("space_in_close_bracket", "", r"\s+", r"\)", ""),
    between("space_before_bracket", f"[{P.WORD}{P.SENTENCE_ENDS}]", "", r"\(\S", " "),
    between("space_after_mark", f"[{P.MARKS}]", "", f"[{P.WORD}]", " "),
)


def quote_rules(opener: str, closer: str) -> tuple[Rule, ...]:
    """Spacing around quotes for a convention's double quotes; the single ones are ’ and ‘ in both."""
    opens, closes = f"[{opener}{P.SINGLE_OPEN}]", f"[{closer}{P.SINGLE_CLOSE}]"
    loose, pair = rf"[^\s{P.STOPS}]", P.SINGLE_OPEN + P.SINGLE_CLOSE  # what is neither space nor stop
    whole = {P.SINGLE_OPEN * 2: opener, P.SINGLE_CLOSE * 2: closer}
    return (
        swap("mixed_pair_opens", rf"(?<!{loose}){pair}(?=\s*{loose})", opener),
        swap("mixed_pair_closes", rf"(?<=\S)\s*{pair}(?!{loose})", closer),
        Rule("single_pairs", lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), whole.items(), c)),
        between("space_after_opener", opens, r"\s+", "", ""),
        between("space_before_closer", "", r"\s+", closes, ""),
        between("no_space_before_opener", f"[{P.WORD}{P.STOPS}]", "", rf"{opens}\S", " "),
        between("no_space_after_closer", closes, "", f"[{P.WORD}]", " "),
        between("mark_closer_stop", f"[{P.MARKS}]{closes}", f"[{P.FULL_STOPS}]", "", ""),
        swap("closer_stop", f"(?<=[{P.WORD}])({closes})[{P.FULL_STOPS}]", "۔$1"),
    )


QUOTES = quote_rules(P.DOUBLE_OPEN, P.DOUBLE_CLOSE)


def toggled(text: Column) -> Column:
    """Straight quotes turned into the Arabic convention's, open and close in turn over the whole line.

    An apostrophe between ASCII word characters stays.
    """
    turn = lambda c, at, odd, even: F.array_join(F.transform(F.split(c, at), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.when(i % 2 == 1, odd).otherwise(even), x))), "")
    return turn(turn(text, '"', "”", "“"), r"(?<![A-Za-z0-9_])'|'(?![A-Za-z0-9_])", "’", "‘")


ARABIC_QUOTES = (Rule("straight_quotes", toggled), *quote_rules(P.DOUBLE_CLOSE, P.DOUBLE_OPEN))
COMMON, ARABIC = SPACING + QUOTES, SPACING + ARABIC_QUOTES


def quoted(c: Column, arabic: bool) -> Column:
    """The rules for spacing around quotes; a text without quotes needs none of them."""
    marks, rules = (P.QUOTE_MARKS + "\"'", ARABIC_QUOTES) if arabic else (P.QUOTE_MARKS, QUOTES)
    return once(c, lambda t: F.when(t.rlike(f"[{marks}]"), apply(rules, t)).otherwise(t))


def punctuated(line: Column) -> Column:
    """Punctuation rules of one line, in the convention that its script asks for."""
    return once(apply(SPACING, line), lambda t: F.when(has_arabic(line), quoted(t, True)).otherwise(quoted(t, False)))


# ---- the cleaner's own stages (T)

BOM = swap("bom", r"^\uFEFF+", "", label="Unicode BOM removal")
CONTROLS = swap("controls", f"[{P.CONTROLS}]", "", label="Unsafe control removal")
BIDI = swap("bidi", f"[{P.BIDI}]", "", label="Bidi control removal")
JOINERS = swap("joiners", r"(\\v[ \t]*[0-9]+)(?:[ \t\r\n]*\u2060)+[ \t\r\n]*", "$1 ", "dUi", label="Verse-marker word-joiner residue removal")
CHAPTER_TITLE = swap("chapter_title", rf"^\s*({P.CHAPTER_WORD})\s*({P.DIGITS}+)\s*$", "$1 $2", label="Chapter title spacing")
INLINE_SPACES = (
    Rule("nbsp", lambda c: F.replace(c, F.lit("\u00a0"), F.lit(" "))),
    between("joined_stop", r"[\p{L}\p{M}][۔،]", "", r"\p{L}", " "),
    between("repeated_spaces", r"\S", r"[ \u00a0]{2,}", r"\S", " "),
)

_STOP_RUN = rf"[{P.NUMBER_STOPS}](?:[\s{P.NUMBER_STOPS}]*[{P.NUMBER_STOPS}])?"
_SEEN = rf"[0-9۰-۹٠-٩{P.ALEF}]+"
_LEAD = rf"(?dU)^\s*({_SEEN})\s*{_STOP_RUN}\s*(.*)$"
_CUT, _PART = "\u0001", "\u0002"  # controls that a cleaned text hasn't: they mark what a pattern found until it is read


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that stands in the plan once, however often f names it: chains of such stages don't grow."""
    return F.get(F.transform(F.array(c), f), 0)


def number_of(digits: Column) -> Column:
    """The number that digits of the three scripts stand for; null for anything else."""
    return ascii_digits(digits).try_cast("int")


def means(seen: Column, n: Column) -> Column:
    """Whether printed digits can mean a number: an alef may stand for a one, and then they may be reversed."""
    one = F.replace(seen, F.lit(P.ALEF), F.lit("1"))
    alef = seen.contains(P.ALEF) & ((number_of(one) == n) | (number_of(F.reverse(one)) == n))
    return F.coalesce(number_of(seen) == n, F.lit(False)) | F.coalesce(alef, F.lit(False))


def _read(c: Column, f: Callable[[Column], Column]) -> Column:
    """A text with what stands between marks replaced by f of it."""
    return F.array_join(F.transform(F.split(c, _CUT), lambda x, i: F.when(i % 2 == 1, f(x)).otherwise(x)), "")


def visible_markers(text: Column, zeros: bool = False) -> Column:
    """Reversed (12 v) and loose (v 12.) markers in their own form, numbers in ASCII digits, a blank before glued ones.

    Zeros printed in front of a number go, unless ``zeros`` keeps them."""
    for printed in (rf"/?({P.DIGITS}+)\s+v\s*[{P.NUMBER_STOPS}]*", rf"\bv\s+({P.DIGITS}+)\s*[{P.NUMBER_STOPS}]+"):
        for before, lead in ((r"(?<!\S)", ""), (rf"(?<=\S)(?<![\\A-Za-z])(?:(?<!{P.DIGITS})|(?<=[\\A-Za-z]{P.DIGITS}))", " ")):
            text = F.regexp_replace(text, f"(?dU){before}{printed}", rf"{lead}\\v {_CUT}$1{_CUT} ")
    return _read(text, ascii_digits if zeros else lambda x: F.regexp_replace(ascii_digits(x), "^0+(?=[0-9])", ""))


def duplicate_markers(text: Column) -> Column:
    """A number that is printed behind its own marker goes; numbers are compared by what they can mean."""
    found = F.regexp_replace(text, rf"(?dUi)(\\v\s*)(\d+)(\s+)({_SEEN})(\s*{_STOP_RUN}\s*)", _CUT + _PART.join(f"${i}" for i in range(1, 6)) + _CUT)

    def kept(x: Column) -> Column:
        return once(F.split(x, _PART), lambda p: F.when(means(F.get(p, 3), number_of(F.get(p, 1))), F.concat(F.get(p, 0), F.get(p, 1), F.lit(" "))).otherwise(F.array_join(p, "")))

    return _read(found, kept)


def without_own_number(body: Column, n: Column) -> Column:
    """A verse's body without its own number, if that stands printed in front with a stop."""
    return F.when(means(F.regexp_extract(body, _LEAD, 1), n), F.regexp_replace(F.regexp_extract(body, _LEAD, 2), r"(?U)^\s+", "")).otherwise(body)


VISIBLE_MARKERS = Rule("visible_markers", visible_markers, "Visible verse-marker normalization")
PRINTED_MARKERS = Rule("visible_markers", lambda c: visible_markers(c, zeros=True), VISIBLE_MARKERS.label)
DUPLICATE_MARKER = Rule("duplicate_marker", duplicate_markers, "Duplicate visible verse-marker removal")


def _in_python(f: Callable[[str], str], text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run(text)


def guarded(f: Callable[[str], str], needed: Column, text: Column) -> Column:
    """f over the texts that need it. A Python function in a condition runs over all rows; so others go as nulls."""
    return F.coalesce(_in_python(f, F.when(needed, text)), text)


def line_break(text: Column) -> Column:
    return F.when(text.contains("\r\n"), "\r\n").otherwise("\n")


def by_line(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A rule of single lines, made one of whole texts: line breaks stay as they are."""
    return lambda c: once(c, lambda t: F.call_function("array_join", F.transform(F.split(t, r"\r?\n"), f), line_break(t)))


def pending_markers(text: Column) -> Column:
    """A line whose line before ends in a verse marker loses that number, if it stands printed in front of it."""
    number = lambda line: number_of(F.regexp_extract(line, r"(?Ui)\\v\s*(\d+)\s*$", 1))
    lines = lambda ls: F.transform(ls, lambda x, i: without_own_number(x, F.when(i > 0, number(F.get(ls, i - 1)))))
    return once(text, lambda t: F.call_function("array_join", once(F.split(t, r"\r?\n"), lines), line_break(t)))


PENDING = Rule("pending_marker", pending_markers, "Duplicate visible verse-marker removal")
LINES = (
    Rule("chapter_titles", by_line(CHAPTER_TITLE.apply), CHAPTER_TITLE.label),
    PENDING,
    Rule("punctuation", by_line(punctuated), "Punctuation/spacing normalization"),
    Rule("inline_spaces", by_line(lambda c: apply(INLINE_SPACES, c)), "Punctuation/spacing normalization"),
)


def cleaner(language: Column | None = None, zeros: bool = False) -> tuple[Rule, ...]:
    """All stages of the cleaner in their order, for whole texts; language is a column with tags, if there is one.
    ``zeros`` keeps those in front of the numbers of visible markers.

    Each line takes the punctuation rules of its own script; quotes are then repaired over the whole text.
    """
    from . import quotes as Q

    tag = F.lit(None).cast("string") if language is None else language
    arabic = lambda c: arabic_quotes(c, tag)
    accents = () if language is None else (Rule("kalasha", lambda c: once(c, lambda t: F.when(is_kalasha(tag), kalasha(t)).otherwise(t)), "Kalasha accent normalization"),)
    return (
        BOM, CONTROLS, *accents, JOINERS, BIDI, PRINTED_MARKERS if zeros else VISIBLE_MARKERS, DUPLICATE_MARKER, *LINES,
        Rule("verse_lines", by_lines_split, "Anchored verse-line normalization", python=True),
        Rule("straight_quotes", lambda c: once(c, lambda t: Q.straight_converted(t, arabic(t))), "Straight quote conversion"),
        Rule("directional_quotes", lambda c: once(c, lambda t: Q.repaired(t, arabic(t))), "Directional quote repair"),
        Rule("unpaired_closers", lambda c: once(c, Q.closers_paired), "Unpaired quote closer repair"),
        Rule("quote_spacing", lambda c: once(c, lambda t: F.when(~t.rlike(f"[{P.QUOTE_MARKS}\"']"), t).when(arabic(t), quoted(t, True)).otherwise(quoted(t, False))), "Quote spacing"),
    )


def by_lines_split(text: Column) -> Column:
    """Verse lines with merged verses get a marker for each; only texts with such lines reach Python."""
    from . import quotes as Q

    return guarded(Q.split_lines, text.rlike(rf"(?im)^\s*\\v\s*[0-9]+\s.*{P.DIGITS}"), text)


def clean_text(df: DataFrame, text_col: str = "text", language_col: str | None = None, name: str = "cleaned", zeros: bool = False) -> DataFrame:
    """df with the cleaned text. A null text stays null; the stages are columns of one plan after another."""
    rules = cleaner(F.col(language_col) if language_col else None, zeros)
    return staged(df, rules, text_col).select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col(f"s{len(rules)}").alias(name))



def removed(before: Column, after: Column) -> Column:
    """Characters fewer behind a removal."""
    return (F.char_length(before) - F.char_length(after)).cast("long")


# ---- kalasha, titles, chunks (E)


def kalasha(text: Column) -> Column:
    """Typographic single quotes are accent marks there: spacing put around them before is undone, then backticks."""
    word = f"[{P.WORD}]"
    rules = (between("accent_before", word, r"\s+[’‘]", word, "`"), between("accent_after", word, r"‘\s+", word, "`"))
    return F.translate(apply(rules, text), "’‘", "``")


def chunk_rules(start: Column) -> tuple[Rule, ...]:
    """Literal chapter markers, bidi controls and printed verse numbers gone, spacing set right, ends trimmed."""
    return (
        swap("chapter_markers", r"(?<!\S)\\c\s+\d+\s*", "", label="Literal chapter marker removal"), BIDI,
        Rule("visible_numbers", lambda c: visible_numbers_removed(c, start), "Duplicate visible verse-marker removal"),
        Rule("chunk_punctuation", lambda c: F.regexp_replace(once(c, punctuated), r"(?U)^\s+|\s+$", ""), "Chunk punctuation/spacing normalization"),
    )


def without_leading_marker(text: Column, start: Column) -> Column:
    """A first verse marker that isn't the chunk's start goes if another follows."""
    lead = r"(?dUi)^\s*\\v\s*(\d+)\s+(?=\\v\s*\d+\b)"
    cut = lambda t: F.when(F.regexp_extract(t, lead, 1).try_cast("int") != start, F.regexp_replace(F.regexp_replace(t, lead, ""), r"(?U)^\s+", "")).otherwise(t)
    return once(text, cut)


def visible_numbers_removed(text: Column, start: Column | None = None) -> Column:
    """Printed verse numbers of up to three digits go: at the start, and where a stop, a bracket or a quote stands
    before them, spaces aside. A first number that means the chunk's start goes too, if a stop follows it."""
    edge = P.VISIBLE_BOUNDARY.replace("]", r"\]")
    token = rf"(?dU)(?<=(?:\A|[{edge}])\s{{0,99}})(?<![{P.WORD}]){P.DIGITS}{{1,3}}\s*{_STOP_RUN}\s*"
    body = text if start is None else once(text, lambda t: without_own_number(t, start.cast("int")))
    return F.regexp_replace(body, token, "")


def chapter_title(text: Column, front: Column) -> Column:
    """Lone \\p lines and a leading number go, but not in a front title."""
    c = F.regexp_replace(F.regexp_replace(text, r"(?dUim)^[ \t]*\\p[ \t]*(?:\r?\n|$)", ""), r"(?U)\s+$", "")
    lead = rf"(?dU)^\s*[0-9۰-۹٠-٩{P.ALEF}]+\s*{_STOP_RUN}\s*(?=.*$)"
    return F.when(front, text).otherwise(F.regexp_replace(c, lead, ""))


def words_replaced(text: Column, mapping: dict[str, str]) -> Column:
    """Whole words put for others; letters, marks, digits, connectors and joiners don't bound a word."""
    edge = r"[\p{L}\p{M}\p{N}\p{Pc}\u200c\u200d]"
    swaps = [(rf"(?dU)(?<!{edge})\Q{old}\E(?!{edge})", new.replace("\\", r"\\").replace("$", r"\$")) for old, new in mapping.items()]
    return reduce(lambda c, x: F.regexp_replace(c, *x), swaps, text)


# ---- predicates (F)


def has_arabic(text: Column, wide: bool = True) -> Column:
    return text.rlike(f"[{P.ARABIC_WIDE if wide else P.ARABIC_NARROW}]")


def is_rtl(text: Column) -> Column:
    return text.rlike(f"[{P.RTL}]")


def has_arabic_letter(text: Column) -> Column:
    return text.rlike(rf"[\p{{L}}&&[{P.ARABIC_WIDE}]]")


def subtags(language: Column) -> Column:
    """The parts of a language tag in lower case, empty ones left out; none for a null."""
    return F.filter(F.split(F.lower(F.trim(F.coalesce(language, F.lit("")))), "[-_]"), lambda p: p != "")


def arabic_quotes(text: Column, language: Column) -> Column:
    """Whether a text takes the Arabic quote convention: by its letters; without any by the script of its language tag,
    then by the language."""
    parts = subtags(language)
    other = F.exists(F.slice(parts, 2, 100), lambda p: F.char_length(p) == 4)
    by_tag = F.when(F.array_contains(parts, "arab"), True).when(F.coalesce(other, F.lit(False)), False).otherwise(F.get(parts, 0).isin(*P.ARABIC_LANGUAGES))
    return F.when(has_arabic_letter(text), True).when(text.rlike(r"\p{L}"), False).otherwise(F.coalesce(by_tag, F.lit(False)))


def is_kalasha(language: Column) -> Column:
    return F.coalesce(F.get(subtags(language), 0) == "kls", F.lit(False))


def empty_body(text: Column) -> Column:
    """Whether nothing is left of a chunk without its verse markers and its punctuation."""
    c = F.regexp_replace(text, r"(?dUi)(?<!\S)\\v\s*\d+\s*", "")
    return F.regexp_replace(c, f"(?U){P.EMPTY_BODY}", "") == ""


def complete_quotes(text: Column) -> Column:
    """An even number, two or more, of straight double quotes, or of straight single ones."""
    n = lambda q: F.char_length(text) - F.char_length(F.replace(text, F.lit(q), F.lit("")))
    return ((n('"') >= 2) & (n('"') % 2 == 0)) | ((n("'") >= 2) & (n("'") % 2 == 0))


def likely_verse_text(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return text.rlike(rf"^\s*{P.DIGITS}") & ((words >= 7) | ((F.char_length(text) > 40) & text.contains(" ")))


def residues(text: Column) -> Column:
    """Codes of what cleaning must not leave behind."""
    kinds = {"BOM": r"\uFEFF", "CONTROL": f"[{P.CONTROLS}]", "BIDI": f"[{P.BIDI}]", "WORD_JOINER": r"(?i)\\v[ \t]*[0-9]+[ \t\r\n]*\u2060"}
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in kinds.items()]))


# ---- numbers, aliases, formatting (X)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, P.ARABIC_DIGITS + P.PERSIAN_DIGITS, "0123456789" * 2)


def persian_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", P.PERSIAN_DIGITS)


def script_number(text: Column, least: int = 1) -> Column:
    """The number in any of the three digit scripts; null if there is none or it is below ``least``."""
    n = F.when(ascii_digits(F.trim(text)).rlike("^[0-9]+$"), ascii_digits(F.trim(text)).try_cast("int"))
    return F.when(n >= least, n)


def alias_key(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def paragraph_text(text: Column) -> Column:
    """A paragraph's text: direction marks gone; punctuation set right where the script is Arabic, else spaces collapsed."""
    c = BIDI.apply(F.replace(text, F.lit("\u00a0"), F.lit(" ")))
    return F.when(has_arabic(c, wide=False), apply(ARABIC, c)).otherwise(F.regexp_replace(c, r"(?U)\s+", " "))


def scan_text(text: Column) -> Column:
    """A scan's variant: every run of white space and no-break spaces is one blank, ends trimmed."""
    return F.trim(F.regexp_replace(BIDI.apply(text), r"(?U)[\s\u00a0]+", " "))


def alias_key_wide(text: Column) -> Column:
    """alias_key over the compatibility form of a text, in which ligatures and full-width letters are plain ones."""
    return alias_key(guarded(lambda t: unicodedata.normalize("NFKC", t), text.rlike(r"[^\x00-\x7F]"), text))


def without_diacritics(text: Column) -> Column:
    return F.regexp_replace(text, f"[{P.DIACRITICS}]", "")


def comparable(text: Column) -> Column:
    """Without space, punctuation, symbols and backslashes."""
    return F.regexp_replace(text, r"[\s\p{P}\p{S}\\]+", "")


def file_stem(text: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{Nd}]+", "_"), "^_+|_+$", ""), 1, most)


def identifier(text: Column, default: str = "reg") -> Column:
    """Letters and digits in lower case, all else an underscore, none at the ends; the default if nothing is left."""
    c = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{Nd}]", "_"), "^_+|_+$", "")
    return F.when(c == "", default).otherwise(c)


def two_digits(n: Column) -> Column:
    return F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def verse_numbers(text: Column) -> Column:
    """All verse numbers of a text, in any digit script."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\\v\s*({P.DIGITS}+)"), F.lit(1)), lambda n: ascii_digits(n).try_cast("int"))


def excerpt(text: Column, at: Column, n: Column) -> Column:
    return F.substring(text, F.greatest(F.lit(1), at + 1 - P.EXCERPT_BEFORE), n + P.EXCERPT_AFTER + F.least(at, F.lit(P.EXCERPT_BEFORE)))


def plain_text(html: Column) -> Column:
    """Text of markup: scripts, styles and tags gone, the five basic entities decoded, white space collapsed."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(by))
    return one_line(c)
