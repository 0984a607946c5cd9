"""The conversion as one pass from paragraph to paragraph: what the columns and the automaton are held against."""

from __future__ import annotations

from collections.abc import Callable

import regex as re

from versewright.functions import headings as H
from versewright.functions import patterns as P
from versewright.functions import quotes as Q


def _java(pattern: str) -> re.Pattern:
    """A pattern without Java's flags."""
    flags = re.I if pattern.startswith("(?i") else 0
    body = re.sub(r"^\(\?i?U\)", "", pattern)
    return re.compile(body, flags)


_PY_LETTER = r"[\p{L}\p{M}]"
_CHAPTER, _TITLE, _PLAIN, _STANDALONE, _EQUIVALENT, _NUMERIC, _LABEL, _CREDIT = (_java(p) for p in (H.CHAPTER, H.TITLE_LATIN, H.PLAIN, H.STANDALONE, H.EQUIVALENT, H.NUMERIC, H.LABEL, H.CREDIT))
_TO_ASCII = str.maketrans(P.ARABIC_DIGITS + P.PERSIAN_DIGITS, "0123456789" * 2)
_TO_PERSIAN = str.maketrans("0123456789", P.PERSIAN_DIGITS)


def number(raw: str) -> int | None:
    """A positive number in any of the digit scripts."""
    t = raw.strip().translate(_TO_ASCII)
    return int(t) if re.fullmatch("[0-9]{1,9}", t) and int(t) > 0 else None


def word_count(text: str) -> int:
    return len(re.findall(f"{_PY_LETTER}+", text))


def py_title(text: str, known) -> bool:
    """converted_title for a string; known(text) tells whether an alias names a book in it."""
    if "," in text or _CHAPTER.match(text):
        return False
    alias = not any(c in H.ALIAS_STOPS for c in text) and 1 <= word_count(text) <= H.ALIAS_WORDS and len(text.strip()) <= H.ALIAS_CHARS
    return any(p.match(text) for p in (_TITLE, _PLAIN, _STANDALONE, _EQUIVALENT)) or (alias and known(text))


def py_numeric_title(text: str) -> bool:
    t = text.translate(_TO_ASCII)
    first = re.match(r"\s*(\d+)", t)
    return bool(_NUMERIC.match(t)) and not _CHAPTER.match(text) and not any(c in H.TITLE_STOPS for c in text) and not (first and int(first[1]) > H.MOST_BOOKS)


def py_credit(text: str) -> bool:
    if _LABEL.match(text):
        return True
    return number(text) is None and 2 <= word_count(text) <= 6 and not any(c in text for c in "،,.۔") and bool(_CREDIT.match(text))


def py_chapter(text: str) -> int | None:
    m = _CHAPTER.match(text)
    return number(m[1]) if m else None


_D = "[0-9٠-٩۰-۹]"
_DASHES = r"^(?:(?:[-–—]+\s*)*)"
_SLASH = r"(?:[vV]\s*/?|/\s*[vV])"
MARKER_ALONE = (re.compile(rf"^\\v\s*({_D}{{1,3}})\s*[\\.)۔:]?\s*$", re.I), re.compile(rf"{_DASHES}{_SLASH}\s*({_D}{{1,3}})\s*[-–—]?\s*$"))
NUMBER_ALONE = re.compile(rf"^({_D}{{1,3}})\s*[.)۔:]?\s*$")
MARKER_INLINE = (re.compile(rf"^\\v\s*({_D}{{1,3}})(?!{_D})\s*[\\.)۔:]?\s*(.+)$", re.I), re.compile(rf"{_DASHES}{_SLASH}\s*({_D}{{1,3}})\s*[-–—]?\s+(.+)$"))
MARKER_INSIDE = re.compile(rf"\\v\s*({_D}{{1,3}})(?!{_D})\s*[\\.)۔:]?\s*", re.I)
VERSE = re.compile(rf"^({_D}{{1,3}})(?:\s*[.)۔:]\s*|\s+)(.+)$")
VERSE_LOOSE = re.compile(rf"^({_D}{{1,3}})(.+)$")
LEADING = re.compile(r"""^[\s"'«“\[(]*(\d{1,3})\s*[.)]?\s*(\S.*)$""")
TITLE_CHAPTER = re.compile(rf"^(.+?)\s+({'|'.join(H.CHAPTER_WORDS)})\s*({_D}+)\s*$", re.I)
_HEAD = rf"(?:{_PY_LETTER}+\s+){{0,4}}(?:{'|'.join(H.CHAPTER_WORDS)})\s*(?P<n>{_D}+)"
EMBEDDED_CHAPTER = re.compile(rf"^(?P<before>.+?)\s+(?P<head>{_HEAD})\s+(?P<after>(?:\\[vV]\s*{_D}|{_D}{{1,3}}\s*[.)۔:]).*)$", re.I)
INLINE_TITLE = re.compile(rf"^(?P<before>.*?[.!?])\s+(?P<title>(?:(?:\d+|{'|'.join(H.ORDINALS + H.ROMAN)})\s+)?(?:(?:{'|'.join(H.BOOK_WORDS)})\s+[^()]{{1,140}}|(?:\d+\s+[^()]{{1,120}}|{'|'.join(H.PSALTER)}))\((?:\d+\s*)?[A-Za-z][^)]+\))\s*(?P<after>.*)$")
PHRASE_END = ".!?;:”»"
OPENERS = "\"'«“[("


def body_lead(text: str) -> str:
    """A verse's text without stops in front."""
    return re.sub(r"^[.)۔:]+\s*", "", text.strip())


def verse_lead(text: str) -> str:
    """An initial that was set twice counts once: a capital and its small letter, or a doubled pair before a blank."""
    t = text.lstrip()
    if len(t) > 2 and t[0].isalpha() and t[1].isalpha() and t[0].lower() == t[1].lower():
        t = t[3:] if t[2].isspace() else t[0] + t[2:] if t[2].isalpha() else t
    return t.lstrip()


def pending_text(text: str, n: int) -> str:
    """The text behind a marker that stood alone: without that number, or without the last digit of it, in front."""
    m = re.match(rf"^\s*({_D}{{1,3}})\s*[.)۔:]?\s+(.+)$", text)
    if m and number(m[1]) == n:
        return m[2].strip()
    m = re.match(rf"^\s*({_D})\s+(.+)$", text)
    if m and n >= 10 and number(m[1]) == n % 10:
        return m[2].strip()
    return text.strip()


def explicit_verses(first: int, text: str) -> tuple[list[tuple[int, str]], int | None]:
    """(number, text) of verses parted by markers, and the number of a marker that nothing follows."""
    out, at, now, any_ = [], 0, first, False
    for m in MARKER_INSIDE.finditer(text):
        if (n := number(m[1])) is None:
            continue
        if piece := text[at : m.start()].strip():
            out.append((now, piece))
        now, at, any_ = n, m.end(), True
    if tail := text[at:].strip():
        out.append((now, tail))
    alone = now if any_ and not tail else None
    return (out or ([] if alone else [(first, text.strip())])), alone


def merged_verses(first: int, text: str) -> list[tuple[int, str]]:
    """Verses run together, as quotes.split_verses parts them, with what only conversions meet: a last digit of the
    number that leaked in front or behind a marker, and a next number at a boundary that the first way missed."""
    tail = re.match(rf"^({_D})(?!{_D})\s*[.)۔:]?\s*", text)
    if first >= 10 and tail and number(tail[1]) == first % 10:
        text = text[tail.end() :]
    out: list[tuple[int, str]] = []
    for n, t in Q.split_verses(first, text):
        if out and n >= 10:  # the piece before ends in this number's last digit, with a boundary before it
            m = re.search(rf"(?:^|(?<=[{re.escape(P.VERSE_BOUNDARY)}]))\s*({_D})\s*$", out[-1][1])
            if m and number(m[1]) == n % 10:
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


class Converter:
    """Lines of one document from its paragraphs in order. What a paragraph is, is asked of the readers one after
    another; the first that knows it makes its lines. ``keep`` preserves the numbers as they stand in the document."""

    def __init__(self, known: Callable[[str], bool], keep: bool = False, book: str | None = None):
        self.known, self.keep, self.book = known, keep, book
        self.lines: list[str] = []
        self.issues: list[tuple[str, str]] = []
        self.title: str | None = None
        self.chapter = self.open = False
        self.pending: int | None = None
        self.preface = 0
        self._new_chapter()
        self.readers = (self._inline_title, self._title_chapter, self._title_alone, self._credit, self._embedded_chapter, self._preface, self._chapter_heading, self._marker_alone, self._marked, self._after_marker, self._numbered, self._listed, self._label, self._more_text, self._opening)

    def read(self, text: str, listed: bool = False) -> None:
        if text.strip() and not any(r(text, listed) for r in self.readers):
            self.issues.append(("PARAGRAPH_UNMAPPED", text))

    # what lines mean for those that follow

    def _new_chapter(self, keep_pending: bool = False) -> None:
        self.open = False
        self.at = self.explicit_at = -1  # lines of the last verse, and of the last one with a number of its own
        self.verse, self.guessed = 0, False

    def _titled(self, title: str) -> None:
        self.title, self.chapter = title, False
        self._new_chapter()
        self.lines.append(f"\\mt {title}")

    def _chaptered(self, n: int, heading: str) -> None:
        self.chapter, self.pending = True, None
        self._new_chapter()
        self.lines += [f"\\c {n}", f"\\cl {shown(heading)}"]

    def _paragraph(self) -> None:
        if not self.open:
            self.lines.append("\\p")
            self.open = True

    def _verses(self, verses, cleaned: bool = True) -> None:
        self._paragraph()
        for n, t in verses:
            self.lines.append(f"\\v {n} {body_lead(t) if cleaned else t}")
            self.at = self.explicit_at = len(self.lines) - 1
            self.verse, self.guessed = n, False

    def _guess(self, text: str, code: str, boundary: bool) -> None:
        self._paragraph()
        self.verse += 1
        self.lines.append(f"\\v {self.verse} {text}")
        self.at = len(self.lines) - 1
        self.guessed = boundary or self.guessed
        self.issues.append((code, str(self.verse)))

    def _take_back(self, n: int) -> None:
        """A verse that was guessed has its number after all: its text belongs to the verse before it."""
        if self.guessed and 0 <= self.explicit_at < self.at and n == self.verse:
            m = re.match(rf"^\\v\s*{_D}{{1,3}}\s*[\\.)۔:]?\s+(.*)$", self.lines[self.at], re.I)
            if m:
                self.lines[self.explicit_at] = f"{self.lines[self.explicit_at]} {m[1].strip()}".rstrip()
                del self.lines[self.at]
                self.at, self.verse, self.guessed = self.explicit_at, n - 1, False

    # what a paragraph can be

    def _inline_title(self, text: str, _) -> bool:
        m = INLINE_TITLE.match(text)
        if not m or not py_title(m["title"].strip(), self.known):
            return False
        self.read(m["before"].strip())
        self._titled(m["title"].strip())
        self.read(m["after"].strip())
        return True

    def _title_chapter(self, text: str, _) -> bool:
        m = TITLE_CHAPTER.match(text)
        if not m or not self._is_title(m[1].strip()) or (n := number(m[3])) is None:
            return False
        self._titled(m[1].strip())
        self._chaptered(n, f"{m[2].strip()} {m[3].strip()}")
        return True

    def _is_title(self, text: str) -> bool:
        return py_title(text, self.known) or py_numeric_title(text)

    def _title_alone(self, text: str, _) -> bool:
        if not self._is_title(text):
            return False
        if self.title is None or heading_key(text) != heading_key(self.title):
            self._titled(text)
        return True

    def _credit(self, text: str, _) -> bool:
        return self.title is not None and not self.chapter and py_credit(text)

    def _embedded_chapter(self, text: str, _) -> bool:
        m = EMBEDDED_CHAPTER.match(text)
        if not m or (n := number(m["n"])) is None or not (m["before"].strip() and m["after"].strip()):
            return False
        self.read(m["before"].strip())
        self._chaptered(n, m["head"].strip())
        self.read(m["after"].strip())
        return True

    def _preface(self, text: str, _) -> bool:
        if self.title is None and self.book and _CHAPTER.match(text):
            self.title = self.book
            self.lines.append(f"\\mt {self.book}")
            self.issues.append(("BOOK_HEADING_INFERRED_FROM_SELECTION", self.book))
        self.preface += self.title is None
        return self.title is None

    def _chapter_heading(self, text: str, _) -> bool:
        if (n := py_chapter(text)) is None:
            return False
        self._chaptered(n, text)
        return True

    def _marker_alone(self, text: str, _) -> bool:
        m = next((m for p in (*MARKER_ALONE, NUMBER_ALONE) if (m := p.match(text))), None)
        n = number(m[1]) if m else None
        self.pending = n if n is not None else self.pending
        return n is not None

    def _marked(self, text: str, _) -> bool:
        m = next((m for p in MARKER_INLINE if (m := p.match(text))), None)
        if not m or (n := number(m[1])) is None or not m[2].strip():
            return False
        self._explicit(n, m[2].strip())
        return True

    def _after_marker(self, text: str, _) -> bool:
        if self.pending is None:
            return False
        self._explicit(self.pending, pending_text(text, self.pending))
        return True

    def _explicit(self, n: int, text: str) -> None:
        self._take_back(n)
        verses, self.pending = explicit_verses(n, text)
        self._verses(verses)

    def _numbered(self, text: str, _) -> bool:
        m = LEADING.match(text) if self.keep else None
        m = m if m and number(m[1]) else VERSE.match(text) or (VERSE_LOOSE.match(text) if self.keep else None)
        if not m:
            return False
        if (n := number(m[1])) is not None:
            verses = merged_verses(n, m[2].strip() if self.keep else verse_lead(m[2]).strip())
            self._verses(verses)
            if len(verses) > 1:
                self.issues.append(("VERSE_SPLIT_RECOVERED", str(len(verses) - 1)))
        return True

    def _listed(self, text: str, listed: bool) -> bool:
        if self.keep or not (self.chapter and listed and self.verse > 0):
            return False
        self._guess(text, "VERSE_INFERRED_FROM_LIST_NUMBERING", False)
        return True

    def _label(self, text: str, _) -> bool:
        if not self.chapter:
            self.lines.append(f"\\cl {text}")
        return not self.chapter

    def _more_text(self, text: str, _) -> bool:
        if self.at < 0:
            return False
        if self.keep and self._begins_verse(text):
            self._guess(text, "VERSE_INFERRED_FROM_PARAGRAPH_BOUNDARY", True)
        else:
            self.lines[self.at] += f" {text}"
        return True

    def _begins_verse(self, text: str) -> bool:
        t, before = text.lstrip(), self.lines[self.at].rstrip()
        starts = len(t) >= 8 and not VERSE_LOOSE.match(t) and (t[0].isalpha() or t[0] in OPENERS)
        return self.verse > 0 and starts and before[-1:] in tuple(PHRASE_END)

    def _opening(self, text: str, _) -> bool:
        if self.open:
            return False
        if self.keep:
            self._paragraph()
            self.lines.append(f"\\d {text}")
            self.at = self.explicit_at = -1
            self.verse, self.guessed = 0, False
        else:
            self._verses([(1, text)], cleaned=False)
            self.issues.append(("VERSE_INFERRED", text))
        return True


def shown(heading: str) -> str:
    """A chapter heading's line; digits are Persian where the script is Arabic."""
    t = heading.strip()
    return t.translate(_TO_PERSIAN) if re.search(f"[{P.ARABIC_NARROW}]", t) else re.sub(r"\s+", " ", t)


def heading_key(text: str) -> str:
    return re.sub(f"[{P.DIACRITICS}{P.BIDI}]", "", re.sub(r"\s+", " ", text)).strip().lower()



def key(text: str) -> str:
    return "".join(c for c in text.translate(_TO_ASCII).lower() if c.isalnum())


def convert(paragraphs: list[tuple[str, bool]], aliases: list[str], keep: bool = False, book_title: str | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """(lines, issues) of one document's paragraphs (text, is_numbered)."""
    keys = [k for a in aliases if (k := key(a))]
    c = Converter(lambda text: any(k in key(text) for k in keys), keep, book_title)
    for t, listed in paragraphs:
        c.read((t or "").strip(), listed)
    if c.preface:
        c.issues.append(("PREFACE_IGNORED", str(c.preface)))
    return c.lines, c.issues
