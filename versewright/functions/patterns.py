"""Patterns, character sets and limits that the text rules have in common."""

from __future__ import annotations

# Patterns, sets and limits that results depend on.
DIGITS = "[0-9۰-۹٠-٩]"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_WIDE = r"؀-ۿݐ-ݿࡰ-࢟ࢠ-ࣿﭐ-﷿ﹰ-﻿"
ARABIC_NARROW = r"؀-ۿ"
RTL = r"؀-ۿݐ-ݿ"
DIACRITICS = r"ً-ٰٟ"
BIDI = r"‎‏‪-‮⁦-⁩"
CONTROLS = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F"
ARABIC_LANGUAGES = ("ar", "ara", "ur", "urd", "fa", "fas", "per", "pes", "ps", "pus", "sd", "snd", "pnb", "skr", "ks", "kas", "bal", "bft", "haz", "ug", "uig", "ckb")
WORD = r"\p{L}\p{M}\p{N}"
STOPS = ",.;:!?،؛؟۔"
SENTENCE_ENDS = ".!?؟۔"
MARKS = "!?؟"
FULL_STOPS = ".۔"
DOUBLE_STOP = r"(?<!\.)\.\s*\.(?!\.)"
NUMBER_STOPS = ".)۔:"
ALEF = "ا"
CHAPTER_WORD = "باب"
BEFORE_OPENER = r"\r\n(\[{،,:;؛—–-"
AFTER_CLOSER = r"\r\n)\]}،,.:;؛!?؟۔—–-"
VERSE_BOUNDARY = ".۔!?؟:;)]\"'»”"
VISIBLE_BOUNDARY = ".۔!?؟:;؛)]}‘’\"'"
EMPTY_BODY = r"[\s‎‏‪-‮﻿۔.،,؛:!؟?()\[\]{}‘’\"'\-]+"
MOST_VERSES = 200
DOUBLE_OPEN, DOUBLE_CLOSE, SINGLE_OPEN, SINGLE_CLOSE = "“", "”", "’", "‘"
QUOTE_MARKS = DOUBLE_OPEN + DOUBLE_CLOSE + SINGLE_OPEN + SINGLE_CLOSE
DIFF_CELLS = 1_000_000
SMALL_FILE = 200
EXCERPT_BEFORE, EXCERPT_AFTER = 24, 32
CONSOLE_ISSUES = 80
GENERATOR_NAME, GENERATOR_BUILD = "ts-desktop", "1074"
