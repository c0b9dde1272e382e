"""Tokenisers of the index fields, snippets and highlights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: token patterns of the index fields -----------------------
WORD_PATTERN = r"[\p{L}\p{N}_/*()=+|&']+(?:\.?[\p{L}\p{N}_/*()=+|&']+)*"
SECTION_PATTERN = r"[a-zA-Z0-9\- ]+"
STANDARD_PATTERN = r"[\p{L}\p{N}_]+(?:\.?[\p{L}\p{N}_]+)*"
SEGMENT_PATTERN = r"\s+|[\[\],.:;]|[^\s\[\],.:;]+"
PUNCTUATION = [";", ",", ".", "[", "]", ":"]
# Words the default analyser (author, work_id, section_id) leaves out.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have", "if", "in", "is", "it", "may",
    "not", "of", "on", "or", "tbd", "that", "the", "this", "to", "us", "we", "when", "will", "with", "yet", "you",
    "your",
]
# ----------------------------------------------------------------------------
# Letters, digits and underscore: the pattern Java and RE2 read alike.
PLAIN_WORD_PATTERN = r"[\p{L}\p{N}_]+"

FIELD_ANALYSERS = {
    "content": "word",
    "no_diacritics": "word",
    "work": "section",
    "section": "section",
    "author": "standard",
    "work_id": "standard",
    "section_id": "standard",
}


def _find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Words with the beta-code signs and inner dots."""
    return _find_all(text, WORD_PATTERN)


def plain_tokens(text: Column) -> Column:
    return _find_all(text, PLAIN_WORD_PATTERN)


def section_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits, hyphens and blanks (section names, work titles)."""
    return _find_all(text, SECTION_PATTERN)


def standard_tokens(text: Column) -> Column:
    """Words of two characters or more that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(
        _find_all(text, STANDARD_PATTERN), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)
    )


_ANALYSERS = {"word": word_tokens, "section": section_tokens, "standard": standard_tokens, "plain": plain_tokens}


def analyse(text: Column, field: str, word_analyser: str = "word") -> Column:
    """Tokens of ``text`` as the given index field sees it."""
    kind = FIELD_ANALYSERS[field]
    return _ANALYSERS[word_analyser if kind == "word" else kind](text)


def segments(text: Column) -> Column:
    """Text cut into words, punctuation marks and blanks; nothing is lost."""
    return F.regexp_extract_all(text, F.lit(SEGMENT_PATTERN), F.lit(0))


def is_word_segment(segment: Column) -> Column:
    return ~segment.isin(PUNCTUATION) & (F.trim(F.regexp_replace(segment, r"\s+", " ")) != "")


def snippet(text: Column, limit: int = 80) -> Column:
    """Text cut at the first blank at or after ``limit``; short texts stay whole."""
    head = F.regexp_extract(text, rf"(?s)^(.{{{limit}}}[^ ]*) ", 1)
    return F.when(head != "", head).otherwise(text)


def highlight_fragments(
    text: Column, terms: Column, surround: int = 5, open_mark: str = "<b>", close_mark: str = "</b>"
) -> Column:
    """Up to ``surround`` words on both sides of each matched term, terms marked, fragments joined by ``...``.

    ``terms`` is an array of lower-case terms; one pattern is made of them, so
    the text is scanned once per step inside the JVM.
    """
    alternatives = F.array_join(F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    term = F.concat(F.lit(r"(?<![\p{L}\p{N}_])("), alternatives, F.lit(r")(?![\p{L}\p{N}_])"))
    fragment = F.concat(
        F.lit(rf"(?iu)(?<!\S)(?:\S+\s+){{0,{surround}}}?\S*?"), term, F.lit(rf"\S*(?:\s+\S+){{0,{surround}}}")
    )
    found = F.regexp_extract_all(text, fragment, F.lit(0))
    marked = F.regexp_replace(
        F.array_join(found, "..."), F.concat(F.lit("(?iu)"), term), F.lit(f"{open_mark}$1{close_mark}")
    )
    return F.when(F.size(terms) > 0, marked).otherwise(F.lit(""))


def join_highlights(*fragments: Column) -> Column:
    """Fragments of several fields joined by ``...``, empty ones left out."""
    return F.concat_ws("...", *[F.when(F.length(f) > 0, f) for f in fragments])
