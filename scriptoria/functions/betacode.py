"""Beta code (ASCII transcription of Greek) to Unicode and back, by the published rules of the code.

A letter is followed by its signs; a capital is an asterisk, the letter, and
signs before or after the letter.  A letter with signs is the Greek letter with
combining marks, composed; signs may stand in any order.  There is no table of
combinations, so every combination the code allows is read.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the letters and signs of beta code ----------------------------
LETTERS = {
    "A": "α", "B": "β", "G": "γ", "D": "δ", "E": "ε", "Z": "ζ", "H": "η", "Q": "θ", "I": "ι", "K": "κ", "L": "λ", "M": "μ",
    "N": "ν", "C": "ξ", "O": "ο", "P": "π", "R": "ρ", "S": "σ", "T": "τ", "U": "υ", "F": "φ", "X": "χ", "Y": "ψ", "W": "ω",
}
SIGNS = {
    ")": "\u0313",  # smooth breathing
    "(": "\u0314",  # rough breathing
    "+": "\u0308",  # diaeresis
    "'": "\u0306",  # breve
    "\\": "\u0300",  # grave
    "/": "\u0301",  # acute
    "=": "\u0342",  # circumflex
    "|": "\u0345",  # iota subscript
}
APOSTROPHE = "\u02bc"  # a smooth breathing that has no letter to stand on
# ----------------------------------------------------------------------------

_VOWELS = "AEHIOUW"
# Which letters a sign can stand on; another sign stays as it is written.
_BEARERS = {")": _VOWELS + "R", "(": _VOWELS + "R", "+": "IU", "'": "AIU", "\\": _VOWELS, "/": _VOWELS, "=": "AHIUW", "|": "AHW"}
_MARKED = re.compile(r"(\*?)([)(+'\\/=|]*)([A-Z])([)(+'\\/=|]*)")
# The order in which marks compose.
_ORDER = ")(+'\\/=|"


@lru_cache(maxsize=1)
def _oxia() -> dict[str, str]:
    """Letters with an acute alone: the code point of the Greek Extended block for the one that composition gives."""
    extended = (chr(c) for c in range(0x1F70, 0x1FFF))
    single = (c for c in extended if len(unicodedata.decomposition(c).split()) == 1 and unicodedata.category(c) == "Ll")
    return {unicodedata.normalize("NFC", c): c for c in single if "\u0301" in unicodedata.normalize("NFD", c)}


def _greek(letter: str, signs: str, capital: bool) -> str:
    greek = LETTERS[letter].upper() if capital else LETTERS[letter]
    composed = unicodedata.normalize("NFC", greek + "".join(SIGNS[s] for s in sorted(set(signs), key=_ORDER.index)))
    return _oxia().get(composed, composed)


def _read(found: re.Match) -> str:
    star, before, letter, after = found.groups()
    if letter not in LETTERS:
        return star + before + letter + after
    # Signs in front belong to a capital; in front of a small letter they have no letter.
    own, front = (before + after, "") if star else (after, before)
    worn = "".join(s for s in own if letter in _BEARERS[s])
    left = "".join(s for s in own if letter not in _BEARERS[s])
    return (front + _greek(letter, worn, bool(star)) + left).replace(")", APOSTROPHE)


def convert(text: str) -> str:
    """Conversion of one text but for final sigmas."""
    # Capitals may also be written with signs in front of the asterisk.
    upper = re.sub(r"([)(+'\\/=|]+)\*(?=[A-Z])", r"*\1", text.upper())
    return _MARKED.sub(_read, upper).replace(")", APOSTROPHE)


def convert_with_sigmas(text: str) -> str:
    """Whole conversion of one text, for the markup parsers."""
    return re.sub(r"σ(?!\w)", "ς", convert(text))


@lru_cache(maxsize=65536)
def _written(greek: str) -> str:
    """Beta code of one character: letter and signs, the asterisk and the signs of a capital in front."""
    if greek == APOSTROPHE:
        return ")"
    base, *marks = unicodedata.normalize("NFD", greek)
    letters = {v: k for k, v in LETTERS.items()} | {"ς": "S"}
    signs = {v: k for k, v in SIGNS.items()}
    letter = letters.get(base.lower())
    if letter is None or any(m not in signs for m in marks):
        return greek
    written = "".join(sorted((signs[m] for m in marks), key=_ORDER.index))
    return letter + written if base in letters else "*" + written + letter


@F.pandas_udf(T.StringType())
def _beta_to_greek(values: pd.Series) -> pd.Series:
    return values.map(convert, na_action="ignore")


@F.pandas_udf(T.StringType())
def _greek_to_beta(values: pd.Series) -> pd.Series:
    return values.map(lambda s: "".join(map(_written, s)), na_action="ignore")


def fix_final_sigma(text: Column) -> Column:
    """A sigma that ends a word gets its final form."""
    return F.regexp_replace(text, r"σ(?![\p{L}\p{N}_])", "ς")


def beta_to_unicode(text: Column) -> Column:
    """The upper-cased text letter by letter with its signs; then final sigmas."""
    return fix_final_sigma(_beta_to_greek(text))


def unicode_to_beta(text: Column) -> Column:
    return _greek_to_beta(text)


def transform_text(text: Column, language: Column) -> Column:
    """Texts marked as Greek are beta code; all others, and those without a language, stay."""
    is_greek = F.coalesce(F.lower(language) == "greek", F.lit(False))
    return F.coalesce(beta_to_unicode(F.when(is_greek, text)), text)
