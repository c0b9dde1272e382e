"""Unicode normalisation of text columns.

Spark has no normalisation function, so the two Unicode forms run as Arrow
batches.  Pure ASCII values are already in every normal form: they bypass
Python as NULLs, which keeps the transfer small for Latin-script corpora.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NOT_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def _without_marks(values: pd.Series) -> pd.Series:
    def strip(s: str) -> str:
        parts = unicodedata.normalize("NFKD", s)
        return unicodedata.normalize("NFKC", "".join(c for c in parts if not unicodedata.combining(c)))

    return values.map(strip, na_action="ignore")


def _bypass_ascii(udf, text: Column) -> Column:
    return F.coalesce(udf(F.when(text.rlike(_NOT_ASCII), text)), text)


def normalize(text: Column) -> Column:
    """NFKC of a text column."""
    return _bypass_ascii(_nfkc, text)


def strip_accents(text: Column) -> Column:
    """Text without combining marks, in NFKC."""
    return _bypass_ascii(_without_marks, text)


def lookup_key(word: Column, ignore_diacritics: bool = False) -> Column:
    """Key under which a word is stored: lower case, NFKC, final sigma, optionally bare."""
    from scriptoria.functions.betacode import fix_final_sigma

    key = fix_final_sigma(normalize(F.lower(word)))
    return strip_accents(key) if ignore_diacritics else key


def indexed_plain_text(text: Column, language: Column, skip_language: str | None = None) -> Column:
    """Accent-free text for the ``no_diacritics`` field.

    Every language is indexed by default; ``skip_language`` leaves one out,
    compared without regard to case.
    """
    plain = strip_accents(text)
    if skip_language is None:
        return plain
    return F.when(F.coalesce(F.lower(language), F.lit("")) != skip_language.lower(), plain)
