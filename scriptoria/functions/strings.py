"""Small string functions on columns."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptoria.functions.normalize import strip_accents

# --- fixed values -----------------------------------------------------------
DEGREES = ["Ph.D.", "Ph. D.", "M.A.", "LL.D.", "A.M.", "Esq.", ","]
TITLE_NOISE = ["(Greek). Machine readable text", "(English). Machine readable text", "(English)"]
SLUG_DROPPED_SIGNS = r"[)'(+*=|/\\]"
# ----------------------------------------------------------------------------
_TRIM = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(text, _TRIM, "")


def slugify(text: Column) -> Column:
    """ASCII letters, digits, underscores; blanks and hyphens become one hyphen."""
    ascii_only = F.regexp_replace(strip_accents(text), r"[^\x00-\x7F]", "")
    kept = strip(F.regexp_replace(F.lower(ascii_only), r"[^a-z0-9_\s-]", ""))
    return F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def division_slug(original_title: Column, descriptor: Column, sequence_number: Column) -> Column:
    return F.coalesce(
        slugify(F.regexp_replace(original_title, SLUG_DROPPED_SIGNS, "")),
        slugify(descriptor),
        sequence_number.cast("string"),
    )


def unslugify(slug: Column) -> Column:
    return F.initcap(F.translate(slug, "_-", "  "))


def collapse_whitespace(text: Column, remove_all_endlines: bool = True) -> Column:
    lines = F.regexp_replace(strip(text), r"\n+", "" if remove_all_endlines else "\n")
    return F.regexp_replace(lines, r"[\t ]+", " ")


def clean_title(title: Column) -> Column:
    """Title without the distributor's remarks and without one trailing period."""
    text = strip(title)
    for noise in TITLE_NOISE:
        text = F.replace(text, F.lit(noise), F.lit(""))
    return strip(F.regexp_replace(text, r"\.$", ""))


def person_surname(name: Column) -> Column:
    """Last word of a name without academic degrees."""
    text = name
    for degree in DEGREES:
        text = F.replace(text, F.lit(degree), F.lit(""))
    return F.element_at(F.split(strip(text), " "), -1)


def line_number(text: Column) -> Column:
    """``struct<pre, number, post>`` of a line number such as ``a12b``; NULL when there is no number."""
    return F.when(
        text.rlike("[0-9]"),
        F.struct(
            F.regexp_extract(text, r"^(\D*)", 1).alias("pre"),
            F.regexp_extract(text, r"([0-9]+)", 1).cast("bigint").alias("number"),
            F.regexp_extract(text, r"^\D*[0-9]+(.*)$", 1).alias("post"),
        ),
    )


def format_line_number(line: Column, step: int = 0) -> Column:
    """Print a line number, ``step`` lines on (negative: back)."""
    return F.concat(
        F.coalesce(line["pre"], F.lit("")),
        (line["number"] + step).cast("string"),
        F.coalesce(line["post"], F.lit("")),
    )


def line_range_title(start: Column, end: Column) -> Column:
    first = F.when(start == 0, F.lit(1).cast("bigint")).otherwise(start)
    return F.concat(F.lit("lines "), first.cast("string"), F.lit("-"), end.cast("string"))


def range_makes_sense(start: Column, end: Column) -> Column:
    return (end > 0) & (end >= start)


def level_from_tag(tag: Column, default: int = 1) -> Column:
    digits = F.regexp_extract(tag, r"div([0-9]+)", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(F.lit(default))


def wildcard_pattern(wildcard: Column) -> Column:
    """Pattern of a ``*`` wildcard: the pieces in this order, anchored at neither end."""
    pieces = F.transform(F.split(wildcard, r"\*"), lambda p: F.concat(F.lit(r".*\Q"), p, F.lit(r"\E")))
    return F.concat(F.lit("^"), F.array_join(pieces, ""))


def clean_form(form: Column) -> Column:
    """A word form of the two-line records: no leading ``!``, trimmed."""
    return strip(F.regexp_replace(form, r"^!", ""))


def clean_beta_form(form: Column) -> Column:
    """A beta-code form of the analysis lines: no ``!``."""
    return F.replace(form, F.lit("!"), F.lit(""))


# Template helpers ------------------------------------------------------------


def contains(text: Column, part: Column | str) -> Column:
    return F.coalesce(text.contains(part), F.lit(False))


def starts_with(text: Column, part: Column | str) -> Column:
    return F.coalesce(text.startswith(part), F.lit(False))


def ends_with(text: Column, part: Column | str) -> Column:
    return F.coalesce(text.endswith(part), F.lit(False))


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.lower(text).contains(part.lower())


def equals_ignoring_case(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)


def remove_part(text: Column, part: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def replace_pair(text: Column, pair: str) -> Column:
    """``pair`` is "old,new"."""
    old, new = pair.split(",", 1)
    return F.replace(text, F.lit(old), F.lit(new))


def add_space(text: Column) -> Column:
    return F.when(~F.endswith(text, F.lit(" ")), F.concat(text, F.lit(" "))).otherwise(text)


def repair_book_label(text: Column) -> Column:
    """Undo the Greek spelling of "book" and capitalise."""
    fixed = F.replace(text, F.lit("βοοκ"), F.lit("book"))
    return F.concat(F.upper(F.substring(fixed, 1, 1)), F.lower(F.substring(fixed, F.lit(2), F.length(fixed))))
