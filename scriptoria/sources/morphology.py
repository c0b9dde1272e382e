"""Morphology dumps: lemma lists, brace-group analyses, two-line analysis records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.betacode import beta_to_unicode
from scriptoria.functions.strings import clean_beta_form, clean_form, strip
from scriptoria.operators.ordered import carry, running_sum

# --- fixed values: patterns of the file formats -------------------------------
GROUP = r"[{][^{]*"
GROUP_PARTS = r"(?s)[{]?([0-9]+)\s+([0-9]+)\s+([^\t]+)\t(.+)\t([^}]*)[}](?:\[([0-9]+)\])?"
RECORD_PARTS = r"^(.*):(.*):(.*)"
# ------------------------------------------------------------------------------


def parse_lemmas(lines: DataFrame) -> DataFrame:
    """Lemma lines "beta form TAB reference number ..." (column ``value``)."""
    cells = F.split("value", "\t")
    return lines.select(
        F.replace(beta_to_unicode(F.get(cells, F.lit(0))), F.lit("'"), F.lit("")).alias("lexical_form"),
        F.get(cells, F.lit(1)).cast("bigint").alias("reference_number"),
        F.lit("Greek").alias("language"),
    )


def parse_analyses(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analysis lines "form TAB {ref 9 forms TAB meaning TAB attributes}[extra]...".

    Returns (analyses, rejects); rejects are groups that do not have the format.
    """
    form_beta = clean_beta_form(F.regexp_extract("value", "^([^\t]*)\t", 1))
    groups = lines.select(
        *[c for c in lines.columns if c != "value"],
        form_beta.alias("form_beta"),
        F.posexplode(F.regexp_extract_all("value", F.lit(GROUP), F.lit(0))).alias("group_no", "group"),
    )
    parts = {
        "reference_number": F.regexp_extract("group", GROUP_PARTS, 1).cast("bigint"),
        "second_number": F.regexp_extract("group", GROUP_PARTS, 2).cast("bigint"),
        "forms": F.regexp_extract("group", GROUP_PARTS, 3),
        "meaning": F.regexp_extract("group", GROUP_PARTS, 4),
        "details": F.regexp_extract("group", GROUP_PARTS, 5),
        "extra": F.regexp_extract("group", GROUP_PARTS, 6),
    }
    matches = F.col("group").rlike(GROUP_PARTS)
    form = F.replace(beta_to_unicode(F.col("form_beta")), F.lit("'"), F.lit(""))
    good = groups.where(matches).withColumns({**parts, "form": form})
    return good, groups.where(~matches)


def pair_records(lines: DataFrame, chunk=None) -> DataFrame:
    """Pair forms lines with the definitions lines that follow them.

    ``lines``: file, line_no, value.  A comment or a blank line drops a
    pending forms line, so pairs are counted from the last such line on.
    Returns file, line_no (of the definitions), forms_line, definitions_line.
    """
    # A comment pattern matched at the start of the line only.
    reset = F.col("value").startswith("#") | (strip(F.col("value")) == "")
    content = (~reset).cast("bigint")
    counted = running_sum(
        lines, ["file"], "line_no", {"__content": content, "__island": reset.cast("bigint")}, chunk=chunk
    )
    anchored = carry(
        counted, ["file"], "line_no", {"__base": F.when(reset, F.col("__content"))}, inclusive=True, chunk=chunk
    )
    place = F.col("__content") - F.coalesce("__base", F.lit(0))
    pairs = anchored.where(~reset).select(
        "file", "line_no", "value", "__island",
        F.floor((place + 1) / 2).cast("bigint").alias("__pair"), (place % 2).alias("__odd"),
    )
    return (
        pairs.groupBy("file", "__island", "__pair")
        .agg(
            F.max(F.when(F.col("__odd") == 0, F.col("line_no"))).alias("line_no"),
            F.max(F.when(F.col("__odd") == 1, F.col("value"))).alias("forms_line"),
            F.max(F.when(F.col("__odd") == 0, F.col("value"))).alias("definitions_line"),
        )
        .where(F.col("definitions_line").isNotNull())
        .select("file", "line_no", "forms_line", "definitions_line")
    )


def parse_records(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every form of the forms line with every definition of the definitions line.

    Returns (analyses, rejects).
    """
    forms = F.filter(F.split("forms_line", r"\|"), lambda f: F.length(f) > 0)
    exploded = (
        pairs.withColumn("form", F.explode(forms))
        .withColumn("form", clean_form(F.col("form")))
        .withColumn("definition", F.explode(F.split("definitions_line", "<br>")))
        .drop("forms_line", "definitions_line")
    )
    matches = F.col("definition").rlike(RECORD_PARTS)
    good = exploded.where(matches).select(
        "*",
        *[
            strip(F.regexp_extract("definition", RECORD_PARTS, i + 1)).alias(n)
            for i, n in enumerate(["lemma", "meaning", "details"])
        ],
    )
    return good, exploded.where(~matches)
