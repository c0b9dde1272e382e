"""Boolean, fielded and phrase search over the postings table, for many queries at once.

A query is a table of clauses: branches are OR-ed, the clauses of a branch are
AND-ed, the alternatives of a clause (query expansion) are OR-ed.  There is no
query string to parse.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.functions.betacode import beta_to_unicode
from scriptoria.functions.normalize import lookup_key, normalize, strip_accents
from scriptoria.functions.strings import unslugify
from scriptoria.functions.tokens import FIELD_ANALYSERS, analyse
from scriptoria.operators.ordered import by_width, number_rows
from scriptoria.schemas import CLAUSES
from scriptoria.session import small_or_merged

_BETA_SIGNS = r"[\/()*=&+|]"


def clauses(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Clause table from (query_id, branch, clause, negated, field, text) tuples.

    Built from a pandas frame it is a local relation of known size, so Spark
    broadcasts it when, and only when, it is below its own threshold.
    """
    frame = pd.DataFrame(list(rows), columns=CLAUSES.fieldNames())
    return spark.createDataFrame(frame, CLAUSES)


def default_field(ignore_diacritics: bool) -> str:
    return "no_diacritics" if ignore_diacritics else "content"


def analyse_clauses(clause_table: DataFrame, word_analyser: str = "word") -> DataFrame:
    """Run each clause's text through the analyser of its field; adds ``terms`` (several: a phrase)."""
    terms = None
    for field in FIELD_ANALYSERS:
        tokens = analyse(F.col("text"), field, word_analyser)
        terms = F.when(F.col("field") == field, tokens) if terms is None else terms.when(F.col("field") == field, tokens)
    return clause_table.withColumn("terms", terms)


def _with_required(terms: DataFrame) -> DataFrame:
    """Attach how many positive clauses each branch has."""
    need = terms.groupBy("query_id", "branch").agg(
        F.count_distinct(F.when(~F.col("negated"), F.col("clause"))).alias("required")
    )
    return terms.join(need, ["query_id", "branch"])


def _hits_of_entries(entries: DataFrame) -> DataFrame:
    """Fold matched (clause, posting) entries to hits; one shuffle on (query, verse).

    The sets collected per hit hold at most the query's own clauses and terms.
    """
    folded = entries.groupBy("query_id", "verse_id", "work_slug").agg(
        F.collect_set(F.struct("branch", "clause", "negated", "required")).alias("met"),
        F.collect_set(F.when(~F.col("negated"), F.struct("field", "term", "tf"))).alias("matches"),
    )
    branches = F.array_distinct(
        F.transform(F.filter("met", lambda m: ~m["negated"]), lambda m: F.struct(m["branch"], m["required"]))
    )
    satisfied = F.exists(
        branches,
        lambda b: (
            F.size(F.filter("met", lambda m: ~m["negated"] & (m["branch"] == b["branch"]))) == b["required"]
        )
        & ~F.exists("met", lambda m: m["negated"] & (m["branch"] == b["branch"])),
    )
    return folded.where(satisfied).select("query_id", "verse_id", "work_slug", "matches")


def match(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Verses that satisfy each query, with the matched terms and their frequencies.

    ``terms``: query_id, branch, clause, negated, field, term.  Returns
    query_id, verse_id, work_slug, matches array<struct<field, term, tf>>.
    A branch needs at least one clause that is not negated.
    """
    wanted = _with_required(terms.select("query_id", "branch", "clause", "negated", "field", "term").distinct())
    entries = postings.select("field", "term", "verse_id", "work_slug", "tf").join(wanted, ["field", "term"])
    return _hits_of_entries(entries)


def phrase_entries(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """Postings of the phrases: verses where the terms stand at consecutive positions.

    ``phrases``: query_id, branch, clause, negated, required, field, terms.
    A start position counts when every term of the phrase supports it, so one
    aggregation replaces a chain of self-joins; what is grouped is one verse.
    """
    wanted = phrases.select(
        "query_id", "branch", "clause", "negated", "required", "field",
        F.array_join("terms", " ").alias("phrase"), F.size("terms").alias("n"),
        F.posexplode("terms").alias("offset", "term"),
    )
    starts = postings.join(wanted, ["field", "term"]).select(
        "query_id", "branch", "clause", "negated", "required", "field", "phrase", "n", "verse_id", "work_slug",
        F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start"),
    )
    keys = ["query_id", "branch", "clause", "negated", "required", "field", "phrase", "verse_id", "work_slug"]
    full = starts.groupBy(*keys, "n", "start").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") == F.col("n"))
    return full.groupBy(*keys).agg(F.count(F.lit(1)).alias("tf")).withColumnRenamed("phrase", "term")


def search(postings: DataFrame, clause_table: DataFrame, word_analyser: str = "word") -> DataFrame:
    """Match clauses given as text: one token is a term, several are a phrase."""
    analysed = _with_required(analyse_clauses(clause_table, word_analyser))
    single = analysed.where(F.size("terms") == 1).withColumn("term", F.col("terms")[0])
    entries = postings.join(
        single.select("query_id", "branch", "clause", "negated", "required", "field", "term"), ["field", "term"]
    )
    columns = ["query_id", "branch", "clause", "negated", "required", "field", "term", "verse_id", "work_slug", "tf"]
    phrases = phrase_entries(postings, analysed.where(F.size("terms") > 1))
    return _hits_of_entries(entries.select(*columns).unionByName(phrases.select(*columns)))


# Query expansion -------------------------------------------------------------


def expand(
    terms: DataFrame,
    related_forms: DataFrame | None,
    related_basic: DataFrame | None = None,
    include_beta_code: bool = True,
    read_as_beta_code: bool = True,
) -> DataFrame:
    """Add alternatives to each clause: its beta-code reading and all related forms.

    ``terms``: query_id, branch, clause, negated, field, term.
    ``related_forms``: word -> form, exact, words as look-up keys (lower case,
    NFKC, final sigma); ``related_basic``: accent-free word -> form, used when the exact word is unknown or the field is accent-free.
    Adds ``expanded_by`` ("term", "beta", "related", "related without marks").
    Only the fields ``content`` and ``no_diacritics`` are expanded.  Turn
    ``read_as_beta_code`` off for corpora in Latin script, whose words would
    otherwise be looked up in their Greek reading.
    """
    keys = ["query_id", "branch", "clause", "negated", "field"]
    plain_field = F.col("field") == "no_diacritics"
    greek_field = F.col("field").isin("content", "no_diacritics")
    bare = strip_accents(F.regexp_replace("term", _BETA_SIGNS, ""))
    prepared = terms.select(*keys, F.when(plain_field, bare).otherwise(F.col("term")).alias("term"))
    reading = beta_to_unicode(F.col("term")) if read_as_beta_code else F.col("term")
    prepared = prepared.withColumn("reading", normalize(reading))
    out = prepared.select(*keys, "term", F.lit("term").alias("expanded_by"))
    if include_beta_code:
        out = out.unionByName(
            prepared.where(greek_field).select(*keys, F.col("reading").alias("term"), F.lit("beta").alias("expanded_by"))
        )
    if related_forms is not None:
        open_terms = prepared.where(greek_field).select(*keys, lookup_key(F.col("reading")).alias("word"))
        exact = open_terms.where(~plain_field).join(related_forms.select("word", "form"), "word")
        out = out.unionByName(exact.select(*keys, F.col("form").alias("term"), F.lit("related").alias("expanded_by")))
        if related_basic is not None:
            known = related_forms.select("word").distinct()
            unknown = open_terms.where(~plain_field).join(known, "word", "left_anti")
            by_bare = (
                unknown.unionByName(open_terms.where(plain_field))
                .withColumn("word", strip_accents(F.col("word")))
                .join(related_basic.select("word", "form"), "word")
            )
            form = F.when(plain_field, strip_accents(F.col("form"))).otherwise(F.col("form"))
            out = out.unionByName(
                by_bare.select(*keys, form.alias("term"), F.lit("related without marks").alias("expanded_by"))
            )
    return out.dropDuplicates([*keys, "term"])


def known_terms(expanded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Expansions that occur in the index (``vocabulary``: distinct field, term)."""
    return expanded.join(vocabulary.select("field", "term").distinct(), ["field", "term"], "left_semi")


def convert_query(tokens: Column) -> Column:
    """Beta code to Greek in query tokens ``array<struct<field, value>>``.

    Only tokens of the fields content, no_diacritics, section or of no field,
    and only values that start with a word character.
    """
    converted = F.split(
        beta_to_unicode(F.array_join(F.transform(tokens, lambda t: t["value"]), "\n")), "\n"
    )
    return F.zip_with(
        tokens,
        converted,
        lambda t, c: F.struct(
            t["field"].alias("field"),
            F.when(
                (t["field"].isNull() | t["field"].isin("content", "no_diacritics", "section"))
                & t["value"].rlike(r"^[\p{L}\p{N}_]"),
                c,
            )
            .otherwise(t["value"])
            .alias("value"),
        ),
    )


# Statistics ------------------------------------------------------------------


def _first_hits(hits: DataFrame, limit: int | None, chunk: Column | None) -> DataFrame:
    """The first ``limit`` hits of each query by verse id; None means all."""
    if limit is None:
        return hits
    numbered = number_rows(hits, ["query_id"], "verse_id", "__rank", chunk=chunk)
    return numbered.where(F.col("__rank") <= limit).drop("__rank")


def matched_frequencies(
    hits: DataFrame, postings: DataFrame | None = None, limit: int | None = None, chunk: Column | None = None
) -> DataFrame:
    """One row per hit and matched term: query_id, verse_id, work_slug, field, term, tf.

    By default a term counts in the field its clause searches.  With
    ``postings`` a matched term counts in the content and in the accent-free
    field alike, so an unaccented word counts twice.  ``chunk`` cuts the verse
    ids for the ranking that ``limit`` needs (default: ids are dense).
    """
    kept = _first_hits(hits, limit, chunk)
    in_clause_field = kept.select("query_id", "verse_id", "work_slug", F.inline("matches"))
    if postings is None:
        return in_clause_field
    terms = in_clause_field.where(F.col("field").isin("content", "no_diacritics")).select("query_id", "term").distinct()
    both = postings.where(F.col("field").isin("content", "no_diacritics")).select("field", "term", "verse_id", "work_slug", "tf")
    return (
        kept.select("query_id", "verse_id")
        .join(both.join(terms, "term"), ["query_id", "verse_id"])
        .select("query_id", "verse_id", "work_slug", "field", "term", "tf")
    )


def total_matches(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("query_id").agg(
        F.sum("tf").alias("matches"), F.count_distinct("verse_id").alias("results")
    )


def matches_per_term(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("query_id", "term").agg(F.sum("tf").alias("matches"))


def matches_per_work(frequencies: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """Occurrences per work; with ``works`` (title_slug, title) the slug becomes a title."""
    per_work = frequencies.groupBy("query_id", "work_slug").agg(F.sum("tf").alias("matches"))
    return per_work if works is None else with_work_titles(per_work, works)


def with_work_titles(df: DataFrame, works: DataFrame) -> DataFrame:
    """Add ``work``: the title, or the slug made readable when no work has it."""
    titles = works.select(F.col("title_slug").alias("work_slug"), F.col("title").alias("__title"))
    return df.join(titles, "work_slug", "left").withColumn(
        "work", F.coalesce("__title", unslugify(F.col("work_slug")))
    ).drop("__title")


def verses_per_term(hits: DataFrame) -> DataFrame:
    """Document frequency of each matched term, by field."""
    return (
        hits.select("query_id", F.inline("matches"))
        .groupBy("query_id", "field", "term")
        .agg(F.count(F.lit(1)).alias("verses"))
    )


def result_counts(hits: DataFrame, estimate: bool = False) -> DataFrame:
    """Hits per query (each hit is one row); the estimate tolerates repeated rows."""
    count = F.approx_count_distinct("verse_id") if estimate else F.count(F.lit(1))
    return hits.groupBy("query_id").agg(count.alias("results"))


def first_verses(entries: DataFrame, terms: DataFrame, count: int, chunk: Column | None = None) -> DataFrame:
    """(term, verse_id): the ``count`` smallest verse ids of each of the terms, all if there are fewer.

    The first ``count`` hits of OR-ed terms are among them, so a page near the
    top needs no more.  ``entries`` (term, verse_id, work_slug) are counted by
    term and ``chunk``, a column that grows with verse_id (default: ids are
    dense); a verse may stand under several works, so a chunk holds for certain
    only as many verses as its largest work.  Only entries of the chunks that
    are needed for ``count`` verses move.  Entries without a verse id are kept,
    as one for each term.
    """
    asked = small_or_merged(terms.select("term").distinct())
    cut = entries.join(asked, "term", "left_semi").withColumn("__chunk", chunk if chunk is not None else by_width("verse_id"))
    by_work = cut.groupBy("term", "__chunk", "work_slug").agg(F.count("verse_id").alias("n"))
    sure = by_work.groupBy("term", "__chunk").agg(F.max("n").alias("n"))
    along = Window.partitionBy("term").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    enough = sure.withColumn("__before", F.coalesce(F.sum("n").over(along), F.lit(0))).where(F.col("__before") < count)
    last = small_or_merged(enough.groupBy("term").agg(F.max("__chunk").alias("__last")))
    near = cut.join(last, "term").where(F.col("__chunk").isNull() | (F.col("__chunk") <= F.col("__last")))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.asc_nulls_first("verse_id")))
    # A missing id takes the first place.
    return near.select("term", "verse_id").distinct().withColumn("__place", place).where(F.col("__place") <= count + 1).drop("__place")


def page(hits: DataFrame, number: int, length: int = 20, chunk: Column | None = None) -> DataFrame:
    """Page ``number`` (1-based) of each query's hits by verse id, with their ``rank``.

    Hits are counted by ``chunk``, a column that grows with verse_id (default:
    ids are dense); only those of the chunks that hold the page are numbered,
    so a query with a billion hits ranks a few chunks of them.
    """
    low, high = (number - 1) * length, number * length
    cut = hits.withColumn("__chunk", chunk if chunk is not None else by_width("verse_id"))
    counts = cut.groupBy("query_id", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy("query_id").orderBy("__chunk")
    held = counts.withColumn("__before", F.sum("__n").over(along) - F.col("__n"))
    held = held.where((F.col("__before") < high) & (F.col("__before") + F.col("__n") > low)).drop("__n")
    inside = F.row_number().over(Window.partitionBy("query_id", "__chunk").orderBy("verse_id"))
    numbered = cut.join(held, ["query_id", "__chunk"]).withColumn("rank", F.col("__before") + inside)
    return numbered.where((F.col("rank") > low) & (F.col("rank") <= high)).drop("__chunk", "__before")


def result_url(work_slug: Column, path: Column, verse: Column | None = None) -> Column:
    parts = [F.lit(""), F.lit("work"), work_slug, F.array_join(path, "/")]
    return F.concat_ws("/", *(parts if verse is None else [*parts, verse]))
