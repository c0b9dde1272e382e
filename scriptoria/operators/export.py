"""Result lists, chapter text with footnotes, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.markup import text_and_notes
from scriptoria.functions.strings import collapse_whitespace
from scriptoria.functions.tokens import snippet
from scriptoria.operators.hierarchy import describe_path, verse_label
from scriptoria.operators.ordered import running_sum
from scriptoria.operators.search import result_url
from scriptoria.operators.transforms import accepted_files

RESULT_COLUMNS = ["url", "description", "content_snippet", "work", "division", "verse"]


def with_verse_counts(verses: DataFrame, all_verses: DataFrame | None = None) -> DataFrame:
    """Add ``has_several_verses``: does the verse's division own more than one verse?

    Counted over ``all_verses`` (default: the same table) by aggregation.
    """
    counts = (all_verses if all_verses is not None else verses).groupBy("division_id").agg(F.count(F.lit(1)).alias("__n"))
    return verses.join(counts, "division_id").withColumn("has_several_verses", F.col("__n") > 1).drop("__n")


def result_rows(hits: DataFrame, verses: DataFrame, divisions: DataFrame, works: DataFrame) -> DataFrame:
    """Hits joined to verse, division and work, shaped as a result list.

    Only divisions that hold a hit are counted for the lone-verse rule.
    """
    found = verses.join(hits, "verse_id")
    touched = found.select("division_id").distinct()
    siblings = verses.select("division_id").join(touched, "division_id", "left_semi")
    counted = with_verse_counts(found, siblings)
    label = verse_label(F.col("indicator"), F.col("sequence_number"))
    return (
        counted.join(divisions.select("division_id", "path"), "division_id")
        .join(works.select(F.col("title_slug").alias("work_slug"), F.col("title").alias("work")), "work_slug")
        .select(
            *[c for c in hits.columns],
            F.when(F.col("has_several_verses"), result_url(F.col("work_slug"), F.col("path"), label))
            .otherwise(result_url(F.col("work_slug"), F.col("path")))
            .alias("url"),
            F.when(F.col("has_several_verses"), describe_path(F.col("path"), label))
            .otherwise(describe_path(F.col("path")))
            .alias("description"),
            snippet(F.col("content")).alias("content_snippet"),
            "work",
            "work_slug",
            describe_path(F.col("path")).alias("division"),
            label.alias("verse"),
        )
    )


def search_summary(totals: DataFrame, query_text: str, url: str | None = None) -> DataFrame:
    """Query, url, result count and match count beside the results."""
    columns = [
        "query_id", F.lit(query_text).alias("query"),
        F.col("results").alias("result_count"), F.col("matches").alias("match_count"),
    ]
    if url is not None:
        columns.insert(2, F.lit(url).alias("url"))
    return totals.select(*columns)


def write_results_csv(rows: DataFrame, path: str) -> None:
    rows.select(*RESULT_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def note_count(original_content: Column) -> Column:
    """Number of footnotes in a verse's markup."""
    return F.regexp_count(original_content, F.lit("<note")).cast("bigint")


def division_payload() -> Column:
    """A division with its ancestors (root first) as JSON."""
    return F.to_json(
        F.struct(
            F.coalesce("title", "descriptor").alias("title"),
            "level",
            F.transform(F.slice("path", 1, F.size("path") - 1), lambda p: F.struct(p.alias("title"))).alias("ancestors"),
        )
    )


# Chapter text ---------------------------------------------------------------------


def number_footnotes(verses: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Footnotes counted continuously over the verses of a chapter: adds ``notes`` and ``notes_before``."""
    counted = verses.withColumn("notes", note_count(F.coalesce("original_content", F.lit(""))))
    return running_sum(
        counted, ["division_id"], "sequence_number", {"notes_before": F.col("notes")}, chunk=chunk, exclusive=True
    )


def verse_texts(verses: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Plain text of each verse with its footnotes numbered within the chapter.

    ``verses``: division_id, sequence_number, indicator, content,
    original_content, language.  Adds ``text`` and ``footnotes`` ("[n] ...").
    """
    numbered = number_footnotes(verses, chunk)
    marked_up = F.length("original_content") > 0
    parsed = numbered.withColumn(
        "__parsed",
        text_and_notes(F.when(marked_up, F.col("original_content")), F.col("language"), F.col("notes_before") + 1),
    )
    prefix = F.when(F.length("indicator") > 0, F.concat("indicator", F.lit(". "))).otherwise("")
    body = F.when(marked_up, collapse_whitespace(F.col("__parsed.text"))).otherwise(F.col("content"))
    labelled = F.transform(
        F.coalesce("__parsed.notes", F.array().cast("array<string>")),
        lambda note, i: F.concat(F.lit("["), (F.col("notes_before") + 1 + i).cast("string"), F.lit("] "), note),
    )
    return parsed.select(*verses.columns, F.concat(prefix, body).alias("text"), labelled.alias("footnotes"))


def chapter_texts(verses: DataFrame, chunk: Column | None = None) -> DataFrame:
    """One text per chapter: verses in order, joined by a blank, then the block of footnotes.

    A chapter becomes one value here, so it has to fit in a row, as the
    document it comes from does.
    """
    texts = verse_texts(verses, chunk)
    folded = texts.groupBy("division_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence_number", "text", "footnotes"))).alias("v")
    )
    notes = F.flatten(F.transform("v", lambda x: x["footnotes"]))
    block = F.when(
        F.size(notes) > 0, F.concat(F.lit("\n\nFootnotes:\n"), F.array_join(notes, "\n"))
    ).otherwise("")
    return folded.select("division_id", F.concat(F.array_join(F.transform("v", lambda x: x["text"]), " "), block).alias("text"))


def write_chapter_texts(chapters: DataFrame, path: str) -> None:
    """``chapters``: work_slug, text."""
    chapters.select("work_slug", "text").write.mode("overwrite").partitionBy("work_slug").text(path)


def corpus_index(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Index of the corpus files some policy rule accepts: title, author, language, file, editor."""
    accepted = files if rules is None else accepted_files(files, rules)
    return accepted.select("title", "author", "language", F.col("file_name").alias("file"), "editor")
