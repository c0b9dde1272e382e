"""Notes of passages, footnotes, chapter text and markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import markup
from scriptoria.operators import export as E
from scriptoria.operators import notes as N
from scriptoria.plans import adapter as A
from scriptoria.plans.registry import query
from scriptoria.plans.sql import DIVISIONS, VERSES, with_

_REFERENCES = """refs AS (
  SELECT event_id AS note_id, user_id, event_type, 'value ' || CAST(floor(value) AS BIGINT) AS text, k AS division_id,
    source || '-' || lang AS work_slug, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 3 + 1 AS VARCHAR) END AS verse_indicator
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) JOIN documents ON doc_id = k)"""


def _divisions(spark, sf_dir) -> DataFrame:
    return A.divisions(spark, sf_dir).withColumn("path", F.array("descriptor"))


@query(
    "notes_of_passages", "J15 A10 P3",
    with_(_REFERENCES) + """
SELECT DISTINCT conv_id AS request_id, note_id FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN refs ON division_id = conv_id
WHERE (conv_id % 2 = 0 OR verse_indicator = '2') AND (event_type ILIKE '%IC%' OR text ILIKE '%IC%')""",
)
def notes_of_passages(spark, sf_dir):
    """One request per conversation number: that document, for odd numbers its verse 2 only."""
    divisions = _divisions(spark, sf_dir)
    convs = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id")).distinct()
    named = F.col("request_id").cast("string")
    requests = convs.join(divisions.select(F.col("division_id").alias("request_id"), "work_slug"), "request_id").select(
        "request_id", "work_slug", F.when(F.col("request_id") % 2 == 0, F.array(named)).otherwise(F.array(named, F.lit("2"))).alias("parts")
    )
    passages = N.allowed_passages(requests, divisions)
    found = N.notes_for_passages(A.notes(spark, sf_dir), A.note_references(spark, sf_dir), passages, search="IC")
    return found.select("request_id", "note_id")


@query(
    "notes_of_works_and_related", "J15",
    with_(_REFERENCES) + """,
asked AS (SELECT DISTINCT source, source || '-' || lang AS work_slug FROM documents WHERE lang = 'fr'),
allowed AS (SELECT a.work_slug AS asked, d.work_slug FROM asked a JOIN (SELECT DISTINCT source, source || '-' || lang AS work_slug FROM documents) d USING (source))
SELECT asked AS work_slug, count(DISTINCT note_id) AS notes FROM allowed JOIN refs USING (work_slug) GROUP BY ALL""",
)
def notes_of_works_and_related(spark, sf_dir):
    """Notes on the French works or on the same title in any language."""
    works = A.works(spark, sf_dir).select("title", "language", F.col("title_slug").alias("work_slug"))
    related = works.join(works.select("title", F.col("work_slug").alias("related_slug")), "title").where("work_slug <> related_slug")
    requests = works.where(F.col("language") == "fr").select(
        F.col("work_slug").alias("request_id"), "work_slug", F.lit(None).cast("array<string>").alias("parts")
    )
    passages = N.allowed_passages(requests, _divisions(spark, sf_dir), related)
    found = N.notes_for_passages(A.notes(spark, sf_dir), A.note_references(spark, sf_dir), passages)
    return found.groupBy(F.col("request_id").alias("work_slug")).agg(F.count(F.lit(1)).alias("notes"))


@query(
    "notes_per_verse", "A9",
    with_(_REFERENCES) + "SELECT division_id, verse_indicator, count(verse_indicator) AS notes FROM refs GROUP BY ALL",
)
def notes_per_verse(spark, sf_dir):
    return N.notes_per_verse(A.note_references(spark, sf_dir), ["division_id"])


@query(
    "notes_page", "O6 P3",
    "SELECT event_id AS note_id FROM events WHERE event_type ILIKE '%CLI%' ORDER BY event_id LIMIT 10 OFFSET 20",
)
def notes_page(spark, sf_dir):
    return N.page_of_notes(N.matching_notes(A.notes(spark, sf_dir), "CLI"), 2).select("note_id")


@query(
    "notes_export", "K3",
    with_(_REFERENCES) + """
SELECT event_id AS id, e.event_type AS title, 'value ' || CAST(floor(value) AS BIGINT) AS text, work_slug AS work,
  coalesce(CAST(division_id AS VARCHAR) || CASE WHEN verse_indicator IS NOT NULL THEN ':' || verse_indicator ELSE '' END, '') AS reference
FROM events e LEFT JOIN refs ON note_id = event_id""",
)
def notes_export(spark, sf_dir):
    references = A.note_references(spark, sf_dir).withColumn("reference_id", F.col("note_id"))
    return N.export_rows(A.notes(spark, sf_dir), references, _divisions(spark, sf_dir))


# Verses with footnotes ---------------------------------------------------------------


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def annotated_verses(spark, sf_dir) -> DataFrame:
    """Every third verse has a footnote, every fifth one more; hidden parts in every second."""
    n = F.col("sequence_number")
    note = F.concat(F.lit('<note n="1">see <hi>line</hi> '), "indicator", F.lit("</note>"))
    xml = F.concat(
        F.lit("<verse>"), _escaped(F.col("content")), F.when(n % 3 == 0, note).otherwise(""),
        F.when(n % 5 == 0, F.concat(F.lit(" and<note>also "), "indicator", F.lit("</note>"))).otherwise(""),
        F.lit("</verse>"),
    )
    return A.verses(spark, sf_dir).withColumn("original_content", xml)


_ANNOTATED = VERSES + r""",
counted AS (SELECT *, CASE WHEN sequence_number % 3 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN sequence_number % 5 = 0 THEN 1 ELSE 0 END AS b FROM verses),
numbered AS (SELECT *, a + b AS notes, coalesce(sum(a + b) OVER (PARTITION BY division_id ORDER BY sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS notes_before FROM counted),
shown AS (SELECT *, indicator || '. ' || regexp_replace(regexp_replace(content || CASE WHEN a = 1 THEN '[' || (notes_before + 1) || ']' ELSE '' END
   || CASE WHEN b = 1 THEN ' and[' || (notes_before + a + 1) || ']' ELSE '' END, '^\s+|\s+$', '', 'g'), '[\t ]+', ' ', 'g') AS line FROM numbered)"""


@query(
    "footnote_numbers", "W12 A15",
    with_(_ANNOTATED) + "SELECT verse_id, CAST(notes AS BIGINT) AS notes, CAST(notes_before AS BIGINT) AS notes_before FROM numbered",
)
def footnote_numbers(spark, sf_dir):
    return E.number_footnotes(annotated_verses(spark, sf_dir), A.verse_chunk("verse_id")).select("verse_id", "notes", "notes_before")


@query(
    "verse_plain_texts", "F46 W12",
    with_(_ANNOTATED) + """
SELECT verse_id, line AS text, coalesce(CASE WHEN a = 1 THEN '[' || (notes_before + 1) || '] see line ' || indicator END, '') ||
  CASE WHEN a = 1 AND b = 1 THEN '|' ELSE '' END || coalesce(CASE WHEN b = 1 THEN '[' || (notes_before + a + 1) || '] also ' || indicator END, '') AS footnotes FROM shown""",
)
def verse_plain_texts(spark, sf_dir):
    texts = E.verse_texts(annotated_verses(spark, sf_dir), A.verse_chunk("verse_id"))
    return texts.select("verse_id", "text", F.array_join("footnotes", "|").alias("footnotes"))


@query(
    "chapter_plain_texts", "A14 K7 W12",
    with_(_ANNOTATED) + r""",
f AS (SELECT division_id, sequence_number, 1 AS k, '[' || (notes_before + 1) || '] see line ' || indicator AS note FROM shown WHERE a = 1
  UNION ALL SELECT division_id, sequence_number, 2, '[' || (notes_before + a + 1) || '] also ' || indicator FROM shown WHERE b = 1),
body AS (SELECT division_id, string_agg(line, ' ' ORDER BY sequence_number) AS text FROM shown GROUP BY ALL),
foot AS (SELECT division_id, string_agg(note, chr(10) ORDER BY sequence_number, k) AS notes FROM f GROUP BY ALL)
SELECT division_id, text || coalesce(chr(10) || chr(10) || 'Footnotes:' || chr(10) || notes, '') AS text FROM body LEFT JOIN foot USING (division_id)""",
)
def chapter_plain_texts(spark, sf_dir):
    return E.chapter_texts(annotated_verses(spark, sf_dir), A.verse_chunk("verse_id"))


@query(
    "footnote_rows", "F45 U3",
    with_(VERSES) + """
SELECT division_id, 'see line ' || indicator AS note FROM verses WHERE sequence_number % 3 = 0
UNION ALL SELECT division_id, 'also ' || indicator FROM verses WHERE sequence_number % 5 = 0""",
)
def footnote_rows(spark, sf_dir):
    notes = markup.footnotes(F.col("original_content"), F.col("language"))
    return annotated_verses(spark, sf_dir).select("division_id", F.explode(notes).alias("note"))


@query(
    "verse_html", "F43 X1",
    with_(VERSES) + r""",
e AS (SELECT *, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM verses)
SELECT verse_id, '<span class="verse">' || t || CASE WHEN sequence_number % 3 = 0 THEN '<span class="note" data-n="1">see <span class="hi">line</span> ' || indicator || '</span>' ELSE '' END
 || CASE WHEN sequence_number % 5 = 0 THEN ' and<span class="note">also ' || indicator || '</span>' ELSE '' END || '</span>' AS html FROM e""",
)
def verse_html(spark, sf_dir):
    convert = markup.html_converter()
    return annotated_verses(spark, sf_dir).select("verse_id", convert(F.col("original_content"), F.lit("English")).alias("html"))


@query(
    "verse_html_words", "F44 F8 X1",
    with_(VERSES) + r""",
s AS (SELECT verse_id, unnest(p) AS w, unnest(range(len(p))) AS i FROM (
  SELECT verse_id, regexp_extract_all(content, '\s+|[\[\],.:;]|[^\s\[\],.:;]+') AS p FROM verses WHERE length(content) > 0)),
e AS (SELECT verse_id, i, w, replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM s)
SELECT verse_id, '<span class="verse">' || string_agg(CASE WHEN regexp_matches(w, '^[\s\[\],.:;]') THEN t ELSE '<span class="word">' || t || '</span>' END, '' ORDER BY i) || '</span>' AS html
FROM e GROUP BY verse_id""",
)
def verse_html_words(spark, sf_dir):
    wrapped = markup.html_converter(wrap_words=True)
    plain = F.concat(F.lit("<verse>"), _escaped(F.col("content")), F.lit("</verse>"))
    return A.verses(spark, sf_dir).where(F.length("content") > 0).select("verse_id", wrapped(plain, F.col("language")).alias("html"))


@query(
    "hidden_parts_pruned", "F47",
    with_(VERSES) + """
SELECT verse_id, '<verse>' || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '<hi>kept</hi></verse>' AS xml FROM verses""",
)
def hidden_parts_pruned(spark, sf_dir):
    xml = F.concat(
        F.lit("<verse>"), _escaped(F.col("content")),
        F.lit('<sup class="note hide">x<b>y</b></sup><hi>kept<span class="hide">z</span></hi><span class="a hide"/></verse>'),
    )
    return A.verses(spark, sf_dir).select("verse_id", markup.prune_hidden(xml).alias("xml"))


@query("page_html", "F43 F46")
def page_html(spark, sf_dir):
    """Raw web pages through the span converter and the text extractor."""
    convert = markup.html_converter()
    html = F.col("html")
    return A.table(spark, sf_dir, "pages").select(
        "page_id", convert(html, F.lit(None).cast("string")).alias("spans"),
        markup.text_and_notes(html, F.lit(None).cast("string"), F.lit(1)).alias("t"),
    ).select("page_id", "spans", F.col("t.text").alias("text"))
