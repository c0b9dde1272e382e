"""Index building, search and search statistics over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.operators import postings as P
from scriptoria.operators import search as S
from scriptoria.operators import stored_index as I
from scriptoria.operators.export import result_rows, search_summary
from scriptoria.operators.hierarchy import section_text, with_ancestors
from scriptoria.plans import adapter as A
from scriptoria.plans.registry import query
from scriptoria.plans.sql import POSTINGS, VERSES, WORD, WORKS, with_
from scriptoria.session import cut_lineage

TWO_TERMS = [(1, 0, 0, False, "content", "the"), (1, 0, 1, False, "content", "and")]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.index_documents(A.verses(spark, sf_dir))


def _counts(spark: SparkSession, sf_dir: str, fields=("content",), terms: DataFrame | None = None) -> DataFrame:
    return P.build_term_counts(_docs(spark, sf_dir), fields, terms=terms)


def _hits(spark: SparkSession, sf_dir: str, rows=TWO_TERMS, fields=("content",)) -> DataFrame:
    """Hits of a search over text that has no stored index."""
    terms = _terms(spark, rows)
    return S.match(_counts(spark, sf_dir, fields, terms), terms)


def _terms(spark: SparkSession, rows) -> DataFrame:
    return S.clauses(spark, rows).withColumnRenamed("text", "term")


_HITS = """hits AS (
  SELECT verse_id, work_slug FROM postings WHERE field = 'content' AND term IN ('the', 'and')
  GROUP BY ALL HAVING count(DISTINCT term) = 2)"""


@query(
    "postings_table", "F7 K5 F13",
    with_(VERSES, POSTINGS) + "SELECT field, term, verse_id, work_slug, tf FROM postings",
)
def postings_table(spark, sf_dir):
    return _counts(spark, sf_dir, ("content", "no_diacritics"))


@query(
    "postings_positions", "K5 F7",
    with_(VERSES) + r"""
SELECT term, verse_id, count(*) AS tf, min(pos) AS first_position, max(pos) AS last_position, CAST(sum(pos) AS BIGINT) AS position_sum FROM (
  SELECT verse_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (
    SELECT verse_id, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS t FROM verses))
GROUP BY term, verse_id""",
)
def postings_positions(spark, sf_dir):
    postings = P.build_postings(_docs(spark, sf_dir), ("content",), word_analyser="plain")
    return postings.select(
        "term", "verse_id", "tf",
        F.element_at("positions", 1).cast("bigint").alias("first_position"),
        F.element_at("positions", -1).cast("bigint").alias("last_position"),
        F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p).alias("position_sum"),
    )


@query(
    "search_two_terms_per_work", "P11 P12 A1 A3 J1 J24 O4 P1 P5 P10",
    with_(VERSES, POSTINGS, WORKS, _HITS) + """
SELECT p.work_slug, w.title AS work, CAST(sum(tf) AS BIGINT) AS matches FROM postings p
JOIN hits USING (verse_id) JOIN works w ON w.title_slug = p.work_slug
WHERE field = 'content' AND term IN ('the', 'and') GROUP BY ALL""",
)
def search_two_terms_per_work(spark, sf_dir):
    """How often, and in which works, do two terms occur in verses that hold both?"""
    hits = _hits(spark, sf_dir)
    frequencies = S.matched_frequencies(hits)
    per_work = S.matches_per_work(frequencies, A.works(spark, sf_dir))
    return per_work.select("work_slug", "work", "matches").orderBy(F.desc("matches"), "work_slug")


@query(
    "search_two_terms_per_term", "A2 O4",
    with_(VERSES, POSTINGS, _HITS) + """
SELECT term, CAST(sum(tf) AS BIGINT) AS matches FROM postings JOIN hits USING (verse_id)
WHERE field = 'content' AND term IN ('the', 'and') GROUP BY term""",
)
def search_two_terms_per_term(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return (
        S.matches_per_term(S.matched_frequencies(hits)).select("term", "matches").orderBy(F.desc("matches"), "term")
    )


@query(
    "search_totals", "A1 O8 O5",
    with_(VERSES, POSTINGS, _HITS) + """
SELECT CAST(1 AS BIGINT) AS query_id, CAST(sum(tf) AS BIGINT) AS matches, count(DISTINCT verse_id) AS results
FROM postings JOIN hits USING (verse_id) WHERE field = 'content' AND term IN ('the', 'and')""",
)
def search_totals(spark, sf_dir):
    """Totals over every verse that is hit."""
    return S.total_matches(S.matched_frequencies(_hits(spark, sf_dir)))


@query(
    "search_totals_both_fields", "A1",
    with_(VERSES, POSTINGS, _HITS) + """
SELECT CAST(1 AS BIGINT) AS query_id, CAST(sum(tf) AS BIGINT) AS matches, count(DISTINCT verse_id) AS results
FROM postings JOIN hits USING (verse_id) WHERE term IN ('the', 'and')""",
)
def search_totals_both_fields(spark, sf_dir):
    """Matched terms counted in the content and the accent-free field, as the original report does."""
    terms = _terms(spark, TWO_TERMS)
    both = terms.unionByName(terms.withColumn("field", F.lit("no_diacritics")))
    # Only entries of the terms asked for; stored, since hits and totals both read them.
    counts = cut_lineage(_counts(spark, sf_dir, ("content", "no_diacritics"), both))
    hits = S.match(counts, terms)
    return S.total_matches(S.matched_frequencies(hits, counts))


@query(
    "search_or_not", "P12 P8 P9 A4 A5",
    with_(VERSES, POSTINGS) + """,
hits AS (
  SELECT 1 AS query_id, verse_id FROM postings WHERE field = 'content' AND term IN ('the', 'la')
  EXCEPT SELECT 1, verse_id FROM postings WHERE field = 'content' AND term = 'and'
  UNION ALL
  (SELECT 2, verse_id FROM postings WHERE field = 'no_diacritics' AND term = 'ete'
   INTERSECT SELECT 2, verse_id FROM postings WHERE field = 'content' AND term = 'la'
   UNION SELECT 2, verse_id FROM postings WHERE field = 'content' AND term = 'und'))
SELECT CAST(query_id AS BIGINT) AS query_id, field, term, count(*) AS verses
FROM hits JOIN postings USING (verse_id)
WHERE (query_id = 1 AND field = 'content' AND term IN ('the', 'la'))
   OR (query_id = 2 AND ((field = 'no_diacritics' AND term = 'ete') OR (field = 'content' AND term IN ('la', 'und'))))
GROUP BY ALL""",
)
def search_or_not(spark, sf_dir):
    """``(the OR la) NOT and`` and ``(no_diacritics:ete AND la) OR und`` in one job."""
    rows = [
        (1, 0, 0, False, "content", "the"), (1, 0, 0, False, "content", "la"), (1, 0, 1, True, "content", "and"),
        (2, 0, 0, False, "no_diacritics", "ete"), (2, 0, 1, False, "content", "la"),
        (2, 1, 0, False, "content", "und"),
    ]
    return S.verses_per_term(_hits(spark, sf_dir, rows, ("content", "no_diacritics")))


@query(
    "search_phrase", "P14 P13",
    with_(VERSES) + r""",
t AS (SELECT verse_id, work_slug, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (
        SELECT verse_id, work_slug, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS t FROM verses))
SELECT a.verse_id, a.work_slug, count(*) AS occurrences FROM t a JOIN t b ON a.verse_id = b.verse_id AND b.pos = a.pos + 1
JOIN t c ON c.verse_id = a.verse_id AND c.pos = a.pos + 2
WHERE a.term = 'and' AND b.term = 'the' AND c.term = 'of' GROUP BY ALL""",
)
def search_phrase(spark, sf_dir):
    clauses = S.clauses(spark, [(1, 0, 0, False, "content", "and the of")])
    terms = S.analyse_clauses(clauses, "plain").select("field", F.explode("terms").alias("term"))
    postings = P.build_postings(_docs(spark, sf_dir), ("content",), word_analyser="plain", terms=terms)
    hits = S.search(postings, clauses, word_analyser="plain")
    return hits.select("verse_id", "work_slug", F.col("matches")[0]["tf"].alias("occurrences"))


@query(
    "search_in_work_field", "P13 P15 J1 J16 A5",
    with_(VERSES) + """
SELECT CAST(1 AS BIGINT) AS query_id, count(*) AS results FROM verses
WHERE work_slug LIKE 'src1-%' AND list_contains(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'), 'the')
  AND length(content) > 0""",
)
def search_in_work_field(spark, sf_dir):
    """``work:src1 the``: a clause on the title field joined with one on the content."""
    docs = P.index_documents(A.verses(spark, sf_dir), works=A.works(spark, sf_dir))
    postings = P.build_postings(docs, ("content", "work"), word_analyser="plain")
    rows = [(1, 0, 0, False, "work", "src1"), (1, 0, 1, False, "content", "the")]
    return S.result_counts(S.search(postings, S.clauses(spark, rows), word_analyser="plain"))


@query(
    "search_hits_page", "W13 O5 F14 F28 J1 A12 F11 K1",
    with_(VERSES, POSTINGS, WORKS, _HITS) + """,
per_division AS (SELECT division_id, count(*) AS n FROM verses GROUP BY ALL),
page AS (SELECT verse_id FROM hits ORDER BY verse_id LIMIT 20 OFFSET 20)
SELECT v.verse_id, w.title AS work, v.indicator AS verse,
  '/work/' || v.work_slug || '/' || CAST(v.division_id AS VARCHAR) || CASE WHEN n > 1 THEN '/' || v.indicator ELSE '' END AS url,
  CASE WHEN n > 1 THEN CAST(v.division_id AS VARCHAR) || ':' || v.indicator ELSE CAST(v.division_id AS VARCHAR) END AS description,
  CASE WHEN regexp_extract(content, '(?s)^(.{80}[^ ]*) ', 1) <> '' THEN regexp_extract(content, '(?s)^(.{80}[^ ]*) ', 1) ELSE content END AS content_snippet
FROM verses v JOIN page USING (verse_id) JOIN per_division USING (division_id) JOIN works w ON w.title_slug = v.work_slug""",
)
def search_hits_page(spark, sf_dir):
    """Second page of the hits, shaped as a result list."""
    verses = A.verses(spark, sf_dir)
    hits = _hits(spark, sf_dir)
    shown = S.page(hits, 2, 20, chunk=A.verse_chunk()).select("verse_id")
    rows = result_rows(shown, verses, A.divisions(spark, sf_dir).withColumn("path", F.array("descriptor")), A.works(spark, sf_dir))
    return rows.select("verse_id", "work", "verse", "url", "description", "content_snippet")


@query(
    "search_many_queries", "A1 A5 P12",
    with_(VERSES, POSTINGS) + """,
firsts AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark),
need AS (SELECT query_id, count(*) AS n FROM firsts GROUP BY ALL),
hits AS (SELECT query_id, verse_id FROM firsts JOIN postings USING (term) JOIN need USING (query_id)
         WHERE field = 'content' GROUP BY query_id, verse_id, n HAVING count(*) = n)
SELECT query_id, CAST(sum(tf) AS BIGINT) AS matches, count(DISTINCT verse_id) AS results
FROM hits JOIN firsts USING (query_id) JOIN postings USING (verse_id, term) WHERE field = 'content' GROUP BY query_id""",
)
def search_many_queries(spark, sf_dir):
    """One AND of all distinct words for each benchmark item, all in one job, over the stored index."""
    words = A.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("clause", "term")
    )
    terms = (
        words.groupBy("query_id", "term")
        .agg(F.min("clause").alias("clause"))
        .select("query_id", F.lit(0).alias("branch"), "clause", F.lit(False).alias("negated"), F.lit("content").alias("field"), "term")
    )
    return S.total_matches(S.matched_frequencies(I.match_stored(spark, A.stored_index(spark, sf_dir), terms)))


@query(
    "term_vocabulary_sizes", "A4 A5",
    with_(VERSES, POSTINGS) + """
SELECT field, term, count(*) AS verses, CAST(sum(tf) AS BIGINT) AS occurrences FROM postings GROUP BY ALL""",
)
def term_vocabulary_sizes(spark, sf_dir):
    counts = _counts(spark, sf_dir, ("content", "no_diacritics"))
    return counts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("verses"), F.sum("tf").alias("occurrences"))


@query(
    "index_without_work", "K6 J13",
    with_(VERSES, POSTINGS) + """
SELECT work_slug, count(*) AS entries FROM postings WHERE field = 'content' AND work_slug NOT LIKE 'src1-%' GROUP BY ALL""",
)
def index_without_work(spark, sf_dir):
    dropped = A.works(spark, sf_dir).where(F.col("title") == "src1").select(F.col("title_slug").alias("work_slug"))
    kept = P.without_works(_counts(spark, sf_dir), dropped)
    return kept.groupBy("work_slug").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "works_missing_from_index", "J13 U4",
    with_(VERSES, POSTINGS, WORKS) + """
SELECT title_slug AS work_slug FROM works WHERE title_slug NOT IN
  (SELECT work_slug FROM postings WHERE field = 'content' AND work_slug NOT LIKE '%-fr')""",
)
def works_missing_from_index(spark, sf_dir):
    indexed = _counts(spark, sf_dir).where(~F.col("work_slug").endswith("-fr"))
    all_works = A.works(spark, sf_dir).select(F.col("title_slug").alias("work_slug"))
    return P.works_to_index(all_works, indexed)


@query(
    "reindexed_works", "K6 K5",
    with_(VERSES, POSTINGS) + """
SELECT work_slug, count(*) AS entries, CAST(sum(tf) AS BIGINT) AS occurrences FROM postings WHERE field = 'content' GROUP BY ALL""",
)
def reindexed_works(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    fresh = counts.where(F.col("work_slug").endswith("-en"))
    return P.reindex_works(counts, fresh).groupBy("work_slug").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("tf").alias("occurrences")
    )


@query(
    "search_metadata", "K2",
    with_(VERSES, POSTINGS, _HITS) + """
SELECT 'the AND and' AS query, count(DISTINCT verse_id) AS result_count, CAST(sum(tf) AS BIGINT) AS match_count
FROM postings JOIN hits USING (verse_id) WHERE field = 'content' AND term IN ('the', 'and')""",
)
def search_metadata(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return search_summary(S.total_matches(S.matched_frequencies(hits)), "the AND and").drop("query_id")


@query(
    "stored_dictionary", "K5 A4",
    with_(VERSES, POSTINGS) + """
SELECT field, term, count(*) AS verses, CAST(sum(tf) AS BIGINT) AS occurrences FROM postings GROUP BY field, term""",
)
def stored_dictionary(spark, sf_dir):
    """The dictionary beside the stored index."""
    return spark.read.parquet(f"{A.stored_index(spark, sf_dir)}/dictionary").select("field", "term", "verses", "occurrences")


def _fielded(spark: SparkSession, sf_dir: str, rows) -> DataFrame:
    """Hits of clauses on texts, sections of the document tree and works."""
    tree = with_ancestors(A.document_tree(spark, sf_dir))
    sections = tree.select(F.col("division_id").alias("verse_id"), F.col("title_slug").alias("work_slug"), section_text(F.col("path"), F.col("title_path")).alias("section"), F.col("title_slug").alias("section_id"))
    works = A.works(spark, sf_dir).select(
        F.xxhash64("title_slug").alias("verse_id"), F.col("title_slug").alias("work_slug"), F.concat("title", F.lit(","), "title_slug").alias("work"),
        F.col("title_slug").alias("work_id"), F.element_at("authors", 1).alias("author"),
    )
    return I.search_fielded(
        A.stored_index(spark, sf_dir), S.clauses(spark, rows), A.verses(spark, sf_dir).where(F.length("content") > 0), tree,
        P.build_postings(sections, I.SECTION_FIELDS), P.build_postings(works, I.WORK_FIELDS),
    )


def _fielded_sql(condition: str, term: str | None, columns: str, rest: str) -> str:
    """Verses of documents that fulfil a condition, and hold a term if one is given."""
    holds = f"AND list_contains(regexp_extract_all(lower(content), '{WORD}'), '{term}')" if term else ""
    return with_(VERSES) + f"""
SELECT CAST(1 AS BIGINT) AS query_id, {columns} FROM verses JOIN documents d ON d.doc_id = division_id
WHERE length(content) > 0 AND ({condition}) {holds} {rest}"""


@query("search_section_field", "P13 J16 A5", _fielded_sql("source = 'src3'", "the", "count(*) AS results", "HAVING count(*) > 0"))
def search_section_field(spark, sf_dir):
    """``section:src3 the``: the part and all that lies below it."""
    return S.result_counts(_fielded(spark, sf_dir, [(1, 0, 0, False, "section", "src3"), (1, 0, 1, False, "content", "the")]))


@query("search_section_phrase", "P14 P13", _fielded_sql("source = 'src3' AND lang = 'de'", "der", "work_slug, count(*) AS verses, count(DISTINCT division_id) AS sections", "GROUP BY work_slug"))
def search_section_phrase(spark, sf_dir):
    """``section:"src3 de" der``: a quoted description of a section."""
    return I.matched_works(_fielded(spark, sf_dir, [(1, 0, 0, False, "section", "src3 de"), (1, 0, 1, False, "content", "der")]))


@query("search_section_id_field", "P13 P14", _fielded_sql("source = 'src2' AND lang = 'en'", "of", "division_id, count(*) AS verses", "GROUP BY division_id"))
def search_section_id_field(spark, sf_dir):
    """``section_id:src2-en of``, with the verses of each section that is met."""
    return I.matched_sections(_fielded(spark, sf_dir, [(1, 0, 0, False, "section_id", "src2-en"), (1, 0, 1, False, "content", "of")]))


@query("search_work_id_field", "P13 J1", _fielded_sql("source = 'src1' AND lang = 'en'", "of", "count(*) AS results", "HAVING count(*) > 0"))
def search_work_id_field(spark, sf_dir):
    return S.result_counts(_fielded(spark, sf_dir, [(1, 0, 0, False, "work_id", "src1-en"), (1, 0, 1, False, "content", "of")]))


@query("search_author_field", "P13 P15 A4", _fielded_sql("source = 'src4' AND NOT (source = 'src4' AND lang = 'en')", None, "work_slug, count(*) AS verses, count(DISTINCT division_id) AS sections", "GROUP BY work_slug"))
def search_author_field(spark, sf_dir):
    """``author:"Author of src4" NOT section:"src4 en"``: no clause on a text at all."""
    return I.matched_works(_fielded(spark, sf_dir, [(1, 0, 0, False, "author", "Author of src4"), (1, 0, 1, True, "section", "src4 en")]))


@query(
    "search_sections_matched", "A4 P13",
    _fielded_sql("source IN ('src5', 'src6') AND (source, lang) NOT IN (('src5', 'de'))", None, "division_id, count(*) AS verses", "GROUP BY division_id"),
)
def search_sections_matched(spark, sf_dir):
    """``(section:src5 NOT section:"src5 de") OR section:src6``: verses of each section that is met."""
    rows = [(1, 0, 0, False, "section", "src5"), (1, 0, 1, True, "section", "src5 de"), (1, 1, 0, False, "section", "src6")]
    return I.matched_sections(_fielded(spark, sf_dir, rows))


@query(
    "search_page_of_many_queries", "W13 O5",
    with_(VERSES, POSTINGS) + """,
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark),
hits AS (SELECT DISTINCT query_id, verse_id FROM asked JOIN postings USING (term) WHERE field = 'content')
SELECT query_id, verse_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY verse_id) AS rank FROM hits) WHERE rank BETWEEN 41 AND 60""".replace(")\n,", "),"),
)
def search_page_of_many_queries(spark, sf_dir):
    """The third page of every benchmark item's hits, words OR-ed."""
    words = A.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("term")
    )
    postings = spark.read.parquet(f"{A.stored_index(spark, sf_dir)}/postings").where("field = 'content'")
    # The 60th hit of words OR-ed is among the first 60 verses of one of the words.
    first = S.first_verses(postings, words.select("term"), 60, chunk=A.verse_chunk())
    hits = first.join(words, "term").select("query_id", "verse_id").distinct()
    return S.page(hits, 3, 20, chunk=A.verse_chunk())
