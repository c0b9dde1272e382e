"""Normalisation, beta code, tokenisers and string functions over the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import betacode as B
from scriptoria.functions import normalize as N
from scriptoria.functions import strings as X
from scriptoria.functions import tokens as K
from scriptoria.operators.export import division_payload
from scriptoria.operators.hierarchy import with_ancestors
from scriptoria.operators.highlights import stored_highlights
from scriptoria.operators.prefilter import meeting
from scriptoria.operators.search import clauses, convert_query, first_verses, page
from scriptoria.operators.stored_index import bucket_of, match_stored
from scriptoria.plans import adapter as A
from scriptoria.plans.registry import query
from scriptoria.plans.sql import PLAIN_WORD, TOKENS, VERSES, WORD, with_
from scriptoria.session import cut_lineage


def greek(x: str) -> str:
    """SQL for the beta-code reading of text without diacritic signs."""
    letters = f"translate(upper(replace({x}, 'ß', 'ss')), 'ABGDEZHQIKLMNCOPRSTUFXYW', 'αβγδεζηθικλμνξοπρστυφχψω')"
    return rf"regexp_replace({letters}, 'σ([^\p{{L}}\p{{N}}_]|$)', 'ς\1', 'g')"


@query("nfkc_text", "F1", "SELECT doc_id, text FROM documents")
def nfkc_text(spark, sf_dir):
    """Texts with ligatures and decomposed accents put in come back unchanged."""
    odd = F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("é"), F.lit("é"))
    return A.table(spark, sf_dir, "documents").select("doc_id", N.normalize(odd).alias("text"))


@query("accent_free_text", "F2 F13", "SELECT doc_id, strip_accents(text) AS plain, CASE WHEN lang <> 'en' THEN strip_accents(text) END AS plain_unless_english FROM documents")
def accent_free_text(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(
        "doc_id", N.strip_accents(F.col("text")).alias("plain"),
        N.indexed_plain_text(F.col("text"), F.col("lang"), "EN").alias("plain_unless_english"),
    )


@query("beta_code_readings", "F3", with_(TOKENS) + f"SELECT token, {greek('token')} AS greek FROM tokens")
def beta_code_readings(spark, sf_dir):
    return A.tokens(spark, sf_dir).select("token", B.beta_to_unicode(F.col("token")).alias("greek"))


@query("beta_code_round_trip", "F4", with_(TOKENS) + "SELECT token, upper(replace(token, 'ß', 'ss')) AS beta FROM tokens")
def beta_code_round_trip(spark, sf_dir):
    return A.tokens(spark, sf_dir).select(
        "token", B.unicode_to_beta(B.beta_to_unicode(F.col("token"))).alias("beta")
    )


@query(
    "final_sigmas", "F5",
    r"SELECT doc_id, regexp_replace(replace(lower(text), 's', 'σ'), 'σ([^\p{L}\p{N}_]|$)', 'ς\1', 'g') AS text FROM documents",
)
def final_sigmas(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(
        "doc_id", B.fix_final_sigma(F.replace(F.lower("text"), F.lit("s"), F.lit("σ"))).alias("text")
    )


@query(
    "text_by_language", "F6",
    f"""SELECT lang, token, CASE WHEN lang = 'de' THEN {greek('token')} ELSE token END AS converted FROM (
SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS token FROM documents)""",
)
def text_by_language(spark, sf_dir):
    """German words stand in for the Greek ones."""
    words = (
        A.texts(spark, sf_dir)
        .select("lang", F.explode(F.regexp_extract_all("text", F.lit(K.PLAIN_WORD_PATTERN), F.lit(0))).alias("token"))
        .distinct()
    )
    language = F.when(F.col("lang") == "de", "Greek").when(F.col("lang") != "fr", F.col("lang"))
    return words.select("lang", "token", B.transform_text(F.col("token"), language).alias("converted"))


_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)


@query(
    "analyser_tokens", "F7",
    rf"""
SELECT 'word' AS analyser, token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM documents) GROUP BY ALL
UNION ALL SELECT 'section', token, count(*) FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9\- ]+')) AS token FROM documents) GROUP BY ALL
UNION ALL SELECT 'standard', token, count(*) FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+(?:\.?[\p{{L}}\p{{N}}_]+)*')) AS token FROM documents)
WHERE length(token) > 1 AND token NOT IN ({_STOP}) GROUP BY ALL""",
)
def analyser_tokens(spark, sf_dir):
    text = F.col("text")
    lists = F.explode(
        F.array(
            F.struct(F.lit("word").alias("analyser"), K.word_tokens(text).alias("t")),
            F.struct(F.lit("section").alias("analyser"), K.section_tokens(text).alias("t")),
            F.struct(F.lit("standard").alias("analyser"), K.standard_tokens(text).alias("t")),
        )
    )
    return (
        A.texts(spark, sf_dir).select(lists.alias("l"))
        .select("l.analyser", F.explode("l.t").alias("token"))
        .groupBy("analyser", "token").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "text_segments", "F8",
    r"""
SELECT doc_id, true AS nothing_lost, count(*) AS segments,
  count(*) FILTER (trim(regexp_replace(s, '\s+', ' ', 'g')) <> '' AND s NOT IN (';', ',', '.', '[', ']', ':')) AS words
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\s+|[\[\],.:;]|[^\s\[\],.:;]+')) AS s FROM documents) GROUP BY doc_id""",
)
def text_segments(spark, sf_dir):
    parts = K.segments(F.col("text"))
    return A.table(spark, sf_dir, "documents").where(F.length("text") > 0).select(
        "doc_id",
        (F.array_join(parts, "") == F.col("text")).alias("nothing_lost"),
        F.size(parts).cast("bigint").alias("segments"),
        F.size(F.filter(parts, K.is_word_segment)).cast("bigint").alias("words"),
    )


@query(
    "slugs", "F9",
    r"""
SELECT conv_id, turn, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9_\s-]', '', 'g'), '^\s+|\s+$', '', 'g')), '[-\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug
FROM conversations""",
)
def slugs(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.slugify(F.col("text")).alias("slug"))


@query(
    "division_slugs", "F9",
    r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-') || '-' || lower(p_type)
  WHEN 1 THEN lower(replace(p_brand, '#', '')) ELSE CAST(p_partkey AS VARCHAR) END AS slug FROM part""",
)
def division_slugs(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    title = F.when(kind == 0, F.concat("p_name", F.lit(" *("), F.lower("p_type"), F.lit(")=")))
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", X.division_slug(title, F.when(kind == 1, F.col("p_brand")), F.col("p_partkey")).alias("slug")
    )


@query(
    "readable_slugs", "F10",
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM part""",
)
def readable_slugs(spark, sf_dir):
    slug = F.concat(F.translate("p_name", " ", "-"), F.lit("_"), F.lower("p_type"))
    return A.table(spark, sf_dir, "part").select("p_partkey", X.unslugify(slug).alias("title"))


@query(
    "text_snippets", "F11",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '(?s)^.{80}[^ ]* ') THEN regexp_extract(text, '(?s)^(.{80}[^ ]*) ', 1) ELSE text END AS snippet FROM documents""",
)
def text_snippets(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", K.snippet(F.col("text")).alias("snippet"))


@query(
    "collapsed_whitespace", "F12",
    r"""SELECT doc_id, regexp_replace(regexp_replace(t, '\n+', '', 'g'), '[\t ]+', ' ', 'g') AS one_line,
  regexp_replace(regexp_replace(t, '\n+', chr(10), 'g'), '[\t ]+', ' ', 'g') AS lines
FROM (SELECT doc_id, regexp_replace(chr(9) || '  ' || replace(text, '. ', '.   ' || chr(10) || chr(10)), '^\s+|\s+$', '', 'g') AS t FROM documents)""",
)
def collapsed_whitespace(spark, sf_dir):
    text = F.concat(F.lit("\t  "), F.replace("text", F.lit(". "), F.lit(".   \n\n")))
    return A.table(spark, sf_dir, "documents").select(
        "doc_id", X.collapse_whitespace(text).alias("one_line"), X.collapse_whitespace(text, False).alias("lines")
    )


@query(
    "line_numbers", "F22 F23 F27",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
 'ord' || l_orderkey || 'b' AS printed, 'ord' || (l_orderkey + 1) || 'b' AS next_line, 'ord' || (l_orderkey - 1) || 'b' AS previous_line,
 'lines ' || CASE WHEN l_orderkey = 0 THEN 1 ELSE l_orderkey END || '-' || (l_orderkey + l_linenumber) AS range_title,
 CAST(l_linenumber AS INTEGER) AS level FROM lineitem""",
)
def line_numbers(spark, sf_dir):
    key, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    number = X.line_number(F.concat(F.lit("ord"), key.cast("string"), F.lit("b")))
    return A.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", line.alias("l_linenumber"),
        X.format_line_number(number).alias("printed"), X.format_line_number(number, 1).alias("next_line"),
        X.format_line_number(number, -1).alias("previous_line"), X.line_range_title(key, key + line).alias("range_title"),
        X.level_from_tag(F.concat(F.lit("div"), line.cast("string"))).alias("level"),
    )


@query("clean_titles", "F24", "SELECT p_partkey, p_name AS title FROM part")
def clean_titles(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    raw = F.concat(
        F.lit("  "), "p_name",
        F.when(kind == 0, " (Greek). Machine readable text").when(kind == 1, " (English)").when(kind == 2, ".").otherwise(" (English). Machine readable text "),
    )
    return A.table(spark, sf_dir, "part").select("p_partkey", X.clean_title(raw).alias("title"))


@query("surnames", "F25", "SELECT s_suppkey, s_name AS surname FROM supplier")
def surnames(spark, sf_dir):
    kind = F.col("s_suppkey") % 4
    name = F.concat(
        F.lit("Dr. J. "), "s_name",
        F.when(kind == 0, ", Ph. D.").when(kind == 1, ", M.A., LL.D.").when(kind == 2, " Esq.").otherwise(""),
    )
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", X.person_surname(name).alias("surname"))


@query(
    "wildcard_matches", "F26",
    """SELECT p_partkey, w AS wildcard FROM part, (VALUES ('*bolt'), ('re*w*'), ('%ring')) AS t(w)
WHERE (w = '*bolt' AND p_name LIKE '%bolt%') OR (w = 're*w*' AND p_name LIKE '%re%w%')""",
)
def wildcard_matches(spark, sf_dir):
    wildcards = F.explode(F.array(F.lit("*bolt"), F.lit("re*w*"), F.lit("%ring"))).alias("wildcard")
    return (
        A.table(spark, sf_dir, "part").select("p_partkey", "p_name", wildcards)
        .where(F.rlike("p_name", X.wildcard_pattern(F.col("wildcard")))).select("p_partkey", "wildcard")
    )


@query(
    "template_filters", "P17 F30 F31 P2 P3 P4",
    """SELECT e.event_id, coalesce(t LIKE '%ic%', false) AS has, coalesce(t LIKE 'cl%', false) AS begins, coalesce(t LIKE '%ck', false) AS ends,
  event_type ILIKE '%EW%' AS has_any_case, lower(event_type) = 'view' AS equal_any_case,
  replace(event_type, 'e', '') AS removed, replace(event_type, 'i', 'II') AS replaced, event_type || ' ' AS spaced,
  'Book ' || event_type AS label
FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN event_type END AS t FROM events) e""",
)
def template_filters(spark, sf_dir):
    kind = F.col("event_type")
    maybe = F.when(F.col("event_id") % 3 != 0, kind)
    return A.table(spark, sf_dir, "events").select(
        "event_id", X.contains(maybe, "ic").alias("has"), X.starts_with(maybe, "cl").alias("begins"),
        X.ends_with(maybe, "ck").alias("ends"), X.contains_ignoring_case(kind, "EW").alias("has_any_case"),
        X.equals_ignoring_case(kind, F.lit("VIEW")).alias("equal_any_case"),
        X.remove_part(kind, "e").alias("removed"), X.replace_pair(kind, "i,II").alias("replaced"),
        X.add_space(X.add_space(kind)).alias("spaced"),
        X.repair_book_label(F.concat(F.lit("βοοκ "), F.upper(kind))).alias("label"),
    )


@query(
    "work_payloads", "F29",
    """SELECT c_custkey, CAST(to_json({'title': c_name, 'level': 3, 'ancestors': [{'title': r_name}, {'title': n_name}]}) AS VARCHAR) AS payload
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def work_payloads(spark, sf_dir):

    tree = with_ancestors(A.numbered_geography(spark, sf_dir)).where(F.col("level") == 3)
    return tree.select((F.col("division_id") - 100001).alias("c_custkey"), division_payload().alias("payload"))


@query(
    "converted_query_tokens", "F32",
    f"""SELECT item_id, array_to_string(list_transform(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> ''),
   lambda t, i: CASE i % 3 WHEN 1 THEN 'content:' || {greek('t')} WHEN 2 THEN 'author:' || t ELSE {greek('t')} END), ' ') AS query FROM benchmark""",
)
def converted_query_tokens(spark, sf_dir):
    words = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
    tokens = F.transform(
        words,
        lambda w, i: F.struct(F.when(i % 3 == 0, "content").when(i % 3 == 1, "author").alias("field"), w.alias("value")),
    )
    converted = convert_query(tokens)
    return A.table(spark, sf_dir, "benchmark").withColumn("c", converted).select(
        "item_id",
        F.array_join(F.transform("c", lambda t: F.concat(F.coalesce(F.concat(t["field"], F.lit(":")), F.lit("")), t["value"])), " ").alias("query"),
    )


def _highlights_sql(asked: str, hits: str, surround: int) -> str:
    """Hits (query_id, verse_id) of ``hits`` with the words around those ``asked`` (query_id, field, term)."""
    return with_(VERSES).rstrip() + rf""",
texts AS (
  SELECT verse_id, 'content' AS field, content AS text FROM verses WHERE length(content) > 0
  UNION ALL SELECT verse_id, 'no_diacritics', strip_accents(content) FROM verses WHERE length(content) > 0),
words AS (
  SELECT verse_id, field, unnest(w) AS word, unnest(range(len(w))) AS pos, unnest(regexp_split_to_array(text, '{PLAIN_WORD}')[:len(w)]) AS gap
  FROM (SELECT *, regexp_extract_all(text, '{PLAIN_WORD}') AS w FROM texts)),
asked AS ({asked}),
hits AS ({hits}),
found AS (SELECT query_id, verse_id, field, pos FROM hits JOIN asked USING (query_id) JOIN words w USING (verse_id, field) WHERE lower(w.word) = asked.term),
shown AS (
  SELECT query_id, w.verse_id, w.field, w.pos, w.gap, w.word, bool_or(w.pos = f.pos) AS hit
  FROM found f JOIN words w ON w.verse_id = f.verse_id AND w.field = f.field AND w.pos BETWEEN f.pos - {surround} AND f.pos + {surround} GROUP BY ALL),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY query_id, verse_id, field ORDER BY pos) AS island FROM shown),
marked AS (
  SELECT *, CASE WHEN pos = min(pos) OVER (PARTITION BY query_id, verse_id, field, island) THEN '' ELSE gap END || CASE WHEN hit THEN '<b>' || word || '</b>' ELSE word END AS piece
  FROM islands),
fragments AS (SELECT query_id, verse_id, field, island, string_agg(piece, '' ORDER BY pos) AS fragment FROM marked GROUP BY ALL)
SELECT query_id, verse_id, string_agg(fragment, '...' ORDER BY field, island) AS highlights FROM fragments GROUP BY ALL"""


_HIT_TWO_FIELDS = """SELECT CAST(1 AS BIGINT) AS query_id, verse_id FROM words WHERE field = 'content' AND lower(word) = 'la'
  INTERSECT SELECT 1, verse_id FROM words WHERE field = 'no_diacritics' AND lower(word) = 'les'"""


@query(
    "search_highlights", "F50 A3",
    _highlights_sql("SELECT CAST(1 AS BIGINT) AS query_id, 'content' AS field, 'la' AS term UNION ALL SELECT 1, 'no_diacritics', 'les'", _HIT_TWO_FIELDS, 5),
)
def search_highlights(spark, sf_dir):
    """Fragments of content and accent-free text around the matched terms of each hit, from the positions of the stored index."""
    index = A.positional_index(spark, sf_dir)
    terms = clauses(spark, [(1, 0, 0, False, "content", "la"), (1, 0, 1, False, "no_diacritics", "les")]).withColumnRenamed("text", "term")
    return stored_highlights(spark, index, match_stored(spark, index, terms))


@query(
    "highlights_of_many_queries", "F50 W13 O5",
    _highlights_sql(
        f"SELECT DISTINCT item_id AS query_id, 'content' AS field, unnest(regexp_extract_all(lower(text), '{PLAIN_WORD}')) AS term FROM benchmark",
        """SELECT query_id, verse_id FROM (
    SELECT query_id, verse_id, row_number() OVER (PARTITION BY query_id ORDER BY verse_id) AS rank FROM (
      SELECT DISTINCT query_id, verse_id FROM asked JOIN words ON words.field = asked.field AND lower(word) = term)) WHERE rank <= 5""",
        2,
    ),
)
def highlights_of_many_queries(spark, sf_dir):
    """The first five hits of every benchmark item, its words OR-ed, each with its highlights: one job for all queries."""
    index = A.positional_index(spark, sf_dir)
    words = A.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("content").alias("field"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(K.PLAIN_WORD_PATTERN), F.lit(0)))).alias("term"),
    ).withColumn("bucket", bucket_of(F.col("term")))
    postings = spark.read.parquet(f"{index}/postings").where("field = 'content'")
    # The first five hits of words OR-ed are among the first five verses of each of the words.
    first = first_verses(postings, words.select("term"), 5, chunk=A.verse_chunk())
    hits = first.join(words.select("query_id", "term"), "term").select("query_id", "verse_id").distinct()
    shown = cut_lineage(page(hits, 1, 5, chunk=A.verse_chunk()).select("query_id", "verse_id"))
    near = meeting(postings.select("field", "bucket", "term", "verse_id", "tf"), shown, "verse_id")
    met = near.join(shown.join(words, "query_id"), ["field", "bucket", "term", "verse_id"])
    matches = met.groupBy("query_id", "verse_id").agg(F.collect_list(F.struct("field", "term", "tf")).alias("matches"))
    return stored_highlights(spark, index, matches, surround=2)
