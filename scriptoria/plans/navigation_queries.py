"""Trees, citations, reading order and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import citations as C
from scriptoria.operators import hierarchy as H
from scriptoria.operators import navigation as N
from scriptoria.operators.ordered import number_rows
from scriptoria.plans import adapter as A
from scriptoria.plans.registry import query
from scriptoria.plans.sql import DIVISIONS, GEOGRAPHY, VERSES, with_

TREE = GEOGRAPHY + """,
tree AS (
  SELECT g.*, CASE g.level WHEN 1 THEN g.descriptor WHEN 2 THEN p.descriptor || '/' || g.descriptor
                           ELSE gp.descriptor || '/' || p.descriptor || '/' || g.descriptor END AS path
  FROM geography g LEFT JOIN geography p ON g.parent_id = p.division_id
                   LEFT JOIN geography gp ON p.parent_id = gp.division_id)"""


def _tree(spark, sf_dir):
    numbered = A.numbered_geography(spark, sf_dir)
    return H.with_ancestors(numbered)


@query("tree_sequence_numbers", "W1 O1", with_(GEOGRAPHY) + "SELECT division_id, sequence_number FROM geography")
def tree_sequence_numbers(spark, sf_dir):
    return A.numbered_geography(spark, sf_dir).select("division_id", "sequence_number")


@query(
    "tree_paths", "H1 F16 F17 F15",
    with_(TREE) + """
SELECT division_id, path, replace(path, '/', ' ') AS description, type || ' ' || descriptor AS label,
       CAST(level AS INTEGER) AS depth FROM tree""",
)
def tree_paths(spark, sf_dir):
    label = H.division_label(F.col("title"), F.col("type"), F.col("descriptor"), F.col("sequence_number"))
    return _tree(spark, sf_dir).select(
        "division_id", H.path_string(F.col("path")).alias("path"), H.describe_path(F.col("path")).alias("description"),
        label.alias("label"), F.size("ancestor_ids").alias("depth"),
    )


@query(
    "tree_descendants", "H2 P15 U3",
    with_(TREE) + "SELECT division_id, level FROM tree WHERE path LIKE 'ASIA/%'",
)
def tree_descendants(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    asia = tree.where((F.col("level") == 1) & (F.col("descriptor") == "ASIA")).select(F.col("division_id").alias("root_id"))
    # Ancestor ids exploded: an equi join with the wanted roots, however many there are.
    below = tree.select("division_id", "level", F.explode("ancestor_ids").alias("root_id"))
    return below.join(asia, "root_id").where(F.col("division_id") != F.col("root_id")).select("division_id", "level")


@query(
    "section_index_texts", "F18",
    with_(TREE) + """
SELECT division_id, CASE level
  WHEN 1 THEN descriptor || ',Region ' || descriptor
  WHEN 2 THEN replace(path, '/', ' ') || ',Region ' || split_part(path, '/', 1) || ' Nation ' || split_part(path, '/', 2)
       || ',' || split_part(path, '/', 1) || ',Region ' || split_part(path, '/', 1)
  ELSE replace(path, '/', ' ') || ',Region ' || split_part(path, '/', 1) || ' Nation ' || split_part(path, '/', 2) || ' Customer ' || split_part(path, '/', 3)
       || ',' || split_part(path, '/', 1) || ' ' || split_part(path, '/', 2)
       || ',Region ' || split_part(path, '/', 1) || ' Nation ' || split_part(path, '/', 2)
       || ',' || split_part(path, '/', 1) || ',Region ' || split_part(path, '/', 1) END AS section FROM tree""",
)
def section_index_texts(spark, sf_dir):
    return _tree(spark, sf_dir).select("division_id", H.section_text(F.col("path"), F.col("title_path")).alias("section"))


@query(
    "numeric_descriptions", "F17 F14",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
 'Order ' || l_orderkey || '.' || l_linenumber AS description,
 l_orderkey || '.' || l_partkey || '.' || l_linenumber AS numbers,
 'Order ' || l_orderkey || ':' || l_linenumber AS with_colon FROM lineitem""",
)
def numeric_descriptions(spark, sf_dir):
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    return A.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        H.describe_path(F.array(F.lit("Order"), order, line)).alias("description"),
        H.describe_path(F.array(order, F.col("l_partkey").cast("string")), line).alias("numbers"),
        H.describe_path(F.array(F.concat(F.lit("Order "), order)), line).alias("with_colon"),
    )


@query(
    "chapter_for_division", "J10",
    with_(DIVISIONS) + """
SELECT d.division_id, (SELECT min(r.division_id) FROM divisions r
  WHERE r.work_slug = d.work_slug AND r.readable_unit AND r.sequence_number >= d.sequence_number) AS chapter_id FROM divisions d""",
)
def chapter_for_division(spark, sf_dir):
    return N.chapter_of(A.divisions(spark, sf_dir)).select("division_id", "chapter_id")


@query(
    "previous_and_next_chapter", "W3 P6",
    with_(DIVISIONS) + """
SELECT d.division_id,
  (SELECT max(r.division_id) FROM divisions r WHERE r.work_slug = d.work_slug AND r.readable_unit AND r.sequence_number < d.sequence_number) AS previous_id,
  (SELECT min(r.division_id) FROM divisions r WHERE r.work_slug = d.work_slug AND r.readable_unit AND r.sequence_number > d.sequence_number) AS next_id
FROM divisions d""",
)
def previous_and_next_chapter(spark, sf_dir):
    return N.neighbours(A.divisions(spark, sf_dir)).select("division_id", "previous_id", "next_id")


@query(
    "reading_progress", "A11 W4",
    with_(GEOGRAPHY) + """
SELECT division_id, count(*) OVER () AS total, count(*) OVER (ORDER BY sequence_number) AS completed,
  count(*) OVER () - count(*) OVER (ORDER BY sequence_number) AS remaining,
  count(*) OVER (PARTITION BY parent_id) AS total_in_book,
  count(*) OVER (PARTITION BY parent_id ORDER BY sequence_number) AS completed_in_book,
  CAST(round(100.0 * count(*) OVER (PARTITION BY parent_id ORDER BY sequence_number) / count(*) OVER (PARTITION BY parent_id)) AS BIGINT) AS percent_in_book
FROM geography WHERE readable_unit""",
)
def reading_progress(spark, sf_dir):
    chapters = A.numbered_geography(spark, sf_dir).where("readable_unit")
    return N.progress(chapters).select(
        "division_id", "total", "completed", "remaining", "total_in_book", "completed_in_book",
        F.round("percent_in_book").cast("bigint").alias("percent_in_book"),
    )


@query(
    "chapter_page_strips", "W5",
    with_(GEOGRAPHY) + """
SELECT division_id, string_agg(CAST(division_id AS VARCHAR), ',') OVER (
   PARTITION BY parent_id ORDER BY sequence_number ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS strip
FROM geography WHERE readable_unit""",
)
def chapter_page_strips(spark, sf_dir):
    chapters = A.numbered_geography(spark, sf_dir).where("readable_unit")
    return N.page_strip(chapters).select("division_id", F.array_join("strip", ",").alias("strip"))


@query(
    "first_readable_divisions", "O1 O7",
    with_(GEOGRAPHY) + "SELECT division_id, descriptor FROM geography WHERE readable_unit ORDER BY sequence_number DESC LIMIT 10",
)
def first_readable_divisions(spark, sf_dir):
    tree = A.numbered_geography(spark, sf_dir)
    return N.first_divisions(tree, 10, readable_only=True, descending=True).select("division_id", "descriptor")


_CITED = """
cited AS (SELECT c_custkey AS citation_id, lower(r_name) AS region, n_name AS nation, c_name AS customer
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _cited(spark, sf_dir):
    return (
        A.table(spark, sf_dir, "customer")
        .join(A.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


@query(
    "resolve_division_paths", "J8 J9 W15 P2",
    with_(_CITED) + """
SELECT citation_id, CASE citation_id % 3 WHEN 0 THEN citation_id + 100001 WHEN 1 THEN c_nationkey + 1001 ELSE c_nationkey + 1001 END AS division_id,
       CASE citation_id % 3 WHEN 1 THEN '12' WHEN 2 THEN NULL END AS verse
FROM cited JOIN customer ON citation_id = c_custkey""",
)
def resolve_division_paths(spark, sf_dir):
    """Paths of one, two and three parts; a last part that names no division is a verse."""
    region, nation, customer = F.lower("r_name"), F.col("n_name"), F.col("c_name")
    kind = F.col("c_custkey") % 3
    cited = _cited(spark, sf_dir).select(
        F.col("c_custkey").alias("citation_id"), F.lit("geography").alias("work_slug"),
        F.when(kind == 0, F.array(region, nation, customer))
        .when(kind == 1, F.array(region, nation, F.lit("12")))
        .otherwise(F.array(region, nation)).alias("parts"),
    )
    return C.resolve_parts(cited, _tree(spark, sf_dir), ["citation_id"])


@query(
    "resolve_citation_strings", "F20 J8 J9",
    with_(_CITED) + """
SELECT citation_id, CASE WHEN citation_id % 2 = 0 THEN citation_id + 100001 ELSE c_nationkey + 1001 END AS division_id,
       CASE WHEN citation_id % 2 = 0 THEN NULL ELSE '7' END AS verse
FROM cited JOIN customer ON citation_id = c_custkey""",
)
def resolve_citation_strings(spark, sf_dir):
    """"REGION NATION customer" and "REGION NATION:7" as text, names with blanks included."""
    cited = _cited(spark, sf_dir).select(
        F.col("c_custkey").alias("citation_id"), F.lit("geography").alias("work_slug"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(" ", "r_name", "n_name", "c_name"))
        .otherwise(F.concat(F.col("r_name"), F.lit(" "), F.col("n_name"), F.lit(":7"))).alias("reference"),
    )
    return C.resolve_citations(cited, _tree(spark, sf_dir))


_CHAIN = """chain AS (
  SELECT p_partkey AS id, p_partkey - p_partkey % 9 AS top, list_transform(range(p_partkey - p_partkey % 9, p_partkey + 1), lambda x: 'n' || x) AS path FROM part)"""


def _chain(spark, sf_dir):
    """Chains of nine divisions, one below the other."""
    key = F.col("p_partkey")
    return H.with_ancestors(
        A.table(spark, sf_dir, "part").select(
            key.alias("division_id"), F.when(key % 9 != 0, key - 1).alias("parent_id"), F.concat(F.lit("n"), key.cast("string")).alias("descriptor"),
            F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("type"), key.alias("sequence_number"), F.lit("chain").alias("work_slug"),
        )
    )


@query("deep_tree_paths", "H1 H2 F15 F16 J8", with_(_CHAIN) + "SELECT id AS division_id, array_to_string(path, '/') AS path, top AS root_id, CAST(len(path) AS INTEGER) AS depth FROM chain")
def deep_tree_paths(spark, sf_dir):
    return _chain(spark, sf_dir).select(
        "division_id", H.path_string(F.col("path")).alias("path"), F.get("ancestor_ids", F.lit(0)).alias("root_id"), F.size("ancestor_ids").alias("depth")
    )


@query(
    "deep_citations", "F20 J8 J9",
    with_(_CHAIN) + "SELECT id AS citation_id, id AS division_id, CASE WHEN id % 2 = 1 THEN '77' END AS verse FROM chain",
)
def deep_citations(spark, sf_dir):
    """Citations of up to nine parts, every second one with a verse."""
    tree = _chain(spark, sf_dir)
    path = F.array_join("path", " ")
    cited = tree.select(
        F.col("division_id").alias("citation_id"), "work_slug", F.when(F.col("division_id") % 2 == 1, F.concat(path, F.lit(":77"))).otherwise(path).alias("reference")
    )
    return C.resolve_citations(cited, tree)


_GREEK = """SELECT p_partkey AS citation_id, CASE WHEN p_partkey % 5 > 0 THEN p_partkey + 100 WHEN p_partkey % 2 = 0 THEN 11 ELSE 12 END AS division_id,
  CASE WHEN p_partkey % 5 = 0 THEN 'v' || p_partkey END AS verse FROM part"""


@query("citations_longest_match", "F20 J8 J9", _GREEK)
def citations_longest_match(spark, sf_dir):
    """Several descriptors with blanks in one citation, without a Latin letter, and one that begins as another does."""
    key = F.col("p_partkey")
    even = key % 2 == 0
    part = A.table(spark, sf_dir, "part")
    heads = part.select(F.when(even, 1).otherwise(2).alias("n")).distinct()
    null = F.lit(None).cast("string")
    rest = [null.alias("title"), null.alias("type"), F.lit("greek").alias("work_slug")]
    books = heads.select(F.col("n").cast("bigint").alias("division_id"), F.lit(None).cast("bigint").alias("parent_id"), F.when(F.col("n") == 1, "α β").otherwise("α β ζ").alias("descriptor"), F.col("n").cast("bigint").alias("sequence_number"), *rest)
    chapters = heads.select((F.col("n") + 10).cast("bigint").alias("division_id"), F.col("n").cast("bigint").alias("parent_id"), F.lit("γ δ. ε").alias("descriptor"), (F.col("n") + 10).cast("bigint").alias("sequence_number"), *rest)
    leaves = part.select((key + 100).alias("division_id"), F.when(even, 11).otherwise(12).cast("bigint").alias("parent_id"), key.cast("string").alias("descriptor"), (key + 100).alias("sequence_number"), *rest)
    head = F.when(even, "α β γ δ. ε").otherwise("α β ζ γ δ. ε")
    cited = part.select(key.alias("citation_id"), F.lit("greek").alias("work_slug"), F.when(key % 5 == 0, F.concat(head, F.lit(":v"), key.cast("string"))).otherwise(F.concat(head, F.lit(" "), key.cast("string"))).alias("reference"))
    return C.resolve_citations(cited, H.with_ancestors(books.unionByName(chapters).unionByName(leaves)))


@query(
    "book_number_styles", "F19",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n,
 CASE l_linenumber WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' ELSE CAST(l_linenumber AS VARCHAR) END || ' Kings' AS lettered,
 l_linenumber || ' Kings' AS numbered FROM lineitem GROUP BY ALL""",
)
def book_number_styles(spark, sf_dir):
    name = F.concat(F.col("l_linenumber").cast("string"), F.lit(" Kings"))
    rows = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "n",
        C.to_lettered(name).alias("lettered"), C.to_numbered(C.to_lettered(name)).alias("numbered"),
    )


@query(
    "citation_ranges", "F21",
    """SELECT o_orderkey, unnest(['1:1', '2:' || (o_orderkey % 50), o_orderstatus || ' 3']) AS reference FROM orders""",
)
def citation_ranges(spark, sf_dir):
    text = F.concat(
        F.lit("1:1-4, 2:"), (F.col("o_orderkey") % 50).cast("string"), F.lit("-60 ,"), F.col("o_orderstatus"), F.lit(" 3")
    )
    orders = A.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.explode(C.split_reference_list(text)).alias("r")).select(
        "o_orderkey", C.strip_verse_range(F.col("r")).alias("reference")
    )


@query(
    "passage_texts", "J27 J19 J9",
    with_(DIVISIONS, VERSES) + """,
c AS (SELECT d.division_id AS citation_id, (SELECT min(r.division_id) FROM divisions r
  WHERE r.work_slug = d.work_slug AND r.readable_unit AND r.sequence_number >= d.sequence_number) AS chapter_id FROM divisions d)
SELECT citation_id, verse_id FROM c JOIN verses v ON v.division_id = chapter_id
WHERE citation_id % 2 = 0 OR indicator = '1'""",
)
def passage_texts(spark, sf_dir):
    """Each document cited by its slug alias; odd ones cite verse 1 only."""
    divisions = A.divisions(spark, sf_dir)
    aliases = A.works(spark, sf_dir).select(F.concat(F.lit("alias-"), "title_slug").alias("alias"), F.col("title_slug").alias("work_slug"))
    cited = divisions.select(
        F.col("division_id").alias("citation_id"), F.concat(F.lit("alias-"), "work_slug").alias("alias"),
        F.when(F.col("division_id") % 2 == 0, F.array("descriptor")).otherwise(F.array("descriptor", F.lit("1"))).alias("parts"),
    ).join(aliases, "alias")
    resolved = C.resolve_parts(cited, divisions.withColumn("path", F.array("descriptor")), ["citation_id"])
    text = N.passage_text(resolved, N.chapter_of(divisions), A.verses(spark, sf_dir))
    return text.select("citation_id", "verse_id")


@query(
    "related_works_with_section", "J12",
    with_(DIVISIONS) + """,
pos AS (SELECT division_id, work_slug, row_number() OVER (PARTITION BY work_slug ORDER BY division_id) AS n FROM divisions),
r AS (SELECT DISTINCT a.work_slug, b.work_slug AS related_slug FROM pos a JOIN pos b
      ON split_part(a.work_slug, '-', 1) = split_part(b.work_slug, '-', 1) AND a.work_slug <> b.work_slug)
SELECT a.division_id, r.related_slug FROM pos a JOIN r USING (work_slug) JOIN pos b ON b.work_slug = r.related_slug AND b.n = a.n""",
)
def related_works_with_section(spark, sf_dir):
    """Divisions numbered inside their work; translations of the same title that have the same number."""
    numbered = number_rows(A.divisions(spark, sf_dir), ["work_slug"], "sequence_number", "n").withColumn(
        "path", F.array(F.col("n").cast("string"))
    )
    slugs = A.works(spark, sf_dir).select("title", F.col("title_slug").alias("work_slug"))
    related = (
        slugs.join(slugs.select("title", F.col("work_slug").alias("related_slug")), "title")
        .where(F.col("work_slug") != F.col("related_slug"))
        .select("work_slug", "related_slug")
    )
    return N.related_with_section(related, numbered, numbered).select("division_id", "related_slug")
