"""Tab-separated corpora: lines, gaps and islands, divisions and verses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators import divisions as D
from scriptoria.operators.ordered import by_width, number_rows
from scriptoria.plans import adapter as A
from scriptoria.plans.registry import query
from scriptoria.plans.sql import GEOGRAPHY, VERSES, with_
from scriptoria.sources import bibles as R

# Line items as lines of one Bible: five orders to a book, an order is a chapter.
_BOOKS = ["Genesis", "Exodus", "Leviticus"]


def _lines(spark, sf_dir) -> DataFrame:
    """Each order is a chapter of one of three books, in order of its key; a comment line per order on top."""
    item = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    key, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    book = F.concat(F.lit("0"), F.floor(key / 5).cast("bigint") % 3)
    value = F.concat_ws(
        "\t", book, (key % 4).cast("string"), line.cast("string"), F.when(line % 2 == 0, "a").otherwise(""),
        (key * 10 + line).cast("string"), F.concat(F.lit(" text "), F.col("q").cast("bigint").cast("string"), F.lit(" ")),
    )
    verses = item.select((key * 10 + line).alias("pos"), value.alias("value"))
    comments = A.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10).alias("pos"), F.lit("#name\tSome Work [1590]").alias("value"))
    return verses.unionByName(comments).withColumn("work", F.lit("bible"))


_LINES = """items AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
lines AS (SELECT k * 10 + n AS pos, '0' || CAST((k // 5) % 3 AS VARCHAR) AS book_index, CAST(k % 4 AS VARCHAR) AS chapter,
  CAST(n AS VARCHAR) AS verse, CASE WHEN n % 2 = 0 THEN 'a' ELSE '' END AS subverse, 'text ' || CAST(CAST(trunc(q) AS BIGINT) AS VARCHAR) AS text FROM items),
named AS (SELECT *, CASE book_index WHEN '00' THEN 'Genesis' WHEN '01' THEN 'Exodus' ELSE 'Leviticus' END AS book FROM lines)"""

_ISLANDS = _LINES + """,
flagged AS (SELECT *, CASE WHEN lag(book) OVER w IS DISTINCT FROM book THEN 1 ELSE 0 END AS nb,
  CASE WHEN lag(book) OVER w IS DISTINCT FROM book OR lag(chapter) OVER w IS DISTINCT FROM chapter THEN 1 ELSE 0 END AS nc FROM named WINDOW w AS (ORDER BY pos)),
islands AS (SELECT *, sum(nb) OVER (ORDER BY pos) AS book_no, sum(nc) OVER (ORDER BY pos) AS chapter_no FROM flagged)"""


def _parsed(spark, sf_dir) -> DataFrame:
    codes = A.table(spark, sf_dir, "region").where(F.col("r_regionkey") < 3).select(
        F.concat(F.lit("0"), F.col("r_regionkey").cast("string")).alias("code"),
        F.element_at(F.array(*[F.lit(b) for b in _BOOKS]), F.col("r_regionkey").cast("int") + 1).alias("name"),
    )
    return R.with_book_names(R.parse_unbound(_lines(spark, sf_dir)), codes)


def _islands(spark, sf_dir) -> DataFrame:
    return D.book_chapter_islands(_parsed(spark, sf_dir), chunk=by_width("pos", 10_000))


@query("bible_lines", "S5 S6 J7", with_(_LINES) + "SELECT pos, book, chapter, verse, subverse, text FROM named")
def bible_lines(spark, sf_dir):
    return _parsed(spark, sf_dir).select("pos", "book", "chapter", "verse", "subverse", "text")


@query("bible_names", "S5", "SELECT o_orderkey * 10 AS pos, 'Some Work' AS name FROM orders")
def bible_names(spark, sf_dir):
    return R.unbound_names(_lines(spark, sf_dir)).select("pos", "name")


@query(
    "cited_bible_lines", "S7",
    """SELECT l_orderkey * 10 + l_linenumber AS pos, (l_linenumber % 3 + 1) || ' John' AS book, CAST(l_orderkey AS VARCHAR) AS chapter,
 CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) END AS verse, 'it’s ' || l_returnflag AS text FROM lineitem WHERE l_linestatus = 'O'""",
)
def cited_bible_lines(spark, sf_dir):
    """"2 John 7:4 TAB text" in Windows-1252 read as Latin-1; other lines are dropped."""
    line = F.col("l_linenumber")
    cited = F.concat(
        (line % 3 + 1).cast("string"), F.lit(" John "), F.col("l_orderkey").cast("string"),
        F.when(line % 2 == 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(""), F.lit("\tit\u0092s "), "l_returnflag",
    )
    lines = A.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + line).alias("pos"),
        F.when(F.col("l_linestatus") == "O", cited).otherwise("The licence of this text.").alias("value"),
    )
    return R.parse_cited_lines(lines, encoded_latin_1=True).select("pos", "book", "chapter", "verse", "text")


@query(
    "bible_islands", "W2",
    with_(_ISLANDS) + "SELECT pos, CAST(book_no AS BIGINT) AS book_no, CAST(chapter_no AS BIGINT) AS chapter_no FROM islands",
)
def bible_islands(spark, sf_dir):
    return _islands(spark, sf_dir).select("pos", "book_no", "chapter_no")


@query(
    "bible_divisions", "W1 W2",
    with_(_ISLANDS) + """,
heads AS (SELECT min(pos) AS pos, 0 AS k, any_value(book) AS descriptor, 1 AS level, book_no, NULL AS chapter_no FROM islands GROUP BY book_no
  UNION ALL SELECT min(pos), 1, any_value(chapter), 2, book_no, chapter_no FROM islands GROUP BY book_no, chapter_no),
numbered AS (SELECT *, row_number() OVER (ORDER BY pos, k) AS sequence_number FROM heads)
SELECT a.sequence_number, a.descriptor, CAST(a.level AS INTEGER) AS level, CASE WHEN a.level = 2 THEN b.sequence_number END AS parent_sequence
FROM numbered a JOIN numbered b ON a.book_no = b.book_no AND b.level = 1""",
)
def bible_divisions(spark, sf_dir):
    return D.divisions_of_islands(_islands(spark, sf_dir)).select("sequence_number", "descriptor", "level", "parent_sequence")


@query(
    "bible_verses", "W10",
    with_(_ISLANDS) + """
SELECT pos, row_number() OVER (PARTITION BY chapter_no ORDER BY pos) AS sequence_number, verse || subverse AS indicator, text AS content FROM islands""",
)
def bible_verses(spark, sf_dir):
    verses = D.verses_of_islands(_islands(spark, sf_dir), chunk=by_width("pos", 10_000))
    return verses.select("pos", "sequence_number", "indicator", "content")


@query(
    "orphan_divisions", "J23 M7",
    """SELECT c_custkey AS division_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
 UNION ALL SELECT n_nationkey + 1000000 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""",
)
def orphan_divisions(spark, sf_dir):
    """Customers without urgent orders (the verses), nations without customers."""
    divisions, verses = _customer_divisions(spark, sf_dir)
    return D.orphan_divisions(divisions, verses).select("division_id")


def _customer_divisions(spark, sf_dir):
    customers = A.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("division_id"), (F.col("c_nationkey") + 1000000).cast("bigint").alias("parent_id")
    )
    nations = A.table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1000000).cast("bigint").alias("division_id"), F.lit(None).cast("bigint").alias("parent_id")
    )
    orders = A.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    verses = orders.select(F.col("o_custkey").alias("division_id"))
    return customers.unionByName(nations), verses


@query(
    "readable_divisions", "W16 V7",
    """SELECT c_custkey AS division_id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS readable_unit FROM customer
 UNION ALL SELECT n_nationkey + 1000000, false FROM nation""",
)
def readable_divisions(spark, sf_dir):
    divisions, verses = _customer_divisions(spark, sf_dir)
    nations = divisions.where(F.col("parent_id").isNull()).select("division_id")
    return D.mark_readable(divisions, verses.unionByName(nations), leaves_only=True).select("division_id", "readable_unit")


@query(
    "default_descriptors", "W9",
    """SELECT doc_id, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS VARCHAR) AS descriptor FROM documents""",
)
def default_descriptors(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").alias("sequence_number"), F.col("source").alias("file"), F.col("lang").alias("level"), F.lit(None).cast("string").alias("descriptor")
    )
    return D.default_descriptors(docs).select("doc_id", "descriptor")


@query(
    "parents_by_level", "W8",
    with_(GEOGRAPHY) + """
SELECT g.division_id, p.sequence_number AS parent_order FROM geography g LEFT JOIN geography p ON g.parent_id = p.division_id""",
)
def parents_by_level(spark, sf_dir):
    """The tree's parents found again from levels and order alone."""
    tree = A.numbered_geography(spark, sf_dir).drop("parent_id")
    return D.parents_by_level(tree, "work_slug", "sequence_number").select("division_id", "parent_order")


@query(
    "verse_sequence_numbers", "W10 A12",
    with_(VERSES) + """
SELECT verse_id, row_number() OVER (PARTITION BY division_id ORDER BY verse_id) AS n, count(*) OVER (PARTITION BY division_id) AS in_division FROM verses""",
)
def verse_sequence_numbers(spark, sf_dir):
    verses = A.verses(spark, sf_dir).select("verse_id", "division_id")
    return number_rows(verses, ["division_id"], "verse_id", "n", chunk=by_width("verse_id"), total="in_division").select("verse_id", "n", "in_division")
