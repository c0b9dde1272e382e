"""Policy rules, transforms, slugs, related works, aliases, articles and lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators import export
from scriptoria.operators import linkage as L
from scriptoria.operators import transforms as T
from scriptoria.plans import adapter as A
from scriptoria.plans.registry import query
from scriptoria.plans.sql import DIVISIONS, VERSES, WORKS, with_
from scriptoria.plans.text_queries import greek
from scriptoria.schemas import POLICY_RULES
from scriptoria.sources.tei import import_counts

# Import rules over the parts: name is the title, brand the author, type the language.
RULES = [
    (None, None, None, "*bolt*.xml", None, False, None),
    ("Brand#1", None, '["small ring", "red widget"]', None, None, True, '{"state_set": 1}'),
    (None, "Editor 7", None, None, "ECONOMY", True, '{"state_set": 0}'),
    (None, None, "blue gear", None, None, True, None),
    (None, '["Editor 3", "Editor 4"]', None, None, None, False, None),
    (None, None, None, "*.xml", "SMALL", True, None),
]


def _files(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("file_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
        F.col("p_type").alias("language"), F.concat(F.translate("p_name", " ", "_"), F.lit(".xml")).alias("file_name"),
        F.concat(F.lit("Editor "), F.col("p_size").cast("string")).alias("editor"),
    )


def _rules(spark) -> DataFrame:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POLICY_RULES)
    rows = pd.DataFrame([(i, *r) for i, r in enumerate(RULES)], columns=["rule_pos", *POLICY_RULES.fieldNames()])
    numbered = spark.createDataFrame(rows, f"rule_pos int, {columns}")
    return T.normalise_rules(numbered)


_RULE = """CASE
  WHEN p_name LIKE '%bolt%' THEN 0
  WHEN p_brand = 'Brand#1' AND p_name IN ('small ring', 'red widget') THEN 1
  WHEN p_size = 7 AND p_type = 'ECONOMY' THEN 2
  WHEN p_name = 'blue gear' THEN 3
  WHEN p_size IN (3, 4) THEN 4
  WHEN p_type = 'SMALL' THEN 5 END"""


@query(
    "policy_first_matching_rule", "J18 P16 S12 F26",
    f"SELECT p_partkey AS file_id, CAST({_RULE} AS INTEGER) AS rule_pos, CASE WHEN {_RULE} IS NOT NULL THEN {_RULE} NOT IN (0, 4) END AS should_import FROM part",
)
def policy_first_matching_rule(spark, sf_dir):
    return T.matched_rules(_files(spark, sf_dir), _rules(spark)).select("file_id", "rule_pos", "should_import")


_PATTERNS = """WITH f AS (SELECT p_partkey AS file_id, p_name || '_' || p_partkey || '.xml' AS name FROM part),
r AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_' END || p_partkey || '.xml' AS tail, p_partkey % 4 <> 0 AS should_import FROM part)
SELECT file_id, CAST(min(pos) AS INTEGER) AS rule_pos, arg_min(should_import, pos) AS should_import FROM f JOIN r ON suffix(name, tail) GROUP BY file_id"""


def part_patterns(spark, sf_dir):
    """Files named after the parts, and a pattern for each part."""
    key, null = F.col("p_partkey"), F.lit(None).cast("string")
    part = A.table(spark, sf_dir, "part")
    files = part.select(
        key.alias("file_id"), F.concat("p_name", F.lit("_"), key.cast("string"), F.lit(".xml")).alias("file_name"), *(F.lit("x").alias(c) for c in ("author", "title", "language", "editor"))
    )
    lists = F.lit(None).cast("array<string>")
    rules = part.select(
        key.cast("int").alias("rule_pos"), null.alias("author"), lists.alias("editor"), lists.alias("title"),
        F.concat(F.when(key % 3 == 0, "*").otherwise("*_"), key.cast("string"), F.lit(".xml")).alias("file_name"), null.alias("language"), (key % 4 != 0).alias("should_import"), null.alias("import_parameters"),
    )
    return files, rules


@query("policy_pattern_rules", "J18 P16 F26", _PATTERNS)
def policy_pattern_rules(spark, sf_dir):
    """A pattern for each file: rules are filed under their rarest piece, and a file meets few of them."""
    return T.matched_rules(*part_patterns(spark, sf_dir)).select("file_id", "rule_pos", "should_import")


@query(
    "transform_many_arguments", "M5 M6",
    """SELECT p_partkey AS division_id, CASE p_partkey % 4 WHEN 0 THEN 'T' || p_partkey WHEN 1 THEN 'T' || p_partkey END AS title, p_partkey % 4 >= 2 AS readable_unit FROM part""",
)
def transform_many_arguments(spark, sf_dir):
    """An argument for each division of one work; arguments differ in the keys they give."""
    key, null = F.col("p_partkey"), F.lit(None)
    part, text = A.table(spark, sf_dir, "part"), key.cast("string")
    slug = F.concat(F.lit("d-"), text)
    divisions = part.select(
        F.lit(1).cast("bigint").alias("work_id"), key.alias("division_id"), null.cast("bigint").alias("parent_id"), null.cast("string").alias("title"), slug.alias("title_slug"),
        text.alias("descriptor"), key.alias("sequence_number"), F.lit("Chapter").alias("type"), F.lit(1).alias("level"), F.lit(False).alias("readable_unit"),
    )
    own = [key.alias("argument_id"), F.lit(1).cast("bigint").alias("work_id")]
    titles = part.where(key % 4 < 2).select(
        *own, F.when(key % 4 == 0, slug).alias("existing_title_slug"), null.cast("string").alias("existing_parent_slug"), F.when(key % 4 == 1, key).alias("existing_sequence_number"),
        F.concat(F.lit("T"), text).alias("title"), null.cast("string").alias("title_slug"), null.cast("string").alias("descriptor"),
    )
    readable = part.where(key % 4 >= 2).select(
        *own, F.when(key % 4 == 2, key).alias("sequence_number"), F.when(key % 8 == 3, slug).alias("title_slug"), F.when(key % 8 == 3, "Chapter").alias("type"), F.when(key % 8 == 7, text).alias("descriptor"),
        F.when(key % 8 == 7, 1).alias("level"), F.lit(True).alias("readable"),
    )
    done = T.run_transforms({"divisions": divisions}, [("set_division_title", titles), ("set_division_readable", readable)])
    return done["divisions"].select("division_id", "title", "readable_unit")


@query(
    "corpus_index", "K4 J18 P16",
    f"SELECT p_name AS title, p_brand AS author, p_type AS language, replace(p_name, ' ', '_') || '.xml' AS file, 'Editor ' || p_size AS editor FROM part WHERE {_RULE} IN (1, 2, 3, 5)",
)
def corpus_index(spark, sf_dir):
    return export.corpus_index(_files(spark, sf_dir), _rules(spark))


@query(
    "imported_and_failed_files", "A13 S1",
    """SELECT p_type AS folder, count(*) FILTER (p_size % 7 <> 0) AS imported, count(*) FILTER (p_size % 7 = 0) AS failed FROM part GROUP BY ALL""",
)
def imported_and_failed_files(spark, sf_dir):
    files = A.table(spark, sf_dir, "part").select(F.col("p_type").alias("folder"), F.when(F.col("p_size") % 7 == 0, "not well formed").alias("error"))
    return import_counts(files, ["folder"])


@query(
    "work_slug_collisions", "W14",
    r"""WITH b AS (SELECT p_partkey AS work_id, replace(p_name, ' ', '-') AS base FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY work_id) AS r FROM b),
old AS (SELECT DISTINCT replace(p_name, ' ', '-') || '-' || p_size AS title_slug FROM part WHERE p_size % 2 = 0),
taken AS (SELECT regexp_extract(title_slug, '^(.*)-([0-9]+)$', 1) AS base, CAST(regexp_extract(title_slug, '^(.*)-([0-9]+)$', 2) AS BIGINT) AS s FROM old),
free AS (SELECT base, s, row_number() OVER (PARTITION BY base ORDER BY s) AS r FROM (
  SELECT base, unnest(range(0, (SELECT count(*) FROM part) + 100)) AS s FROM (SELECT DISTINCT base FROM b)) f ANTI JOIN taken t USING (base, s))
SELECT work_id, base || CASE WHEN s = 0 THEN '' ELSE '-' || s END AS title_slug, s > 0 AS slug_was_taken FROM r JOIN free USING (base, r)""",
)
def work_slug_collisions(spark, sf_dir):
    """All parts are new works; slugs with the even sizes already exist."""
    part = A.table(spark, sf_dir, "part")
    new = part.select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"))
    size = F.col("p_size")
    old = part.where(size % 2 == 0).select(F.concat(F.translate("p_name", " ", "-"), F.lit("-"), size.cast("string")).alias("title_slug")).distinct()
    return T.assign_slugs(new, old, width=64).select("work_id", "title_slug", "slug_was_taken")


def _library(spark, sf_dir) -> T.Library:
    works = A.works(spark, sf_dir).select(F.xxhash64("title_slug").alias("work_id"), "*")
    ids = works.select(F.col("title_slug").alias("work_slug"), "work_id")
    divisions = A.divisions(spark, sf_dir).join(ids, "work_slug").withColumns(
        {"title_slug": F.concat(F.lit("d-"), F.col("descriptor")), "title": F.lit(None).cast("string")}
    )
    return {
        "works": works,
        "divisions": divisions,
        "verses": A.verses(spark, sf_dir),
        "work_types": A.table(spark, sf_dir, "region").select(F.col("r_name").alias("title")),
        "wiki_articles": A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("search"), F.concat(F.lit("On "), "n_name").alias("article")),
        "related_works": works.select("work_id", F.col("work_id").alias("related_work_id")).where(F.lit(False)),
    }


@query(
    "transform_meta_data", "M1 X5",
    with_(WORKS) + "SELECT title_slug, CASE WHEN language = 'fr' THEN 'Titre ' || title ELSE title END AS title, CASE WHEN language = 'fr' THEN 'French' ELSE language END AS language FROM works",
)
def transform_meta_data(spark, sf_dir):
    library = _library(spark, sf_dir)
    arguments = library["works"].where(F.col("language") == "fr").select(
        "work_id", F.concat(F.lit("Titre "), "title").alias("title"), F.lit(None).cast("string").alias("title_slug"), F.lit("French").alias("language")
    )
    return T.run_transforms(library, [("set_meta_data", arguments)])["works"].select("title_slug", "title", "language")


@query(
    "transform_title_slugs", "M3 F25",
    with_(WORKS) + """
SELECT title_slug AS old_slug, title || '-' || language AS title_slug FROM works WHERE title IN ('src1', 'src2')
UNION ALL SELECT title_slug, title_slug FROM works WHERE title NOT IN ('src1', 'src2', 'src3')
UNION ALL SELECT title_slug, CASE WHEN language = (SELECT min(language) FROM works WHERE title = 'src3') THEN 'src3-one' ELSE title_slug END FROM works WHERE title = 'src3'""",
)
def transform_title_slugs(spark, sf_dir):
    """Slugs from the editor's surname; one explicit suffix asked for by all works of a title goes to one of them."""
    library = _library(spark, sf_dir)
    # Ids that follow the language inside a title, so the lowest id is known to SQL too.
    letters = F.ascii("language") * 256 + F.ascii(F.substring("language", 2, 1))
    ids = F.substring("title", 4, 9).cast("bigint") * 65536 + letters
    works = library["works"].withColumn("work_id", ids).withColumn("old_slug", F.col("title_slug"))
    renamed = works.withColumn(
        "title_slug", F.when(F.col("title").isin("src1", "src2"), F.concat(F.lit("old-"), "title_slug")).otherwise(F.col("title_slug"))
    )
    arguments = renamed.where(F.col("title").isin("src1", "src2", "src3")).select(
        "work_id", F.when(F.col("title") == "src3", F.array(F.lit("one"))).alias("additional_fields")
    )
    return T.run_transforms({**library, "works": renamed}, [("update_title_slug", arguments)])["works"].select("old_slug", "title_slug")


@query(
    "transform_work_types", "M4 J25",
    """SELECT title, CAST(1 AS BIGINT) AS n FROM (SELECT r_name AS title FROM region UNION SELECT 'Type ' || lang FROM documents)""",
)
def transform_work_types(spark, sf_dir):
    library = _library(spark, sf_dir)
    arguments = library["works"].select("work_id", F.concat(F.lit("Type "), "language").alias("title"))
    again = T.run_transforms(library, [("set_work_type", arguments), ("set_work_type", arguments)])
    return again["work_types"].groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query(
    "transform_wiki_articles", "M2 J17",
    """SELECT c_custkey AS topic_id, CASE WHEN n_nationkey % 2 = 0 THEN 'About ' || c_mktsegment ELSE 'On ' || n_name END AS article FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def transform_wiki_articles(spark, sf_dir):
    """Articles on market segments are added; then the first topic of a list that has an article is looked up."""
    library = _library(spark, sf_dir)
    customers = A.table(spark, sf_dir, "customer").join(A.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segments = customers.select(F.col("c_mktsegment").alias("term"), F.concat(F.lit("About "), "c_mktsegment").alias("article"))
    nations = customers.select(F.col("n_name").alias("term"), F.lit("never shown").alias("article"))
    articles = T.run_transforms(library, [("add_wiki_article", segments.unionByName(nations))])["wiki_articles"]
    topics = customers.select(
        F.col("c_custkey").alias("topic_id"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("nothing"), "c_mktsegment", "n_name")).otherwise(F.array("n_name", "c_mktsegment")).alias("terms"),
    )
    return L.first_article(topics, articles)


_RENAMED = "division_id IN (SELECT min(doc_id) FROM documents GROUP BY source, lang)"


@query(
    "transform_division_titles", "M5 M6",
    with_(DIVISIONS) + f"""
SELECT division_id, CASE WHEN {_RENAMED} THEN 'First' END AS title, descriptor, CASE WHEN {_RENAMED} THEN true ELSE readable_unit END AS readable_unit FROM divisions""",
)
def transform_division_titles(spark, sf_dir):
    library = _library(spark, sf_dir)
    first = library["divisions"].groupBy("work_id").agg(F.min("division_id").alias("argument_id"))
    null = F.lit(None).cast("string")
    titles = first.select(
        "argument_id", "work_id", F.concat(F.lit("d-"), F.col("argument_id").cast("string")).alias("existing_title_slug"), null.alias("existing_parent_slug"),
        F.col("argument_id").alias("existing_sequence_number"), F.lit("First").alias("title"), null.alias("title_slug"), null.alias("descriptor"),
    )
    readable = first.select(
        "argument_id", "work_id", F.col("argument_id").alias("sequence_number"), null.alias("title_slug"), F.lit("Chapter").alias("type"), null.alias("descriptor"),
        F.lit(1).alias("level"), F.lit(True).alias("readable"),
    )
    done = T.run_transforms(library, [("set_division_title", titles), ("set_division_readable", readable)])
    return done["divisions"].select("division_id", "title", "descriptor", "readable_unit")


@query(
    "transform_deleted_divisions", "M8 M7",
    with_(DIVISIONS, VERSES) + """
SELECT (SELECT count(*) FROM divisions WHERE NOT readable_unit) AS divisions, (SELECT count(*) FROM verses JOIN divisions USING (division_id) WHERE NOT readable_unit) AS verses""",
)
def transform_deleted_divisions(spark, sf_dir):
    """Readable divisions are deleted by slug with their verses; no orphan is left to drop."""
    library = _library(spark, sf_dir)
    gone = library["divisions"].where("readable_unit").select("work_id", "title_slug")
    every = library["works"].select("work_id")
    left = T.run_transforms(library, [("delete_divisions_by_title_slug", gone), ("delete_unnecessary_divisions", every)])
    counts = left["divisions"].select(F.lit("d").alias("kind")).unionByName(left["verses"].select(F.lit("v").alias("kind")))
    return counts.agg(F.count_if(F.col("kind") == "d").alias("divisions"), F.count_if(F.col("kind") == "v").alias("verses"))


@query(
    "transform_greek_descriptors", "M10",
    f"SELECT doc_id AS division_id, CASE WHEN lang = 'es' THEN {greek('source')} ELSE source END AS descriptor FROM documents",
)
def transform_greek_descriptors(spark, sf_dir):
    library = _library(spark, sf_dir)
    named = library["divisions"].withColumn("descriptor", F.substring_index("work_slug", "-", 1))
    spanish = library["works"].where(F.col("language") == "es").select("work_id")
    done = T.run_transforms({**library, "divisions": named}, [("convert_descriptors_from_beta_code", spanish)])
    return done["divisions"].select("division_id", "descriptor")


@query(
    "transform_related_works", "M9 U6",
    with_(WORKS) + """
SELECT a.title_slug AS slug, b.title_slug AS related_slug FROM works a JOIN works b ON a.title = b.title AND a.title_slug <> b.title_slug
WHERE a.language = 'en' OR b.language = 'en'""",
)
def transform_related_works(spark, sf_dir):
    """English works are linked to their translations, both ways."""
    library = _library(spark, sf_dir)
    works = library["works"]
    english = works.where(F.col("language") == "en").select("title", F.col("title_slug").alias("__en"))
    arguments = works.where(F.col("language") != "en").join(english, "title").select("work_id", F.col("__en").alias("title_slug"))
    linked = T.run_transforms(library, [("assign_related_work", arguments)])["related_works"]
    slugs = works.select("work_id", F.col("title_slug").alias("slug"))
    other = works.select(F.col("work_id").alias("related_work_id"), F.col("title_slug").alias("related_slug"))
    return linked.join(slugs, "work_id").join(other, "related_work_id").select("slug", "related_slug")


def _order_works(spark, sf_dir):
    """Orders as works: title and author from status and priority, editor the day; line items are divisions."""
    orders = A.table(spark, sf_dir, "orders")
    works = orders.select(
        F.col("o_orderkey").alias("work_id"), F.col("o_orderstatus").alias("title"), F.array("o_orderpriority").alias("authors"),
        F.array(F.concat(F.lit("Editor "), (F.col("o_custkey") % 50).cast("string"))).alias("editors"),
    )
    items = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("d"))
    divisions = items.select(F.col("l_orderkey").alias("work_id"), F.col("l_linenumber").cast("bigint").alias("sequence_number"), F.col("d").alias("descriptor"))
    return works, divisions


_ORDER_WORKS = """items AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS d FROM lineitem GROUP BY ALL),
lists AS (SELECT l_orderkey AS work_id, string_agg(d, ',' ORDER BY l_linenumber) AS descriptors FROM items GROUP BY ALL),
w AS (SELECT o_orderkey AS work_id, o_orderstatus AS title, o_orderpriority AS author, o_custkey % 50 AS editor, coalesce(descriptors, '') AS descriptors
      FROM orders LEFT JOIN lists ON work_id = o_orderkey)"""


@query(
    "equivalent_work_groups", "J11 A7",
    with_(_ORDER_WORKS) + """,
e AS (SELECT *, count(*) OVER (PARTITION BY title, author, editor) AS n FROM w),
d AS (SELECT *, count(*) OVER (PARTITION BY title, author, descriptors) AS n FROM w)
SELECT work_id, 'editors' AS kind, n AS members FROM e WHERE n > 1 UNION ALL SELECT work_id, 'divisions', n FROM d WHERE n > 1""",
)
def equivalent_work_groups(spark, sf_dir):
    """Memberships of the groups of equivalent works (same title and authors, and same editors or divisions)."""
    works, divisions = _order_works(spark, sf_dir)
    keyed = L.equivalence_keys(works, L.division_fingerprints(divisions))
    groups = L.equivalent_groups(keyed)
    kind = F.when(F.col("group_id").contains("+editors"), "editors").otherwise("divisions")
    return groups.select("work_id", kind.alias("kind"), "members")


@query(
    "related_works_of_wanted", "J11 U6",
    with_(_ORDER_WORKS) + """
SELECT DISTINCT a.work_id, b.work_id AS related_work_id FROM w a JOIN w b ON a.title = b.title AND a.author = b.author AND a.editor = b.editor
 AND a.descriptors = b.descriptors AND a.work_id <> b.work_id
WHERE a.work_id IN (SELECT item_id FROM benchmark)""",
)
def related_works_of_wanted(spark, sf_dir):
    """Strict equivalence, listed for the wanted works (those the benchmark table names)."""
    works, divisions = _order_works(spark, sf_dir)
    keyed = L.equivalence_keys(works, L.division_fingerprints(divisions))
    groups = L.equivalent_groups(keyed, either=False)
    return L.related_of(groups, A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("work_id")))


@query(
    "new_work_aliases", "J14 U4",
    "SELECT c_name AS title_slug, c_custkey AS work_id FROM customer WHERE c_mktsegment <> 'BUILDING'",
)
def new_work_aliases(spark, sf_dir):
    works, aliases = _alias_tables(spark, sf_dir)
    return L.new_aliases(works, aliases)


def _alias_tables(spark, sf_dir):
    customers = A.table(spark, sf_dir, "customer")
    works = customers.select(F.col("c_custkey").alias("work_id"), F.col("c_name").alias("title_slug"))
    building = customers.where(F.col("c_mktsegment") == "BUILDING")
    owner = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1)
    return works, building.select(F.col("c_name").alias("title_slug"), owner.alias("work_id"))


@query(
    "alias_conflicts", "J14 P9",
    "SELECT c_name AS title_slug, c_custkey AS work_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 1",
)
def alias_conflicts(spark, sf_dir):
    works, aliases = _alias_tables(spark, sf_dir)
    return L.alias_conflicts(works, aliases)


@query(
    "populated_aliases", "J14",
    "SELECT c_name AS title_slug, c_custkey AS work_id FROM customer",
)
def populated_aliases(spark, sf_dir):
    works, aliases = _alias_tables(spark, sf_dir)
    agreed = aliases.join(works, ["title_slug", "work_id"], "left_semi")
    return L.populate_aliases(works, agreed)


@query(
    "works_list", "O2 A8 P18 J22",
    with_(WORKS) + "SELECT title, title_slug, language, author, editor FROM works",
)
def works_list(spark, sf_dir):
    return L.works_list(A.works(spark, sf_dir))


@query("works_per_language", "A6", with_(WORKS) + "SELECT language, count(*) AS works FROM works GROUP BY language")
def works_per_language(spark, sf_dir):
    return L.works_per_language(A.works(spark, sf_dir))


@query("works_by_author", "J22", with_(WORKS) + "SELECT title_slug FROM works WHERE author = 'Author of src3'")
def works_by_author(spark, sf_dir):
    return L.works_by_author(A.works(spark, sf_dir), "Author of src3").select("title_slug")


def _authors(works: DataFrame) -> DataFrame:
    name = F.explode("authors")
    return works.select(name.alias("name")).distinct().withColumn("meta_author", F.col("name").isin("Author of src0"))


@query(
    "other_works_by_author", "J21 P18",
    with_(WORKS) + """
SELECT a.title_slug, b.title_slug AS other_slug FROM works a JOIN works b ON a.author = b.author AND a.title_slug <> b.title_slug
WHERE a.language = 'en' AND a.author <> 'Author of src0'""",
)
def other_works_by_author(spark, sf_dir):
    works = A.works(spark, sf_dir).withColumn("work_id", F.xxhash64("title_slug"))
    wanted = works.where(F.col("language") == "en")
    found = L.other_works_by_author(works, _authors(works), wanted)
    names = works.select("work_id", "title_slug")
    others = works.select(F.col("work_id").alias("other_work_id"), F.col("title_slug").alias("other_slug"))
    return found.join(names, "work_id").join(others, "other_work_id").select("title_slug", "other_slug")


@query(
    "typeahead_hints", "U1 U2",
    with_(WORKS) + """
SELECT CAST(0 AS INTEGER) AS part, title AS description, '/work/' || title_slug AS url FROM works
UNION ALL SELECT DISTINCT CAST(1 AS INTEGER), author, '' FROM works""",
)
def typeahead_hints(spark, sf_dir):
    works = A.works(spark, sf_dir)
    return L.typeahead_hints(works, works.select(F.explode("authors").alias("name")))


@query(
    "work_sheets", "J26 J17 A8",
    with_(WORKS) + """
SELECT title_slug, author, editor, CASE WHEN language = 'de' THEN 'archive' END AS source, CASE WHEN title IN ('src1', 'src5') THEN 'Article on ' || title END AS article FROM works""",
)
def work_sheets(spark, sf_dir):
    works = A.works(spark, sf_dir).withColumn("work_id", F.xxhash64("title_slug"))
    sources = works.where(F.col("language") == "de").select("work_id", F.lit("archive").alias("source"), F.lit("text").alias("description"))
    articles = works.where(F.col("title").isin("src1", "src5")).select(F.col("title").alias("search"), F.concat(F.lit("Article on "), "title").alias("article")).distinct()
    return L.work_sheet(works, sources, articles).select("title_slug", "author", "editor", "source", "article")


@query(
    "author_rows", "J25",
    """SELECT name, name IN ('Unknown', 'Various') AS meta_author FROM (SELECT n_name AS name FROM nation UNION SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'Unknown' ELSE o_orderpriority END FROM orders)""",
)
def author_rows(spark, sf_dir):
    existing = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.xxhash64("n_name").alias("author_id"), F.lit(False).alias("meta_author"))
    names = A.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("name"))
    return T.author_rows(names, existing).select("name", "meta_author")


@query(
    "works_not_yet_imported", "J13",
    with_(WORKS) + "SELECT title_slug FROM works WHERE language NOT IN ('en', 'fr')",
)
def works_not_yet_imported(spark, sf_dir):
    works = A.works(spark, sf_dir)
    return T.new_works(works, works.where(F.col("language").isin("en", "fr"))).select("title_slug")


@query(
    "replaced_works", "J20 V15",
    with_(WORKS) + "SELECT title_slug, CASE WHEN language = 'en' THEN 'new' ELSE 'old' END AS edition FROM works",
)
def replaced_works(spark, sf_dir):
    works = A.works(spark, sf_dir)
    fresh = works.where(F.col("language") == "en").withColumn("edition", F.lit("new"))
    return T.replace_works(works.withColumn("edition", F.lit("old")), fresh).select("title_slug", "edition")


@query(
    "works_of_aliases", "J19",
    with_(WORKS) + "SELECT 'alias-' || title_slug AS title_slug, title FROM works",
)
def works_of_aliases(spark, sf_dir):
    works = A.works(spark, sf_dir).withColumn("work_id", F.xxhash64("title_slug"))
    aliases = works.select(F.concat(F.lit("alias-"), "title_slug").alias("title_slug"), "work_id")
    return L.works_of_aliases(aliases.select("title_slug"), aliases, works).select("title_slug", "title")
