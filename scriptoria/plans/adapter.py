"""Library tables over the driver's test tables (works, divisions, verses, forms, notes ...)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions.normalize import strip_accents
from scriptoria.functions.tokens import plain_tokens, word_tokens
from scriptoria.session import shared_folder, spread

# A verse id is the document id followed by 26 bits of line number.
LINE_BITS = 26
LINES_PER_DOCUMENT = 1 << LINE_BITS
# Chunk of verse ids for ordered operators: the lines of 1024 documents.
VERSE_CHUNK_BITS = LINE_BITS + 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for work on every text."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def dealt(df: DataFrame) -> DataFrame:
    """A small table whose rows are slow to work on, dealt out: its scan is one task or two, also on a cluster."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def work_slug() -> Column:
    return F.concat("source", F.lit("-"), "lang")


def verse_chunk(verse_id: Column | str = "verse_id") -> Column:
    verse_id = F.col(verse_id) if isinstance(verse_id, str) else verse_id
    return F.shiftright(verse_id, VERSE_CHUNK_BITS)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work per (source, lang): title is the source, the source's author wrote it."""
    return (
        table(spark, sf_dir, "documents")
        .select("source", "lang")
        .distinct()
        .select(
            F.col("source").alias("title"),
            work_slug().alias("title_slug"),
            F.col("lang").alias("language"),
            F.array(F.concat(F.lit("Author of "), "source")).alias("authors"),
            F.array(F.concat(F.lit("Editor "), "lang")).alias("editors"),
        )
    )


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat division per document; good quality makes it readable."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "source", "lang")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("division_id"),
            work_slug().alias("work_slug"),
            F.col("doc_id").alias("sequence_number"),
            F.lit(None).cast("string").alias("title"),
            F.lit("Chapter").alias("type"),
            F.col("doc_id").cast("string").alias("descriptor"),
            F.lit(1).alias("level"),
            F.lit(None).cast("bigint").alias("parent_id"),
            (F.coalesce("quality", F.lit(0)) == 1).alias("readable_unit"),
        )
    )


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verses_of(texts(spark, sf_dir))


def verses_of(documents: DataFrame) -> DataFrame:
    """One verse per line of a document."""
    line = F.col("line")
    return (
        documents
        .select("doc_id", "lang", work_slug().alias("work_slug"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
        .select(
            F.when(line < LINES_PER_DOCUMENT, F.shiftleft(F.col("doc_id"), LINE_BITS) + line)
            .otherwise(F.raise_error(F.lit("document with too many lines")).cast("bigint"))
            .alias("verse_id"),
            F.col("doc_id").alias("division_id"),
            (line + 1).cast("bigint").alias("sequence_number"),
            (line + 1).cast("string").alias("indicator"),
            "work_slug",
            F.col("lang").alias("language"),
            "content",
        )
    )


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A division tree of three levels: region, nation, customer; customers are readable.

    ``sort_key`` orders the tree in document order.
    """
    region = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).cast("bigint").alias("division_id"),
        F.lit(None).cast("bigint").alias("parent_id"),
        F.col("r_name").alias("descriptor"),
        F.lit("Region").alias("type"),
        F.lit(1).alias("level"),
        F.lit(False).alias("readable_unit"),
        F.struct(F.col("r_regionkey").cast("bigint").alias("a"), F.lit(-1).cast("bigint").alias("b"), F.lit(-1).cast("bigint").alias("c")).alias("sort_key"),
    )
    nation_rows = table(spark, sf_dir, "nation")
    nation = nation_rows.select(
        (F.col("n_nationkey") + 1001).cast("bigint").alias("division_id"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("parent_id"),
        F.col("n_name").alias("descriptor"),
        F.lit("Nation").alias("type"),
        F.lit(2).alias("level"),
        F.lit(False).alias("readable_unit"),
        F.struct(F.col("n_regionkey").cast("bigint").alias("a"), F.col("n_nationkey").cast("bigint").alias("b"), F.lit(-1).cast("bigint").alias("c")).alias("sort_key"),
    )
    customer = (
        table(spark, sf_dir, "customer")
        .join(nation_rows.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            (F.col("c_custkey") + 100001).alias("division_id"),
            (F.col("c_nationkey") + 1001).cast("bigint").alias("parent_id"),
            F.col("c_name").alias("descriptor"),
            F.lit("Customer").alias("type"),
            F.lit(3).alias("level"),
            F.lit(True).alias("readable_unit"),
            F.struct(F.col("n_regionkey").cast("bigint").alias("a"), F.col("c_nationkey").cast("bigint").alias("b"), F.col("c_custkey").alias("c")).alias("sort_key"),
        )
    )
    return (
        region.unionByName(nation)
        .unionByName(customer)
        .select("*", F.lit("geography").alias("work_slug"), F.lit(None).cast("string").alias("title"))
    )


def numbered_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with its sequence numbers; chunks are the nations."""
    from scriptoria.operators.ordered import number_rows

    tree = geography(spark, sf_dir)
    chunk = F.struct("sort_key.a", "sort_key.b")
    return number_rows(tree, ["work_slug"], "sort_key", "sequence_number", chunk=chunk)


def tokens(spark: SparkSession, sf_dir: str, pattern: str = "plain") -> DataFrame:
    """Distinct lower-case tokens of the documents."""
    tokenise = plain_tokens if pattern == "plain" else word_tokens
    return texts(spark, sf_dir).select(F.explode(tokenise(F.col("text"))).alias("token")).distinct()


def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select(
        F.xxhash64("token").alias("form_id"),
        F.col("token").alias("form"),
        strip_accents(F.col("token")).alias("basic_form"),
    )


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accent-free tokens are the lemmas."""
    return lemmas_of(word_forms(spark, sf_dir))


def lemmas_of(forms: DataFrame) -> DataFrame:
    return (
        forms.select(F.col("basic_form").alias("lexical_form"))
        .distinct()
        .select(F.xxhash64("lexical_form").alias("lemma_id"), "lexical_form", F.col("lexical_form").alias("basic_lexical_form"), F.lit("Latin").alias("language"))
    )


def word_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form is analysed once, under its accent-free lemma."""
    return descriptions_of(word_forms(spark, sf_dir))


def descriptions_of(forms: DataFrame) -> DataFrame:
    return forms.select(
        "form_id", F.xxhash64("basic_form").alias("lemma_id"), F.concat(F.lit("form of "), "basic_form").alias("meaning"),
        F.when(F.col("form") == F.col("basic_form"), "plain").otherwise("accented").alias("description"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes of users."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("note_id"),
        "user_id",
        F.col("event_type").alias("title"),
        F.concat(F.lit("value "), F.floor("value").cast("bigint").cast("string")).alias("text"),
    )


def note_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event refers to the document and line its ``props`` name."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("division_id"), work_slug().alias("work_title_slug"))
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("event_id").alias("note_id"),
            k.alias("division_id"),
            k.cast("string").alias("division_full_descriptor"),
            F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 3 + 1).cast("string")).alias("verse_indicator"),
        )
        .join(docs, "division_id")
    )


def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A division tree over the documents: source, language, document; ``position`` numbers it in document order."""
    from scriptoria.operators.ordered import by_width, number_rows

    none = lambda kind: F.lit(None).cast(kind)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    top, middle = -1 - F.crc32("source"), -(1 << 33) - F.crc32(F.concat("source", F.lit("-"), "lang"))
    source = docs.select("source").distinct().select(
        top.alias("division_id"), none("bigint").alias("parent_id"), F.col("source").alias("descriptor"), F.lit("Part").alias("type"),
        F.col("source").alias("title_slug"), F.struct("source", F.lit("").alias("lang"), F.lit(-1).cast("bigint").alias("doc_id")).alias("sort_key"),
    )
    language = docs.select("source", "lang").distinct().select(
        middle.alias("division_id"), top.alias("parent_id"), F.col("lang").alias("descriptor"), F.lit("Book").alias("type"),
        work_slug().alias("title_slug"), F.struct("source", "lang", F.lit(-1).cast("bigint").alias("doc_id")).alias("sort_key"),
    )
    document = docs.select(
        F.col("doc_id").alias("division_id"), middle.alias("parent_id"), F.col("doc_id").cast("string").alias("descriptor"), F.lit("Chapter").alias("type"),
        F.concat(work_slug(), F.lit("-"), F.col("doc_id").cast("string")).alias("title_slug"), F.struct("source", "lang", "doc_id").alias("sort_key"),
    )
    tree = source.unionByName(language).unionByName(document).withColumns({"root": F.lit(0), "title": none("string")})
    chunk = F.struct("sort_key.source", "sort_key.lang", by_width(F.col("sort_key.doc_id")).alias("c"))
    return number_rows(tree, ["root"], "sort_key", "position", chunk=chunk).withColumn("sequence_number", F.col("position")).drop("root", "sort_key")


def segments(spark: SparkSession, sf_dir: str) -> int:
    """Segments of an index of all verses."""
    from scriptoria.operators.postings import segments_for

    return segments_for(table(spark, sf_dir, "documents"), "text")


_STORED: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str, fresh: bool = False) -> str:
    """Folder of the index of all verses, written once for each application and input, or again if ``fresh``."""
    from scriptoria.operators.postings import build_term_counts, index_documents
    from scriptoria.operators.stored_index import write_index

    name = (spark.sparkContext.applicationId, sf_dir)
    if fresh or name not in _STORED:
        folder = f"{shared_folder(spark)}/stored-index-{uuid.uuid4()}"
        write_index(build_term_counts(index_documents(verses(spark, sf_dir)), parts=segments(spark, sf_dir)), folder)
        _STORED[name] = folder
    return _STORED[name]


def positional_index(spark: SparkSession, sf_dir: str) -> str:
    """Folder of an index of all verses with positions and cut texts, written once for each application and input."""
    from scriptoria.operators.highlights import segment_table, write_segments
    from scriptoria.operators.postings import build_postings, index_documents
    from scriptoria.operators.stored_index import write_index

    name = (spark.sparkContext.applicationId, sf_dir, "positions")
    if name not in _STORED:
        folder = f"{shared_folder(spark)}/positional-index-{uuid.uuid4()}"
        docs = index_documents(verses(spark, sf_dir))
        write_index(build_postings(docs, word_analyser="plain", parts=segments(spark, sf_dir)), folder)
        write_segments(segment_table(docs, word_analyser="plain"), folder)
        _STORED[name] = folder
    return _STORED[name]
