"""Explicit schemas of the library tables and of the file formats."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<int>": T.ArrayType(T.IntegerType()),
    "array<bigint>": T.ArrayType(T.LongType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _s(*fields: str) -> T.StructType:
    pairs = (field.split(" ") for field in fields)
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


AUTHORS = _s(
    "author_id bigint", "name string", "name_slug string", "first_name string", "last_name string",
    "date_born string", "date_died string", "description string", "meta_author boolean",
)
WORKS = _s(
    "work_id bigint", "title string", "title_slug string", "work_type string", "descriptor string",
    "copyright string", "date_written timestamp", "language string",
    "authors array<string>", "editors array<string>",
)
WORK_SOURCES = _s("work_id bigint", "source string", "resource string", "description string")
RELATED_WORKS = _s("work_id bigint", "related_work_id bigint", "related_levels int")
WORK_ALIASES = _s("title_slug string", "work_id bigint")
DIVISIONS = _s(
    "division_id bigint", "work_id bigint", "sequence_number bigint", "title string", "title_slug string",
    "original_title string", "subtitle string", "descriptor string", "type string", "level int",
    "original_content string", "parent_id bigint", "readable_unit boolean",
    "path array<string>", "ancestor_ids array<bigint>",
)
VERSES = _s(
    "verse_id bigint", "division_id bigint", "sequence_number bigint", "indicator string",
    "content string", "original_content string",
)
LEMMAS = _s(
    "lemma_id bigint", "lexical_form string", "basic_lexical_form string", "language string",
    "reference_number bigint",
)
WORD_FORMS = _s("form_id bigint", "form string", "basic_form string")
WORD_DESCRIPTIONS = _s(
    "desc_id bigint", "form_id bigint", "lemma_id bigint", "meaning string", "description string",
    "masculine boolean", "feminine boolean", "neuter boolean", "number int", "person int", "tense string",
    "mood string", "voice int", "part_of_speech int", "clitic int", "superlative int", "comparative int",
    "infinitive boolean", "participle boolean", "indeclinable boolean", "particle boolean",
    "expletive boolean", "poetic boolean", "movable_nu boolean", "numeral boolean", "geog_name boolean",
    "cases array<string>", "dialects array<string>",
)
LEXICON_ENTRIES = _s("verse_id bigint", "work_id bigint", "lemma_id bigint", "headword string")
WIKI_ARTICLES = _s("search string", "article string")
NOTES = _s(
    "note_id bigint", "user_id bigint", "title string", "text string", "public boolean",
    "date_created timestamp", "date_updated timestamp",
)
NOTE_REFERENCES = _s(
    "reference_id bigint", "note_id bigint", "work_id bigint", "work_title_slug string",
    "division_id bigint", "division_full_descriptor string", "verse_id bigint", "verse_indicator string",
)
POSTINGS = _s(
    "field string", "term string", "verse_id bigint", "work_slug string", "tf bigint", "positions array<int>",
)
CLAUSES = _s(
    "query_id bigint", "branch int", "clause int", "negated boolean", "field string", "text string",
)

NODES = _s(
    "file string", "node_seq bigint", "end_seq bigint", "parent_seq bigint", "depth int", "kind string",
    "tag string", "attrs map<string,string>", "text string", "error string",
)
UNBOUND_LINES = _s(
    "book_index string", "chapter string", "verse string", "subverse string", "order_by bigint", "text string",
)
BOOK_NAMES = _s("code string", "name string")
POLICY_RULES = _s(
    "author string", "editor string", "title string", "file_name string", "language string",
    "should_import boolean", "import_parameters string",
)

TABLES = {
    "authors": AUTHORS,
    "works": WORKS,
    "work_sources": WORK_SOURCES,
    "related_works": RELATED_WORKS,
    "work_aliases": WORK_ALIASES,
    "divisions": DIVISIONS,
    "verses": VERSES,
    "lemmas": LEMMAS,
    "word_forms": WORD_FORMS,
    "word_descriptions": WORD_DESCRIPTIONS,
    "lexicon_entries": LEXICON_ENTRIES,
    "wiki_articles": WIKI_ARTICLES,
    "notes": NOTES,
    "note_references": NOTE_REFERENCES,
    "postings": POSTINGS,
}
