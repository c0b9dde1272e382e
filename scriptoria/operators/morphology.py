"""Word forms, analyses and lemmas: typed attributes, look-up with fallbacks, related forms."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.functions.betacode import beta_to_unicode
from scriptoria.functions.normalize import lookup_key, normalize, strip_accents
from scriptoria.operators.ordered import first_per_key
from scriptoria.session import cut_lineage, few_rows, merged

# --- fixed values: attribute words of the analyses ----------------------------
CASES = {"nom": "nominative", "voc": "vocative", "acc": "accusative", "dat": "dative", "gen": "genitive"}
TENSES = {
    "aor": "aorist", "pres": "present", "imperf": "imperfect", "fut": "future", "perf": "perfect",
    "futperf": "future perfect", "plup": "pluperfect",
}
NUMBERS = {"sg": 0, "dual": 1, "pl": 2}
PERSONS = {"1st": 1, "2nd": 2, "3rd": 3}
MOODS = {
    "subj": "subjunctive", "ind": "indicative", "imperat": "imperative", "opt": "optative",
    "interrog": "interrogative",
}
VOICES = {"act": 0, "mid": 1, "pass": 2, "pasj": 2, "mp": 3}
CLITICS = {"proclitic": 0, "enclitic": 1}
DIALECTS = ["attic", "doric", "aeolic", "epic", "ionic", "homeric", "parad_form", "prose"]
GENDERS = {"masc": "masculine", "fem": "feminine", "neut": "neuter"}
SUPERLATIVES = {"superl": 0, "irreg_superl": 1}
COMPARATIVES = {"comp": 0, "irreg_comp": 1}
FLAGS = {
    "infinitive": ["inf"], "participle": ["part"], "indeclinable": ["indeclform", "indecl"],
    "particle": ["particle"], "expletive": ["expletive"], "poetic": ["poetic"], "movable_nu": ["nu_movable"],
    "numeral": ["numeral"], "geog_name": ["geog_name"],
}
WITHOUT_EFFECT = ["a_priv", "exclam", "iota_intens", "contr", "alphabetic"]
NOUN, VERB, ADVERB, PREPOSITION, CONJUNCTION = 0, 1, 2, 5, 6
PART_OF_SPEECH_WORDS = {
    NOUN: [*GENDERS, *CASES], VERB: [*TENSES, *MOODS, *VOICES, "inf"], ADVERB: ["adverb", "adverbial"],
    PREPOSITION: ["prep"], CONJUNCTION: ["conj"],
}
# Short forms of the analysis label.
SHORT_TENSE = {
    "present": "pres", "imperfect": "impf", "aorist": "aor", "future": "fut", "perfect": "perf",
    "future perfect": "futperf", "pluperfect": "plup",
}
SHORT_MOOD = {
    "indicative": "ind", "imperative": "imperat", "subjunctive": "subj", "optative": "opt",
    "interrogative": "interrog",
}
SHORT_VOICE = {0: "act", 1: "mid", 2: "pass", 3: "mid-pass"}
SHORT_PERSON = {1: "1st", 2: "2nd", 3: "3rd"}
SHORT_NUMBER = {0: "sg", 1: "Dual", 2: "pl"}
SHORT_GENDER = {"masculine": "masc", "feminine": "fem", "neuter": "nuet"}
# ------------------------------------------------------------------------------


def _lookup(mapping: dict, key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, key)


def _last_mapped(attrs: Column, mapping: dict) -> Column:
    """Value of the last attribute the mapping knows (a later one overwrites)."""
    known = F.array(*[F.lit(k) for k in mapping])
    return _lookup(mapping, F.get(F.reverse(F.filter(attrs, lambda a: F.array_contains(known, a))), F.lit(0)))


def _any_of(attrs: Column, words: list[str]) -> Column:
    return F.when(F.arrays_overlap(attrs, F.array(*[F.lit(w) for w in words])), F.lit(True))


def attribute_words(details: Column) -> Column:
    return F.regexp_extract_all(details, F.lit("[a-zA-Z0-9_]+"), F.lit(0))


def attribute_columns(attrs: Column) -> dict[str, Column]:
    """Typed columns of a word description; three-valued flags stay NULL when not named."""
    pos_of_word = {w: pos for pos, words in PART_OF_SPEECH_WORDS.items() for w in words}
    pos_words = F.array(*[F.lit(w) for w in pos_of_word])
    pos_values = F.transform(
        F.filter(attrs, lambda a: F.array_contains(pos_words, a)), lambda a: _lookup(pos_of_word, a)
    )
    first = F.get(pos_values, F.lit(0))
    case_words = F.array(*[F.lit(c) for c in CASES])
    dialects = F.array(*[F.lit(d) for d in DIALECTS])
    known = [
        *CASES, *TENSES, *NUMBERS, *PERSONS, *MOODS, *VOICES, *CLITICS, *DIALECTS, *GENDERS, *SUPERLATIVES,
        *COMPARATIVES, *[w for words in FLAGS.values() for w in words], *WITHOUT_EFFECT, *pos_of_word,
    ]
    return {
        **{name: F.coalesce(_any_of(attrs, [word]), F.lit(False)) for word, name in GENDERS.items()},
        "number": _last_mapped(attrs, NUMBERS),
        "person": _last_mapped(attrs, PERSONS),
        "tense": _last_mapped(attrs, TENSES),
        "mood": _last_mapped(attrs, MOODS),
        "voice": _last_mapped(attrs, VOICES),
        "clitic": _last_mapped(attrs, CLITICS),
        "superlative": _last_mapped(attrs, SUPERLATIVES),
        "comparative": _last_mapped(attrs, COMPARATIVES),
        **{name: _any_of(attrs, words) for name, words in FLAGS.items()},
        "part_of_speech": first,
        "cases": F.array_distinct(
            F.transform(F.filter(attrs, lambda a: F.array_contains(case_words, a)), lambda a: _lookup(CASES, a))
        ),
        "dialects": F.array_distinct(F.filter(attrs, lambda a: F.array_contains(dialects, a))),
        "unknown_words": F.array_except(attrs, F.array(*[F.lit(k) for k in dict.fromkeys(known)])),
        # The first part of speech wins; another one after it is a conflict, unless it is noun.
        "conflicting_part_of_speech": F.exists(pos_values, lambda p: (p != first) & (p != NOUN)),
    }


def describe_attributes(analyses: DataFrame, details: str = "details") -> DataFrame:
    """Add the typed attribute columns to analyses."""
    attrs = attribute_words(F.col(details))
    return analyses.withColumns(attribute_columns(attrs))


def analysis_label() -> Column:
    """Short lower-case label of a word description, e.g. ``pres part act masc nominative sg``."""
    genders = F.concat_ws("/", *[F.when(F.col(n), F.lit(s)) for n, s in SHORT_GENDER.items()])
    cases = F.array_join("cases", "/")
    parts = [
        F.coalesce(_lookup(SHORT_TENSE, F.col("tense")), F.col("tense")),
        F.when(F.col("participle"), "part"),
        F.when(F.col("infinitive"), "inf"),
        _lookup(SHORT_VOICE, F.col("voice")),
        F.when(genders != "", genders),
        F.when(cases != "", cases),
        F.coalesce(_lookup(SHORT_MOOD, F.col("mood")), F.col("mood")),
        _lookup(SHORT_PERSON, F.col("person")),
        _lookup(SHORT_NUMBER, F.col("number")),
        F.when(F.col("part_of_speech") == ADVERB, "adverbial"),
        F.when(F.col("indeclinable"), "indeclinable"),
    ]
    return F.lower(F.concat_ws(" ", *parts))


def unique_by(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """First row per key expression in the given order."""
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(n) for n, k in zip(names, keys)])
    return first_per_key(keyed, names, order, df.columns).drop(*names)


# Look-ups ---------------------------------------------------------------------


def word_descriptions(words: DataFrame, forms: DataFrame, descriptions: DataFrame, ignore_diacritics: bool = False) -> DataFrame:
    """Analyses of each word (column ``word``), unique by label where one is given."""
    key = "basic_form" if ignore_diacritics else "form"
    wanted = words.select("word").distinct().withColumn("__key", lookup_key(F.col("word"), ignore_diacritics))
    found = wanted.join(forms.select(F.col(key).alias("__key"), "form_id", "form"), "__key").drop("__key")
    return found.join(descriptions, "form_id")


def lemma_of(words: DataFrame, lemmas: DataFrame, ignore_diacritics: bool = False) -> DataFrame:
    """First lemma (by id) whose lexical form is the word."""
    key = "basic_lexical_form" if ignore_diacritics else "lexical_form"
    wanted = words.select("word").distinct().withColumn("__key", lookup_key(F.col("word"), ignore_diacritics))
    first = first_per_key(lemmas.select(F.col(key).alias("__key"), "lemma_id", "lexical_form"), ["__key"], ["lemma_id"], ["lexical_form"])
    ids = lemmas.groupBy(F.col(key).alias("__key")).agg(F.min("lemma_id").alias("lemma_id"))
    return wanted.join(ids, "__key").join(first, "__key").select("word", "lemma_id", "lexical_form")


def form_of(words: DataFrame, forms: DataFrame, ignore_diacritics: bool = False) -> DataFrame:
    """First stored form (by id) of the word; without diacritics the accent-free form is compared."""
    key = "basic_form" if ignore_diacritics else "form"
    wanted = words.select("word").distinct().withColumn("__key", lookup_key(F.col("word"), ignore_diacritics))
    first = forms.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct("form_id", "form")).alias("f"))
    return wanted.join(first, "__key").select("word", F.col("f.form_id").alias("form_id"), F.col("f.form").alias("form"))


def word_lemmas(words: DataFrame, forms: DataFrame, descriptions: DataFrame, ignore_diacritics: bool = False) -> DataFrame:
    """Distinct (word, lemma_id) pairs."""
    found = word_descriptions(words, forms, descriptions.select("form_id", "lemma_id"), ignore_diacritics)
    return found.select("word", "lemma_id").distinct()


def lemma_forms(forms: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Distinct (lemma_id, form_id, form): what every word of a lemma shares."""
    return descriptions.select("lemma_id", "form_id").distinct().join(forms.select("form_id", "form"), "form_id")


def related_forms(words: DataFrame, forms: DataFrame, descriptions: DataFrame, ignore_diacritics: bool = False) -> DataFrame:
    """All forms of all lemmas of each word: word, form_id, form.

    Meant for the words of queries.  For a whole vocabulary keep the two
    halves apart (``word_lemmas``, ``lemma_forms``): a lemma with many forms
    would otherwise pair every form with every other.
    """
    lemmas = word_lemmas(words, forms, descriptions, ignore_diacritics)
    return lemmas.join(lemma_forms(forms, descriptions), "lemma_id").select("word", "form_id", "form").distinct()


def lexicon_definitions(lemmas: DataFrame, entries: DataFrame, verses: DataFrame, works: DataFrame) -> DataFrame:
    """Lexicon articles of each lemma: lemma_id -> work and verse text."""
    return (
        lemmas.select("lemma_id", "lexical_form")
        .join(entries.select("lemma_id", "verse_id", "work_id"), "lemma_id")
        .join(verses.select("verse_id", F.col("original_content").alias("definition")), "verse_id")
        .join(works.select("work_id", F.col("title").alias("work_title")), "work_id")
    )


@F.pandas_udf(T.IntegerType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity in percent."""

    def ratio(a: str | None, b: str | None) -> int | None:
        if a is None or b is None:
            return None
        return int(round(difflib.SequenceMatcher(None, a, b).ratio() * 100, 0))

    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="Int32")


def parse_words(words: DataFrame, forms: DataFrame, descriptions: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Analyses of every word with four passes, the first that finds anything wins.

    Passes: exact; without diacritics; digits removed; digits removed and
    without diacritics.  Adds ignoring_diacritics, ignoring_numerals, the lemma
    and its similarity to the bare word.  Computed on distinct words.
    """
    distinct = words.select("word").distinct()
    digits = F.col("word").rlike("[0-9]")
    without_digits = normalize(F.regexp_replace("word", "[0-9]", ""))
    keyed = distinct.select(
        "word",
        lookup_key(F.col("word")).alias("k0"), lookup_key(F.col("word"), True).alias("k1"),
        F.when(digits, lookup_key(without_digits)).alias("k2"), F.when(digits, lookup_key(without_digits, True)).alias("k3"),
    )
    passes = keyed.select(
        "word",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("pass"), F.lit(i % 2 == 1).alias("bare"), F.col(f"k{i}").alias("key")) for i in range(4)])
        ).alias("p"),
    ).select("word", "p.*").where(F.col("key").isNotNull())
    stored = forms.select(
        "form_id", "form",
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("bare"), F.col("form").alias("key")),
                F.struct(F.lit(True).alias("bare"), F.col("basic_form").alias("key")),
            )
        ).alias("s"),
    ).select("form_id", "form", "s.*")
    # Keys are made in Python, so they are stored.  A vocabulary of words sorts and merges with its forms, analyses and
    # lemmas: left to its estimates, Spark collects the words in the driver.
    passes = cut_lineage(passes)
    few = few_rows(passes)
    side = (lambda df: df) if few else merged
    found = (F.broadcast(passes) if few else merged(passes)).join(side(stored), ["bare", "key"])
    first = F.min("pass").over(Window.partitionBy("word"))
    return (
        found.withColumn("__first", first)
        .where(F.col("pass") == F.col("__first"))
        .join(side(descriptions), "form_id")
        .join(side(lemmas.select("lemma_id", "lexical_form")), "lemma_id")
        .select(
            "word", "form", F.col("lexical_form").alias("lemma"), "meaning", "description",
            (F.col("pass") % 2 == 1).alias("ignoring_diacritics"), (F.col("pass") >= 2).alias("ignoring_numerals"),
            similarity(F.col("lexical_form"), strip_accents(normalize(F.col("word")))).alias("similarity"),
            F.levenshtein("lexical_form", "word").alias("edit_distance"),
        )
    )


def rank_parses(parses: DataFrame) -> DataFrame:
    """Best parses first; ties in a fixed order."""
    return parses.orderBy("word", F.desc("similarity"), "form", "lemma", "description")


# Loading ----------------------------------------------------------------------


def link_lemmas(analyses: DataFrame, lemmas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analyses joined to lemmas by reference number (lowest id wins), and those without a lemma."""
    first = lemmas.where(F.col("reference_number").isNotNull()).groupBy("reference_number").agg(F.min("lemma_id").alias("lemma_id"))
    return analyses.join(first, "reference_number"), analyses.join(first, "reference_number", "left_anti")


def index_lexicon(headwords: DataFrame, lemmas: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Lexicon entries of headwords; an unknown headword keeps a NULL lemma.

    ``headwords``: verse_id, work_id, headword (beta code).  One entry per
    lemma and verse; entries already present are left out.
    """
    greek = lookup_key(beta_to_unicode(F.col("headword")))
    first = lemmas.groupBy(F.col("lexical_form").alias("__key")).agg(F.min("lemma_id").alias("lemma_id"))
    entries = (
        headwords.withColumn("__key", greek)
        .join(first, "__key", "left")
        .groupBy("verse_id", "work_id", "lemma_id")
        .agg(F.min("headword").alias("headword"))
    )
    if existing is None:
        return entries
    known = existing.select(F.col("verse_id").alias("__v"), F.col("lemma_id").alias("__l"))
    return entries.join(
        known, (F.col("verse_id") == F.col("__v")) & F.col("lemma_id").eqNullSafe(F.col("__l")), "left_anti"
    )


def fill_lexicon_gaps(entries: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Give entries without a lemma the lemma their headword now has.

    Entries are stored: those with and without a lemma are two readers.
    """
    entries = cut_lineage(entries)
    first = lemmas.groupBy(F.col("lexical_form").alias("__key")).agg(F.min("lemma_id").alias("__found"))
    gaps = entries.where(F.col("lemma_id").isNull()).withColumn("__key", lookup_key(beta_to_unicode(F.col("headword"))))
    filled = gaps.join(first, "__key", "left").withColumn("lemma_id", F.col("__found")).drop("__key", "__found")
    return entries.where(F.col("lemma_id").isNotNull()).unionByName(filled)
