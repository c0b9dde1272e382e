"""Named work transforms, import policy, slugs and get-or-create rows, as DataFrame functions.

A transform takes the library tables (a dict of DataFrames) and a table of
arguments keyed by work, and returns the tables; nothing is updated in place,
and one job applies a transform to every work that asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.betacode import beta_to_unicode
from scriptoria.functions.strings import person_surname, slugify, wildcard_pattern
from scriptoria.operators.ordered import DEFAULT_WIDTH, by_width, first_per_key, running_sum
from scriptoria.session import cut_lineage, merged, small_or_merged

Library = dict[str, DataFrame]
TRANSFORMS: dict[str, Callable[[Library, DataFrame], Library]] = {}


def transform(name: str):
    def register(function):
        TRANSFORMS[name] = function
        return function

    return register


def run_transforms(library: Library, steps: Sequence[tuple[str, DataFrame]]) -> Library:
    """Apply named transforms in order; an unknown name is an error."""
    for name, arguments in steps:
        if name not in TRANSFORMS:
            raise KeyError(f"unknown transform {name}")
        library = TRANSFORMS[name](library, arguments)
    return library


# Import policy ------------------------------------------------------------------


def _as_array(value: Column) -> Column:
    """A JSON value that is a string or a list of strings, as an array; NULL stays NULL."""
    as_list = F.from_json(value, "array<string>")
    return F.when(value.isNull(), None).when(value.startswith("["), as_list).otherwise(F.array(value))


def read_policy(spark, path: str) -> DataFrame:
    """Ordered policy rules from JSON; editor and title may be a string or a list.

    The file is one JSON list, so its order is the order of ``posexplode``.
    """
    raw = spark.read.option("wholetext", True).text(path)
    entry = (
        "array<struct<author string, editor string, title string, file_name string, language string, "
        "should_import boolean, import_parameters string>>"
    )
    rules = raw.select(F.posexplode(F.from_json("value", entry)).alias("rule_pos", "r")).select("rule_pos", "r.*")
    return normalise_rules(rules)


def normalise_rules(rules: DataFrame) -> DataFrame:
    return rules.select(
        "rule_pos", "author",
        _as_array(F.col("editor")).alias("editor"), _as_array(F.col("title")).alias("title"),
        "file_name", "language", F.coalesce("should_import", F.lit(True)).alias("should_import"),
        "import_parameters",
    )


# Characters of the pieces under which patterns are filed: long ones are held by few names where short ones are held by a share of all.
_PIECES = (3, 6, 12, 24, 48)
# Rules that neither an exact value nor a piece selects are looked up by every file, in so many groups of files.
_OPEN_GROUPS = 64


def _pieces(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct runs of so many characters; none of a shorter text."""
    none = F.array().cast("array<string>")

    def of_size(n: int) -> Column:
        last = F.length(text) - (n - 1)
        return F.when(last < 1, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(text, k, F.lit(n))))

    return F.array_distinct(F.concat(none, *[of_size(n) for n in sizes]))


def _rarest_pieces(files: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule_pos, __piece): the literal piece of each pattern that the fewest file names hold, none where its literals are too short;

    and (__file, __piece) of the files that hold one of these, both stored.
    """
    patterns = rules.where(F.col("file_name").contains("*")).select("rule_pos", F.explode(F.split("file_name", r"\*+")).alias("l"))
    longest = patterns.agg(F.max(F.length("l"))).first()[0] or 0
    sizes = [n for n in _PIECES if n <= longest]
    pieces = patterns.select("rule_pos", F.explode(_pieces(F.col("l"), sizes)).alias("__piece"))
    asked = merged(pieces.select("__piece").distinct())
    held = cut_lineage(files.select(F.col("file_id").alias("__file"), F.explode(_pieces(F.col("file_name"), sizes)).alias("__piece")).join(asked, "__piece", "left_semi"))
    counts = held.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    ranked = pieces.join(merged(counts), "__piece", "left").select("rule_pos", F.struct(F.coalesce("__n", F.lit(0)).alias("n"), (-F.length("__piece")).alias("l"), "__piece").alias("r"))
    rarest = cut_lineage(ranked.groupBy("rule_pos").agg(F.min("r").alias("r")).select("rule_pos", F.col("r.__piece").alias("__piece")))
    return rarest, held.join(merged(rarest.select("__piece").distinct()), "__piece", "left_semi")


def _filed_under(rules: DataFrame, pieces: DataFrame | None) -> DataFrame:
    """Each rule under the values of one column it asks for exactly, else under its rarest piece, else under every group of files."""
    pairs = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(_OPEN_GROUPS - 1)), lambda k: k.cast("string"))
    keys = (
        F.when(F.col("file_name").isNotNull() & ~F.col("file_name").contains("*"), pairs("file_name", F.array("file_name")))
        .when(F.col("title").isNotNull(), pairs("title", F.col("title")))
        .when(F.col("author").isNotNull(), pairs("author", F.array("author")))
        .when(F.col("editor").isNotNull(), pairs("editor", F.col("editor")))
        .when(F.col("language").isNotNull(), pairs("language", F.array("language")))
    )
    if pieces is None:
        keys = keys.otherwise(pairs("any", everywhere))
    else:
        rules = rules.join(merged(pieces.select(F.col("rule_pos").alias("__pos"), "__piece")), F.expr("rule_pos = __pos"), "left")
        keys = keys.when(F.col("__piece").isNotNull(), pairs("piece", F.array("__piece"))).otherwise(pairs("any", everywhere))
        rules = rules.drop("__pos")
    return rules.select(F.struct(*rules.columns).alias("__r"), F.explode(F.array_distinct(keys)).alias("__key"))


def matched_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule of each file, "drop" rules included.

    ``files``: file_id, author, title, language, file_name, editor.  A NULL
    rule column matches anything; titles and editors match any member; a file
    name with ``*`` is a pattern.  A file meets the rules that are filed under
    one of its own values or a piece of its name, and those that give neither;
    of the ones it fits the first counts.
    """
    first = tested_rules(files, rules).groupBy("file_id").agg(F.min("__rule").alias("__first"))
    return files.join(merged(first), "file_id", "left").select(*files.columns, "__first.rule_pos", "__first.should_import", "__first.import_parameters")


def tested_rules(files: DataFrame, rules: DataFrame, fitting: bool = True) -> DataFrame:
    """(file_id, __rule) of the rules that fit each file, or with ``fitting`` off of all that are tried on it."""

    def fits(want: Column, have: Column) -> Column:
        return want.isNull() | F.coalesce(want == have, F.lit(False))

    def among(want: Column, have: Column) -> Column:
        return want.isNull() | F.coalesce(F.array_contains(want, have), F.lit(False))

    own = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("file_name", "title", "author", "editor", "language")]
    group = F.pmod(F.xxhash64("file_id"), F.lit(_OPEN_GROUPS)).cast("string")
    patterns = rules.where("file_name LIKE '%*%' AND title IS NULL AND author IS NULL AND editor IS NULL AND language IS NULL")
    pieces, held = _rarest_pieces(files, patterns) if patterns.limit(1).count() else (None, None)
    keyed = files.select("file_id", F.explode(F.array(*own, F.struct(F.lit("any").alias("kind"), group.alias("value")))).alias("__key"))
    if held is not None:
        keyed = keyed.unionByName(held.select(F.col("__file").alias("file_id"), F.struct(F.lit("piece").alias("kind"), F.col("__piece").alias("value")).alias("__key")))
    r = lambda c: F.col(f"__r.{c}")
    name = F.when(
        r("file_name").contains("*"), F.coalesce(F.rlike(F.col("file_name"), wildcard_pattern(r("file_name"))), F.lit(False))
    ).otherwise(fits(r("file_name"), F.col("file_name")))
    own_columns = files.select("file_id", "author", "title", "language", "file_name", "editor")
    tried = keyed.join(small_or_merged(_filed_under(rules, pieces)), "__key").select("file_id", "__r").join(merged(own_columns), "file_id")
    fits_all = (
        fits(r("author"), F.col("author")) & among(r("editor"), F.col("editor")) & among(r("title"), F.col("title"))
        & fits(r("language"), F.col("language")) & name
    )
    rule = F.struct(r("rule_pos").alias("rule_pos"), r("should_import").alias("should_import"), r("import_parameters").alias("import_parameters"))
    return (tried.where(fits_all) if fitting else tried).select("file_id", rule.alias("__rule"))


def accepted_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files some rule accepts, with the import parameters of the first matching rule."""
    return matched_rules(files, rules).where(F.col("should_import"))


# Slugs ----------------------------------------------------------------------------


def assign_slugs(new_works: DataFrame, existing_slugs: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Slug of each new work: its base, else base-1, base-2 ..., the next free one in order of work_id.

    ``new_works``: work_id, title; ``existing_slugs``: title_slug.  Slugs that
    the other new works take as their own base count as taken.  The r-th free
    number after the taken ones t1 < t2 < ... is r plus the number of ti with
    ti - (i - 1) <= r, which is a merge of two ordered lists and works for a
    base that a third of all works share.
    """
    based = new_works.withColumn("__base", slugify(F.col("title")))
    bases = based.select(F.col("__base").alias("title_slug")).distinct()
    named = existing_slugs.select("title_slug", F.lit(True).alias("__old")).unionByName(
        bases.select("title_slug", F.lit(False).alias("__old"))
    )
    # Suffix 0 is the base itself, taken only by an existing work.
    plain = existing_slugs.select(F.col("title_slug").alias("__base"), F.lit(0).cast("bigint").alias("__suffix"))
    numbered = named.select(
        F.regexp_extract("title_slug", "^(.*)-([1-9][0-9]{0,17})$", 1).alias("__base"),
        F.expr("try_cast(regexp_extract(title_slug, '^(.*)-([1-9][0-9]{0,17})$', 2) AS bigint)").alias("__suffix"),
    ).where(F.col("__suffix").isNotNull())
    taken = (
        plain.unionByName(numbered).distinct()
        .join(bases.withColumnRenamed("title_slug", "__base"), "__base", "left_semi")
    )
    one = F.lit(1).cast("bigint")
    ranked_taken = running_sum(taken, ["__base"], "__suffix", {"__i": one}, by_width("__suffix", width))
    ranked_new = running_sum(based, ["__base"], "work_id", {"__r": one}, by_width("work_id", width))
    # Merge: a taken number sorts before a new work of the same key; ties among taken ones do not matter.
    merged = ranked_taken.select(
        "__base", ((F.col("__suffix") - F.col("__i") + 1) * 2).alias("__key"), F.col("__suffix").alias("__tie"),
        F.lit(1).cast("bigint").alias("__is_taken"), F.lit(None).cast("bigint").alias("work_id"),
    ).unionByName(
        ranked_new.select(
            "__base", ((F.col("__r") - 1) * 2 + 1).alias("__key"), F.lit(0).cast("bigint").alias("__tie"),
            F.lit(0).cast("bigint").alias("__is_taken"), "work_id",
        )
    )
    counted = running_sum(
        merged, ["__base"], ["__key", "__tie"], {"__skipped": F.col("__is_taken")}, by_width("__key", width)
    )
    number = F.floor((F.col("__key") - 1) / 2).cast("bigint") + F.col("__skipped")
    slugs = counted.where(F.col("work_id").isNotNull()).select(
        "work_id",
        F.when(number == 0, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), number.cast("string"))).alias("title_slug"),
        (number > 0).alias("slug_was_taken"),
    )
    return new_works.join(slugs, "work_id")


@transform("update_title_slug")
def update_title_slug(library: Library, arguments: DataFrame) -> Library:
    """Slug from the title and the first free of: given suffixes, else the first editor's surname, else the language.

    ``arguments``: work_id, additional_fields array<string> (NULL: editor or language).
    """
    works = library["works"]
    asked = works.join(arguments.select("work_id", "additional_fields"), "work_id")
    editor = F.get("editors", F.lit(0))
    derived = F.array(F.when(editor.isNotNull(), slugify(F.lower(person_surname(editor)))).otherwise(slugify(F.col("language"))))
    fields = F.coalesce("additional_fields", derived)
    suffix = F.when(F.col("f").startswith("-"), F.col("f")).otherwise(F.concat(F.lit("-"), F.col("f")))
    candidates = asked.select("work_id", slugify(F.col("title")).alias("__base"), F.posexplode(fields).alias("__pos", "f")).select(
        "work_id", "__pos", F.concat("__base", suffix).alias("title_slug")
    )
    # Works in order of their ids take the first free candidate: each proposes its first, a slug keeps the lowest id,
    # and who is turned down goes on to the next, until nobody is.
    open_ = candidates.join(works.select("title_slug"), "title_slug", "left_anti")
    while True:
        open_ = cut_lineage(open_)
        proposed = first_per_key(open_, ["work_id"], ["__pos"], ["title_slug"])
        winners = proposed.groupBy("title_slug").agg(F.min("work_id").alias("work_id")).withColumnRenamed("title_slug", "__new")
        turned_down = proposed.join(winners.select(F.col("__new").alias("title_slug"), F.col("work_id").alias("__holder")), "title_slug").where("work_id <> __holder")
        if not turned_down.limit(1).count():
            break
        open_ = open_.join(turned_down.select("work_id", "title_slug"), ["work_id", "title_slug"], "left_anti")
    renamed = works.join(winners, "work_id", "left").withColumn("title_slug", F.coalesce("__new", "title_slug")).drop("__new")
    return {**library, "works": renamed.select(*works.columns)}


# Works ----------------------------------------------------------------------------


@transform("set_meta_data")
def set_meta_data(library: Library, arguments: DataFrame) -> Library:
    """``arguments``: work_id, title, title_slug, language; NULL keeps the old value."""
    works = library["works"]
    names = ["title", "title_slug", "language"]
    new = arguments.select("work_id", *[F.col(n).alias(f"__{n}") for n in names])
    joined = works.join(new, "work_id", "left")
    changed = joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in works.columns])
    return {**library, "works": changed}


@transform("set_work_type")
def set_work_type(library: Library, arguments: DataFrame) -> Library:
    """``arguments``: work_id, title (of the type); missing types are created."""
    works = library["works"]
    types = library["work_types"]
    created = get_or_create(types, arguments.select("title"), ["title"])
    joined = works.drop("work_type").join(arguments.select("work_id", F.col("title").alias("work_type")), "work_id", "left")
    if "work_type" in works.columns:
        old = works.select("work_id", F.col("work_type").alias("__old"))
        joined = joined.join(old, "work_id").withColumn("work_type", F.coalesce("work_type", "__old")).drop("__old")
    return {**library, "works": joined, "work_types": created}


@transform("add_wiki_article")
def add_wiki_article(library: Library, arguments: DataFrame) -> Library:
    """``arguments``: term, article; terms that have an article keep it."""
    articles = library["wiki_articles"]
    new = arguments.where(F.col("term").isNotNull() & F.col("article").isNotNull()).groupBy(F.col("term").alias("search")).agg(F.min("article").alias("article"))
    return {**library, "wiki_articles": articles.unionByName(new.join(articles, "search", "left_anti"))}


@transform("assign_related_work")
def assign_related_work(library: Library, arguments: DataFrame) -> Library:
    """``arguments``: work_id, title_slug of the related work; linked both ways."""
    from scriptoria.operators.linkage import symmetric

    slugs = library["works"].select(F.col("work_id").alias("related_work_id"), "title_slug")
    pairs = arguments.join(slugs, "title_slug").select("work_id", "related_work_id")
    old = library["related_works"].select("work_id", "related_work_id")
    return {**library, "related_works": symmetric(old.unionByName(pairs))}


# Divisions --------------------------------------------------------------------------


def _match_given(known: DataFrame, asked: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(argument_id, division_id) of the one division that agrees with each argument in all keys it gives; another number is an error.

    ``keys``: column of ``asked`` -> column of ``known``.  Arguments are grouped
    by the set of keys they give - at most 2^keys sets.  For each set that
    occurs divisions are counted by work and these keys and met by equality, so
    no argument meets more than one row.
    """
    mask = sum((F.when(F.col(k).isNotNull(), 1 << n).otherwise(0) for n, k in enumerate(keys)), F.lit(0))
    masked = asked.select("argument_id", "work_id", *keys, mask.alias("__mask"))
    found = None
    for row in masked.select("__mask").distinct().collect():
        given = {k: c for n, (k, c) in enumerate(keys.items()) if row[0] >> n & 1}
        counted = known.groupBy("work_id", *given.values()).agg(F.count("division_id").alias("__n"), F.min("division_id").alias("division_id"))
        counted = counted.select("work_id", *(F.col(c).alias(k) for k, c in given.items()), "__n", "division_id")
        own = masked.where(F.col("__mask") == row[0]).select("argument_id", "work_id", *given).join(counted, ["work_id", *given], "left")
        own = own.select("argument_id", F.coalesce("__n", F.lit(0)).alias("__n"), "division_id")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return asked.select("argument_id", F.lit(None).cast("bigint").alias("division_id")).where("false")
    return found.withColumn(
        "division_id",
        F.when(F.col("__n") == 1, F.col("division_id")).otherwise(
            F.raise_error(F.concat(F.lit("the transform names "), F.col("__n").cast("string"), F.lit(" divisions"))).cast("bigint")
        ),
    ).drop("__n")


@transform("set_division_title")
def set_division_title(library: Library, arguments: DataFrame) -> Library:
    """``arguments``: argument_id, work_id, existing_title_slug, existing_parent_slug, existing_sequence_number, title, title_slug, descriptor."""
    divisions = library["divisions"]
    parents = divisions.select(F.col("division_id").alias("parent_id"), F.col("title_slug").alias("__parent_slug"))
    new = ["title", "title_slug", "descriptor"]
    asked = arguments.select(
        "argument_id", "work_id", "existing_title_slug", "existing_parent_slug", "existing_sequence_number",
        *[F.col(n).alias(f"__{n}") for n in new],
    )
    known = divisions.join(parents, "parent_id", "left").select("work_id", "division_id", "title_slug", "sequence_number", "__parent_slug")
    given = {"existing_title_slug": "title_slug", "existing_parent_slug": "__parent_slug", "existing_sequence_number": "sequence_number"}
    target = _match_given(known, asked, given).join(asked.select("argument_id", *[f"__{n}" for n in new]), "argument_id").drop("argument_id")
    joined = divisions.join(target, "division_id", "left")
    return {
        **library,
        "divisions": joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in new else F.col(c) for c in divisions.columns]),
    }


@transform("set_division_readable")
def set_division_readable(library: Library, arguments: DataFrame) -> Library:
    """``arguments``: argument_id, work_id, sequence_number, title_slug, type, descriptor, level, readable."""
    divisions = library["divisions"]
    keys = ["sequence_number", "title_slug", "type", "descriptor", "level"]
    asked = arguments.select("argument_id", "work_id", *[F.col(k).alias(f"__{k}") for k in keys], F.col("readable").alias("__readable"))
    target = _match_given(divisions.select("work_id", "division_id", *keys), asked, {f"__{k}": k for k in keys})
    target = target.join(asked.select("argument_id", "__readable"), "argument_id").drop("argument_id")
    joined = divisions.join(target, "division_id", "left")
    return {
        **library,
        "divisions": joined.withColumn("readable_unit", F.coalesce("__readable", "readable_unit")).select(*divisions.columns),
    }


@transform("delete_unnecessary_divisions")
def delete_unnecessary_divisions(library: Library, arguments: DataFrame) -> Library:
    """Orphan divisions of the works named in ``arguments`` (work_id) are dropped."""
    from scriptoria.operators.divisions import orphan_divisions

    divisions = library["divisions"]
    orphans = orphan_divisions(divisions, library["verses"]).join(arguments.select("work_id").distinct(), "work_id", "left_semi")
    return {**library, "divisions": divisions.join(orphans.select("division_id"), "division_id", "left_anti")}


@transform("delete_divisions_by_title_slug")
def delete_divisions_by_title_slug(library: Library, arguments: DataFrame) -> Library:
    """``arguments``: work_id, title_slug; the divisions go with their verses."""
    divisions = library["divisions"]
    keys = arguments.select("work_id", "title_slug").distinct()
    gone = divisions.join(keys, ["work_id", "title_slug"], "left_semi").select("division_id")
    return {
        **library,
        "divisions": divisions.join(gone, "division_id", "left_anti"),
        "verses": library["verses"].join(gone, "division_id", "left_anti"),
    }


@transform("convert_descriptors_from_beta_code")
def convert_descriptors_from_beta_code(library: Library, arguments: DataFrame) -> Library:
    """Descriptors of the works in ``arguments`` (work_id), read as beta code."""
    divisions = library["divisions"]
    asked = arguments.select("work_id", F.lit(True).alias("__convert")).distinct()
    joined = divisions.join(asked, "work_id", "left")
    greek = F.coalesce(beta_to_unicode(F.when(F.col("__convert"), F.col("descriptor"))), F.col("descriptor"))
    return {**library, "divisions": joined.withColumn("descriptor", greek).select(*divisions.columns)}


@transform("index_lexicon")
def index_lexicon(library: Library, arguments: DataFrame) -> Library:
    """Lexicon entries for the verses of the works in ``arguments`` (work_id)."""
    from scriptoria.operators import morphology
    from scriptoria.sources.lexicon import headwords

    owners = library["divisions"].select("division_id", "work_id").join(arguments.select("work_id").distinct(), "work_id", "left_semi")
    verses = library["verses"].join(owners, "division_id")
    old = library["lexicon_entries"]
    new = morphology.index_lexicon(headwords(verses), library["lemmas"], old)
    return {**library, "lexicon_entries": old.unionByName(new.select(*old.columns))}


# Loading ----------------------------------------------------------------------------


def get_or_create(existing: DataFrame, wanted: DataFrame, key: Sequence[str], values: dict[str, Column] | None = None) -> DataFrame:
    """Dimension rows after adding the wanted keys that are missing.

    Ids of new rows are a hash of the natural key, so a re-run creates the same rows.
    """
    new = wanted.select(*key).distinct().join(existing, list(key), "left_anti")
    for name, column in (values or {}).items():
        new = new.withColumn(name, column)
    return existing.unionByName(new, allowMissingColumns=True)


def author_rows(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Authors by name; a missing name is "Unknown"; "Unknown" and "Various" are no real authors."""
    name = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "Unknown").otherwise(F.col("name"))
    return get_or_create(
        existing, names.select(name.alias("name")), ["name"],
        {"author_id": F.xxhash64("name"), "meta_author": F.col("name").isin("Unknown", "Various")},
    )


def new_works(works: DataFrame, existing: DataFrame) -> DataFrame:
    """Works that do not exist yet, by title, first author and language."""
    def key(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {"__t": F.coalesce("title", F.lit("")), "__l": F.coalesce("language", F.lit("")), "__a": F.coalesce(F.get("authors", F.lit(0)), F.lit(""))}
        )

    names = ["__t", "__l", "__a"]
    return key(works).join(key(existing).select(*names), names, "left_anti").drop(*names)


def replace_works(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing works minus those with the title and language of a fresh one, plus the fresh ones."""
    return existing.join(fresh.select("title", "language").distinct(), ["title", "language"], "left_anti").unionByName(fresh)
