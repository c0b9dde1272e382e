"""Citations: from "Matthew 1:5" to a division and a verse, for a whole table of citations at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.ordered import first_per_key
from scriptoria.session import merged, small_or_merged

# --- fixed values -----------------------------------------------------------
NUMERALS = {"1": "I", "2": "II", "3": "III", "4": "IV", "5": "V"}
# ----------------------------------------------------------------------------


def _swap_prefix(name: Column, pattern: str, mapping: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    prefix = F.regexp_extract(name, pattern, 1)
    swapped = F.try_element_at(lookup, prefix)
    return F.when(swapped.isNotNull(), F.concat(swapped, F.regexp_extract(name, pattern, 2))).otherwise(name)


def to_lettered(name: Column) -> Column:
    """"1 Timothy" to "I Timothy"; numbers outside the map stay."""
    return _swap_prefix(name, "^([1-9])( .*)", NUMERALS)


def to_numbered(name: Column) -> Column:
    """"I Timothy" to "1 Timothy"; numerals outside the map stay."""
    return _swap_prefix(name, "^([IV]+)( .*)", {v: k for k, v in NUMERALS.items()})


def has_numbered_book(name: Column) -> Column:
    return name.rlike("^[1-9] ")


def has_lettered_book(name: Column) -> Column:
    return name.rlike("^[IV]+ ")


def strip_verse_range(reference: Column) -> Column:
    """"1:1-4" to "1:1"."""
    return F.regexp_replace(F.trim(reference), "-[0-9]+$", "")


def split_reference_list(references: Column) -> Column:
    """Comma-separated references as an array, trimmed."""
    return F.transform(F.split(references, ","), lambda r: F.trim(r))


def _path_key(path: Column) -> Column:
    return F.lower(F.array_join(F.transform(path, lambda p: F.coalesce(p, F.lit(""))), "\u0001"))


def candidates(parts: Column) -> Column:
    """Readings of citation parts in order of preference: ``array<struct<priority, path, verse>>``.

    First all parts name divisions, then the last one is the verse, however
    many there are.  Each reading is tried as written and with the other style
    of book numbers.
    """
    size = F.size(parts)
    shorter = F.slice(parts, 1, F.greatest(size - 1, F.lit(0)))
    plain = F.array(
        F.struct(F.lit(0).alias("rank"), parts.alias("path"), F.lit(None).cast("string").alias("verse")),
        F.struct(F.lit(2).alias("rank"), shorter.alias("path"), F.get(parts, size - 1).alias("verse")),
    )

    def other_style(path: Column) -> Column:
        return F.when(
            F.exists(path, has_numbered_book), F.transform(path, to_lettered)
        ).when(F.exists(path, has_lettered_book), F.transform(path, to_numbered))

    swapped = F.transform(
        plain, lambda c: F.struct((c["rank"] + 1).alias("rank"), other_style(c["path"]).alias("path"), c["verse"].alias("verse"))
    )
    return F.filter(
        F.concat(plain, swapped), lambda c: c["path"].isNotNull() & (F.size(c["path"]) > 0)
    )


def resolve_parts(citations: DataFrame, divisions: DataFrame, keys: list[str], rank_base: str | None = None) -> DataFrame:
    """Resolve citations given as ``parts`` in a work.

    ``citations``: keys, work_slug, parts; ``divisions``: work_slug,
    division_id, sequence_number, path.  Descriptors compare without regard to
    case over the whole chain; the lowest rank, then the first division by
    sequence wins.  Returns keys, division_id, verse.
    """
    tried = citations.select(*keys, *([rank_base] if rank_base else []), "work_slug", F.explode(candidates(F.col("parts"))).alias("c")).select(
        *keys,
        "work_slug",
        (F.col("c.rank") + (F.col(rank_base) if rank_base else F.lit(0))).alias("rank"),
        F.col("c.verse").alias("verse"),
        _path_key(F.col("c.path")).alias("path_key"),
    )
    known = divisions.select("work_slug", "division_id", "sequence_number", _path_key(F.col("path")).alias("path_key"))
    found = tried.join(merged(known), ["work_slug", "path_key"])
    return first_per_key(found, keys, ["rank", "sequence_number"], ["division_id", "verse"])


def resolve_citations(citations: DataFrame, divisions: DataFrame) -> DataFrame:
    """Resolve citation strings.

    ``citations``: citation_id, work_slug, reference.  The text is split at
    blanks, periods and colons; failing that at blanks and colons only.
    Descriptors of the work that contain blanks are protected: from the left,
    the longest descriptor that stands at a place is one part.
    Returns citation_id, division_id, verse.
    """
    spaced = (
        divisions.where(F.col("descriptor").contains(" ")).select("work_slug", "descriptor").distinct()
    )
    # A descriptor is looked up by its first word or sign and must go on as the reference does, up to a sign or the end.
    signs = F.regexp_extract_all("reference", F.lit("[^ .:]+|[ .:]"), F.lit(0))
    head = F.regexp_extract("descriptor", "^([^ .:]+|[ .:])", 1)
    at = citations.where(F.length("reference") > 0).withColumn("__signs", signs).select(
        "citation_id", "work_slug", "__signs", F.posexplode("__signs").alias("__at", "__head")
    )
    rest = F.array_join(F.slice("__signs", F.col("__at") + 1, F.greatest(F.size("__signs"), F.lit(1))), "")
    after = F.substring(F.col("__rest"), F.length("descriptor") + 1, F.lit(1))
    named = (
        at.join(small_or_merged(spaced.withColumn("__head", head)), ["work_slug", "__head"])
        .withColumn("__rest", rest)
        .where(F.col("__rest").startswith(F.col("descriptor")) & (after.isin("", " ", ".", ":") | F.col("descriptor").rlike("[ .:]$")))
        .select("citation_id", F.struct(F.col("__at").alias("at"), F.size(F.regexp_extract_all("descriptor", F.lit("[^ .:]+|[ .:]"), F.lit(0))).alias("n"), "descriptor").alias("__m"))
        .groupBy("citation_id")
        .agg(F.collect_set("__m").alias("__m"))
    )
    # Leftmost, longest: at each place the longest descriptor that begins after the one chosen before it.
    ordered = F.array_sort("__m", lambda a, b: F.when(a["at"] == b["at"], b["n"] - a["n"]).otherwise(a["at"] - b["at"]))
    found = "array<struct<at:int,n:int,descriptor:string>>"
    chosen = F.aggregate(
        ordered, F.array().cast(found),
        lambda done, m: F.when(
            (F.size(done) == 0) | (m["at"] >= F.element_at(done, -1)["at"] + F.element_at(done, -1)["n"]), F.concat(done, F.array(m))
        ).otherwise(done),
    )
    prepared = citations.withColumn("__signs", signs).join(merged(named), "citation_id", "left").withColumn("__m", F.coalesce("__m", F.array().cast(found)))
    prepared = prepared.withColumn("__named", F.transform(chosen, lambda m, k: F.struct(m["at"].alias("at"), m["n"].alias("n"), m["descriptor"].alias("descriptor"), k.alias("k"))))

    def in_place(sign: Column, i: Column) -> Column:
        """A sign, or the private mark of the descriptor that begins here, or nothing inside of one."""
        begins = F.get(F.filter("__named", lambda m: m["at"] == i), F.lit(0))
        mark = F.concat(F.lit("\ue000"), begins["k"].cast("string"), F.lit("\ue001"), F.when(begins["descriptor"].rlike("[ .:]$"), " ").otherwise(""))
        inside = F.exists("__named", lambda m: (m["at"] < i) & (i < m["at"] + m["n"]))
        return F.when(begins.isNotNull(), mark).when(inside, "").otherwise(sign)

    prepared = prepared.withColumn("__escaped", F.when(F.size("__named") == 0, F.col("reference")).otherwise(F.array_join(F.transform("__signs", in_place), "")))

    def parts(pattern: str) -> Column:
        def named_by(part: Column) -> Column:
            number = F.try_to_number(F.regexp_extract(part, "^\ue000([0-9]+)\ue001$", 1), F.lit("9999999")).cast("int")
            return F.get(F.col("__named"), number)["descriptor"]

        return F.transform(F.split("__escaped", pattern), lambda p: F.coalesce(named_by(p), p))

    both = prepared.select(
        "citation_id", "work_slug",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("base"), parts("[ .:]+").alias("parts")),
                F.struct(F.lit(10).alias("base"), parts("[ :]+").alias("parts")),
            )
        ).alias("p"),
    ).select("citation_id", "work_slug", F.col("p.base").alias("base"), F.col("p.parts").alias("parts"))
    return resolve_parts(both, divisions, ["citation_id"], "base")
