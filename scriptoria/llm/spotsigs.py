"""Document fingerprints by spot signatures, in DataFrame functions only.

The most frequent words of the whole collection are anchors.  Wherever an
anchor stands, the content words that follow it - anchors in between are
passed over - form a chain; anchor and chain are one signature, and the set of
a document's signatures is its fingerprint.  Chains lie in running text, so
headers, lists and markup leave few of them.

Fingerprints are compared by Jaccard's measure.  They are partitioned by the
length of their sets into classes, each ``1 / least`` times as wide as the one
before: sets of classes further apart than neighbours, or whose lengths alone
keep them below ``least``, are not compared and have likeness 0.

Each document is set against the one that follows it in descending order of
doc_id.  Ids are cut into chunks of some ``CHUNK_ROWS`` rows by their
quantiles, rows of a chunk meet in one exchange, and only the first and last
row of each chunk are met a second time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.rows import ascii_lower, stored, table
from scriptoria.operators.ordered import carry

ANCHORS = 64
# Content words of a chain, and the distance between them counted in content words.
CHAIN, DISTANCE = 2, 1
# Likeness below which lengths alone may rule a comparison out.
LEAST = 0.1
CHUNK_ROWS, QUANTILES = 256, 256

_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Runs of letters, digits and signs beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), _GAP), "")


def frequent_words(documents: DataFrame, n: int = ANCHORS) -> list[str]:
    """The ``n`` words that occur most often in all texts, ties by the word; they are counted before the exchange."""
    counts = documents.select(F.explode(words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return [r.w for r in counts.orderBy(F.desc("n"), "w").limit(n).collect()]


def with_signatures(df: DataFrame, text: str, name: str, anchors: list[str], chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """Add the distinct signatures of a text, sorted; without any, all its words are one."""
    w, spots, content = "__words", "__spots", "__content"
    is_anchor = lambda x: x.isin(anchors) if anchors else F.lit(False)
    out = df.withColumn(w, words(F.col(text)))
    out = out.withColumn(spots, F.filter(F.transform(w, lambda x, i: F.when(is_anchor(x), i)), lambda i: i.isNotNull()))
    out = out.withColumn(content, F.filter(w, lambda x: ~is_anchor(x)))
    # Before the anchor at i, the r-th one, stand i - r content words.
    link = lambda i, r, j: F.get(content, i - r + (j + 1) * distance - 1)
    chained = lambda i, r: F.when(
        i - r + chain * distance <= F.size(content), F.concat_ws(" ", F.get(w, i), *(link(i, r, j) for j in range(chain)))
    )
    found = F.array_sort(F.array_distinct(F.filter(F.transform(spots, chained), lambda s: s.isNotNull())))
    out = out.withColumn("__found", found)
    whole = F.when(F.size(w) > 0, F.array(F.concat_ws(" ", w))).otherwise(F.array().cast("array<string>"))
    return out.withColumn(name, F.when(F.size("__found") > 0, F.col("__found")).otherwise(whole)).drop(w, spots, content, "__found")


def fingerprint(signatures: Column) -> Column:
    """Number and digest of a set of signatures."""
    return F.concat_ws(":", F.size(signatures).cast("string"), F.sha2(F.concat_ws("\n", signatures), 256))


def length_class(n: Column, least: float = LEAST) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1))) / F.lit(math.log(1 / least)) + F.lit(1e-9))


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard's measure of two sets of signatures; 0 where their lengths rule out ``least``, 1 where both are empty."""
    n, m = F.size(a), F.size(b)
    near = (F.abs(length_class(n, least) - length_class(m, least)) <= 1) & (F.least(n, m) >= F.lit(least) * F.greatest(n, m))
    both = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0) | ~near, F.lit(0.0)).otherwise(both / (n + m - both))


def _chunk(documents: DataFrame, chunk_rows: int, quantiles: int) -> Column:
    """A number that grows with doc_id; some ``chunk_rows`` ids share one.  Null ids come below all others."""
    shares = [k / quantiles for k in range(quantiles + 1)]
    known = documents.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares, 10_000).alias("q")).first()
    if not known.n:
        return F.lit(0).cast("bigint")
    cuts = sorted({known.least, *known.q})
    parts = max(1, -(-known.n // (len(cuts) * chunk_rows)))
    widths = [max(1, -(-(b - a) // parts)) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1])]
    # Ids above the last cut share one chunk; approximate quantiles end at the largest id.
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: q <= F.col("doc_id"))) - 1
    inside = (F.col("doc_id") - F.get(F.array(*map(F.lit, cuts)), at)) / F.get(F.array(*map(F.lit, widths)), at)
    number = at.cast("bigint") * (parts + 1) + F.least(F.floor(inside), F.lit(parts))
    return F.coalesce(number, F.lit(-1).cast("bigint"))


def _followed(documents: DataFrame, make: Callable[[DataFrame], DataFrame], chunk_rows: int, quantiles: int) -> DataFrame:
    """``make`` of every row (doc_id, text, next_text), where no doc_id repeats; the first row follows the last."""
    rows = documents.withColumn("__at", _chunk(documents, chunk_rows, quantiles)).repartition("__at")
    inside = Window.partitionBy("__at").orderBy(F.desc_nulls_last("doc_id"))
    rows = rows.withColumns({"next_text": F.lead("text").over(inside), "__first": F.lag(F.lit(1)).over(inside).isNull(), "__last": F.lead(F.lit(1)).over(inside).isNull()})
    made = make(rows.select("doc_id", "text", "next_text", "__at", "__first", "__last"))
    kept = [c for c in made.columns if not c.startswith("__") and c != "text"]
    done = stored(made.select(*kept, "__at", "__first", "__last", F.when(F.col("__first") | F.col("__last"), F.col("text")).alias("__edge")))
    # The chunk that comes after each one, and after the last the first.
    heads = done.where("__first").select("__at", F.col("__edge").alias("next_text"))
    after = carry(heads.select("__at"), [], "__at", {"__after": F.col("__at")})
    top = heads.agg(F.max("__at")).first()[0]
    after = after.select("__at", F.coalesce("__after", F.lit(top).cast("bigint")).alias("__after"))
    tails = done.where("__last").select("doc_id", F.col("__edge").alias("text"), "__at").join(after, "__at")
    tails = tails.join(heads.withColumnRenamed("__at", "__after"), "__after").select("doc_id", "text", "next_text", F.lit(0).alias("__at"), F.lit(False).alias("__first"), F.lit(False).alias("__last"))
    return done.where("NOT __last").select(*kept).unionByName(make(tails).select(*kept))


def fingerprints(documents: DataFrame, anchors: list[str] | None = None, chunk_rows: int = CHUNK_ROWS, quantiles: int = QUANTILES) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): signatures and what a partial edit leaves of them.

    The edited text has the first as many code points of the following
    document in place of its last third.  Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_signatures, n_edited_signatures.

    A null text is an empty one.  A text without a word has no signature, one
    without a chain has all its words as one.  The document that follows has
    the next smaller doc_id, null being smallest; after the last comes the
    first.  Rows that repeat a doc_id are judged each by itself; where an id
    repeats, its smallest text is the one that others are set against.  Very
    long texts are whole; equal texts have equal fingerprints.  A table of one
    document follows itself; an empty table gives no rows; other columns are
    not read.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    anchors = frequent_words(rows) if anchors is None else anchors

    def judged(df: DataFrame) -> DataFrame:
        n = F.length("text")
        cut = F.floor(n / 3).cast("int")
        df = with_signatures(df, "text", "__own", anchors)
        df = with_signatures(df, "next_text", "__next", anchors)
        df = df.withColumn("__edited_text", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
        df = with_signatures(df, "__edited_text", "__edited", anchors)
        return df.withColumns({
            "n_chars": n.cast("bigint"), "edited_sha256": F.sha2("__edited_text", 256), "fingerprint": fingerprint(F.col("__own")),
            "edited_fingerprint": fingerprint(F.col("__edited")), "near_edited": likeness(F.col("__own"), F.col("__edited")),
            "near_next": likeness(F.col("__own"), F.col("__next")), "n_signatures": F.size("__own"), "n_edited_signatures": F.size("__edited"),
        }).drop("next_text")

    if not rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _followed(rows, judged, chunk_rows, quantiles)
    alone = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    following = _followed(alone, lambda df: df, chunk_rows, quantiles).withColumnRenamed("doc_id", "__id")
    return judged(rows.join(following, F.expr("doc_id <=> __id"))).drop("text", "__id", "__own", "__next", "__edited", "__edited_text")


def op12_document_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def _signatures_sql(text: str) -> str:
    """Lists of signatures of a table with (doc_id, text)."""
    chain = " || ' ' || ".join(["w[i]", *(f"c[i - r + {(j + 1) * DISTANCE}]" for j in range(CHAIN))])
    return f"""(
  SELECT doc_id, CASE WHEN len(s) > 0 THEN s WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM (SELECT doc_id, w, list_sort(list_distinct(list_filter(list_transform(p, lambda i, r: CASE WHEN i - r + {CHAIN * DISTANCE} <= len(c) THEN {chain} END), lambda x: x IS NOT NULL))) AS s
        FROM (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: list_contains(a, w[i])) AS p, list_filter(w, lambda x: NOT list_contains(a, x)) AS c
              FROM (SELECT doc_id, {_WORDS_SQL.format(text)} AS w FROM e), anchors)))"""


_WORDS_SQL = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LIKENESS_SQL = (
    "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 WHEN len({0}) = 0 OR len({1}) = 0 OR least(len({0}), len({1})) < "
    f"{LEAST}" " * greatest(len({0}), len({1})) THEN 0.0"
    " ELSE len(list_intersect({0}, {1})) / CAST(len({0}) + len({1}) - len(list_intersect({0}, {1})) AS DOUBLE) END"
)
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, lead(doc_id) OVER o AS next_id, lead(text) OVER o AS next_text, first_value(doc_id) OVER o AS top, first_value(text) OVER o AS top_text FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS MATERIALIZED (
  SELECT doc_id, text, length(text) AS n, coalesce(next_id, top) AS next_id,
         substring(text, 1, length(text) - length(text) // 3) || substring(coalesce(next_text, top_text), 1, length(text) // 3) AS edited FROM n),
anchors AS MATERIALIZED (SELECT list(w) AS a FROM (SELECT w FROM (SELECT unnest({_WORDS_SQL.format('text')}) AS w FROM d) GROUP BY w ORDER BY count(*) DESC, w LIMIT {ANCHORS})),
own AS MATERIALIZED {_signatures_sql('text')},
edited AS MATERIALIZED {_signatures_sql('edited')}
SELECT e.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, len(o.s) || ':' || sha256(array_to_string(o.s, chr(10))) AS fingerprint,
       len(x.s) || ':' || sha256(array_to_string(x.s, chr(10))) AS edited_fingerprint, CAST({_LIKENESS_SQL.format('o.s', 'x.s')} AS DOUBLE) AS near_edited,
       CAST({_LIKENESS_SQL.format('o.s', 'y.s')} AS DOUBLE) AS near_next, CAST(len(o.s) AS INTEGER) AS n_signatures, CAST(len(x.s) AS INTEGER) AS n_edited_signatures
FROM e JOIN own o USING (doc_id) JOIN edited x USING (doc_id) JOIN own y ON y.doc_id = e.next_id"""
