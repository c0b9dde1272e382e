"""Mixing of sources to target weights by hierarchical budgeting.

Weights stand on a tree of domains, languages and sources.  A budget of tokens
goes down the tree: among siblings each gets its share by weight; one that
cannot use its share - it has no more tokens than ``max_epochs`` passes over
its documents give - leaves the rest to its siblings, and only what all of
them cannot use has already gone to the siblings of their parent, because a
node's capacity is the sum of its leaves'.  A leaf fills its budget from
epochs, each a seeded order of its documents: whole epochs, then the longest
prefix of the next one that stays within the budget.

Token counts of leaves come from all documents.  The running sum of a leaf is
cut into bins of the seeded order, so a leaf with a third of all rows is many
groups; sums of bins are what one task sees whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.rows import table
from scriptoria.session import cut_lineage

SEED = 17
MAX_EPOCHS = 2
# Of all tokens there are, in percent.
BUDGET_PERCENT = 60
# Weights of the registered query; what is not named weighs 1.
DOMAIN_WEIGHTS = {"web": 3, "books": 2}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
# Sources of the domain "books"; all others are "web".
BOOKS = [f"src{k}" for k in range(10, 20)]
# Hexadecimal digits of the seeded order that make a bin.
BIN_DIGITS = 3


def n_tokens(text: Column) -> Column:
    """Words between blanks (space, tab, line ends) of the whole text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("bigint")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, weight in weights.items():
        out = F.when(name == value, weight).otherwise(out)
    return out.cast("bigint")


def weigh(documents: DataFrame) -> DataFrame:
    """doc_id, text and the example tree: domain, lang, source and the weight of each among its siblings; null is the name '?'."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("lang", "source")]
    domain = F.when(named[1].isin(BOOKS), "books").otherwise("web")
    return documents.select(
        "doc_id", "text", domain.alias("_domain"), named[0].alias("_lang"), named[1].alias("_source"),
        _weight(domain, DOMAIN_WEIGHTS).alias("_domain_weight"), _weight(named[0], LANGUAGE_WEIGHTS).alias("_lang_weight"), F.lit(1).cast("bigint").alias("_source_weight"),
    )


def share_budget(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget`` to siblings (parent columns, name, weight, capacity, parent_budget <= sum of capacities).

    Siblings in order of capacity per weight: one is full if its share of what
    the ones before it leave is no less than its capacity.  The others share
    what the full ones leave by weight, rounded down to tokens.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    # Capacity per weight in whole millionths, the same in every engine.
    order = Window.partitionBy(*parent).orderBy(F.expr("CAST(capacity AS DECIMAL(28,0)) * 1000000 div weight"), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    state = nodes.withColumn("_left", left).withColumn("_weights", F.sum("weight").over(after))
    full = state.withColumn("_full", wide(F.col("capacity")) * wide(F.col("_weights")) <= wide(F.col("weight")) * wide(F.col("_left")))
    # Full ones come first; the first that is not full sees what is left to share.
    group = Window.partitionBy(*parent)
    shared = full.withColumn("_open", F.min(F.when(~F.col("_full"), F.struct(-F.col("_weights"), F.col("_left").alias("left"), F.col("_weights").alias("weights")))).over(group))
    portion = F.expr("CAST(CAST(weight AS DECIMAL(19,0)) * CAST(_open.left AS DECIMAL(19,0)) div CAST(_open.weights AS DECIMAL(19,0)) AS BIGINT)")
    return shared.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(portion)).drop("_left", "_weights", "_full", "_open")


def leaf_budgets(leaves: DataFrame, budget_percent: int, max_epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, weights, tokens) with ``budget``; the tree is small next to the documents."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    root = Window.partitionBy("root")
    domains = leaves.groupBy(F.lit(0).alias("root"), "domain").agg(
        F.max("domain_weight").alias("weight"), F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")
    )
    domains = domains.withColumn("_all", F.sum("tokens").over(root)).withColumn("_most", F.sum("capacity").over(root))
    domains = domains.withColumn("parent_budget", F.expr(f"least(_all * {budget_percent} div 100, _most)"))
    domains = share_budget(domains, ["root"], "domain").select("domain", F.col("budget").alias("parent_budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.max("lang_weight").alias("weight"), F.sum("capacity").alias("capacity")).join(domains, "domain")
    langs = share_budget(langs, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("parent_budget"))
    sources = leaves.withColumnRenamed("source_weight", "weight").join(langs, ["domain", "lang"])
    return share_budget(sources, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "budget")


def select_copies(weighed: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies for each row of weighed documents (see ``weigh``; doc_id, text).

    ``copies`` is how often the row is taken: once for each whole epoch of its
    leaf and once more if it lies in the prefix.  Rows that repeat a doc_id
    and have as many tokens are ties in the seeded order: all or none of them lie
    in the prefix.  A null text has no tokens; a leaf without tokens has budget 0 and
    its empty rows are taken once.  A null doc_id counts as an empty one.
    """
    leaf = ["domain", "lang", "source"]
    own = [F.col(f"_{c}").alias(c) for c in leaf]
    weights = [F.col(f"_{c}_weight").alias(f"{c}_weight") for c in leaf]
    rows = cut_lineage(weighed.select(F.col("doc_id").cast("bigint").alias("doc_id"), n_tokens(F.col("text").cast("string")).alias("n_tokens"), *own, *weights))
    leaves = rows.groupBy(*leaf).agg(*(F.max(f"{c}_weight").alias(f"{c}_weight") for c in leaf), F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, budget_percent, max_epochs)
    epochs = budgets.select(
        *leaf, F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget div tokens END").alias("whole"),
        F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END").alias("rest"),
    )
    # The epoch after the whole ones decides the order.
    key = F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col("whole") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens")))
    placed = rows.select("doc_id", "n_tokens", *leaf).join(epochs, leaf).withColumn("_key", key).withColumn("_bin", F.substring("_key", 1, BIN_DIGITS))
    bins = placed.groupBy(*leaf, "_bin").agg(F.sum("n_tokens").alias("_n"))
    starts = bins.select(*leaf, "_bin", (F.sum("_n").over(Window.partitionBy(*leaf).orderBy("_bin")) - F.col("_n")).alias("_start"))
    # Ties share one place: the running sum runs over ranges of the key.
    inside = F.sum("n_tokens").over(Window.partitionBy(*leaf, "_bin").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0))
    until = placed.join(starts, [*leaf, "_bin"]).withColumn("_until", F.col("_start") + inside)
    taken = (F.col("_until") <= F.col("rest")).cast("int")
    return until.select("doc_id", *leaf, "n_tokens", (F.col("whole") + taken).cast("int").alias("copies"))


def mix_documents(documents: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents, all columns whatever their names, as often as they are taken; rows that repeat a doc_id are taken as one.

    Very long texts are whole; an empty table gives no rows.
    """
    copies = select_copies(weigh(documents), budget_percent, max_epochs, seed).where("copies > 0")
    wanted = copies.groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    return (
        documents.select(F.col("doc_id").alias("_own"), F.struct("*").alias("_row"))
        .join(wanted.withColumnRenamed("doc_id", "_id"), F.expr("_own <=> _id"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("_row.*")
    )


def op8_mixing(spark, sf_dir):
    return select_copies(weigh(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))


def _cases(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _shared(rows: str, parent: str, name: str) -> str:
    """SQL of ``share_budget``."""
    return f"""
SELECT *, CASE WHEN is_full THEN capacity ELSE CAST(weight * open_left // open_weights AS BIGINT) END AS budget FROM (
  SELECT *, arg_max(rest_left, rest_weights) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS open_left,
         max(rest_weights) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS open_weights
  FROM (
    SELECT *, capacity * rest_weights <= weight * rest_left AS is_full FROM (
      SELECT *, CAST(parent_budget - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity::HUGEINT * 1000000 // weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS rest_left,
             CAST(sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity::HUGEINT * 1000000 // weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS rest_weights
      FROM ({rows}))))"""


OP8_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
         CASE WHEN source IN ({', '.join(repr(b) for b in BOOKS)}) THEN 'books' ELSE 'web' END AS domain,
         coalesce(lang, '?') AS lang, coalesce(source, '?') AS source
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) AS capacity FROM d GROUP BY ALL),
whole AS (SELECT CAST(least(sum(tokens) * {BUDGET_PERCENT} // 100, sum(capacity)) AS BIGINT) AS parent_budget FROM leaves),
domains AS ({_shared(f"SELECT 0 AS root, domain, {_cases('domain', DOMAIN_WEIGHTS)} AS weight, CAST(sum(capacity) AS BIGINT) AS capacity, any_value(parent_budget) AS parent_budget FROM leaves, whole GROUP BY domain", 'root', 'domain')}),
langs AS ({_shared(f"SELECT l.domain, lang, {_cases('lang', LANGUAGE_WEIGHTS)} AS weight, CAST(sum(l.capacity) AS BIGINT) AS capacity, any_value(p.budget) AS parent_budget FROM leaves l JOIN domains p USING (domain) GROUP BY l.domain, lang", 'domain', 'lang')}),
sources AS ({_shared("SELECT l.domain, l.lang, source, tokens, 1 AS weight, l.capacity, p.budget AS parent_budget FROM leaves l JOIN langs p USING (domain, lang)", 'domain, lang', 'source')}),
epochs AS (
  SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS whole, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest FROM sources)
SELECT doc_id, domain, lang, source, n_tokens,
       CAST(whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(' ', '{SEED}', whole + 1, coalesce(CAST(doc_id AS VARCHAR), ''), n_tokens)) RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM d JOIN epochs USING (domain, lang, source)"""
