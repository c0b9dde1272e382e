"""URL verdicts from pattern rules that are indexed by their rarest literal token.

Two kinds of rules share one index.  A site rule is a host and the start of a
path (``example.net/en/``); it fits the host and its subdomains.  A pattern is
written as in public filter lists: ``||`` starts at a host label, ``|`` at the
start or end of the address, ``*`` is any text and ``^`` a separator; patterns
see the address with A-Z lower-cased.  The literal tokens of a rule are its
runs of letters and digits that no wildcard touches.  Each rule is filed under
the one that the fewest addresses hold; an address looks up its own tokens,
and only the rules found there run their regular expression.

All work is in DataFrame functions.  Matching needs no exchange but one of
what matched, which combines before the shuffle; verdicts go back to rows by
address, and a hot address is split by Spark's handling of skewed joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.rows import ascii_lower, table

# The site rules and verdicts of the registered query.
SITE_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# Patterns that decide where no site rule fits; the last one keeps pages about spam defence.
PATTERN_RULES = [
    ("||ads-track.", "block"), ("||spam-farm.", "block"), ("||casino-win.", "block"), ("^adserver^", "block"), ("/banner*/click^", "block"),
    ("|ftp://", "block"), (".exe|", "block"), ("^utm_campaign^sponsored^", "block"), ("/spam-farm/help/", "allow"),
]
_SEPARATOR = "(?:[^a-z0-9_.%-]|$)"
_ANY = ""  # filed under this: rules without a literal token


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.+*?()\[\]{}$^|])", r"\\$1")


def site_rules(rules: DataFrame) -> DataFrame:
    """rule, action -> kind, rule, action, regex over host and path, tokens."""
    host, path = F.regexp_extract("rule", r"(?s)^([^/]*)(.*)$", 1), F.regexp_extract("rule", r"(?s)^([^/]*)(.*)$", 2)
    end = F.when(path == "", r"(?=/|$)").otherwise("")
    return rules.where("rule IS NOT NULL").select(
        "rule", "action", F.lit("site").alias("kind"),
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), _quoted(ascii_lower(host)), _quoted(path), end).alias("regex"),
        # A token at the end of the path may go on in the address.
        F.filter(F.split(F.regexp_replace(ascii_lower(F.col("rule")), F.when(path == "", "$^").otherwise("[a-z0-9]+$"), ""), "[^a-z0-9]+"), lambda t: t != "").alias("tokens"),
    )


def pattern_rules(rules: DataFrame) -> DataFrame:
    """rule, action -> the same columns."""
    low = ascii_lower(F.col("rule"))
    body = F.regexp_replace(F.regexp_replace(low, r"^\|\|?", ""), r"\|$", "")
    start = F.when(low.startswith("||"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?").when(low.startswith("|"), "^").otherwise("")
    end = F.when(low.endswith("|") & (F.length(low) > 2), "$").otherwise("")
    regex = F.regexp_replace(F.regexp_replace(_quoted(body), r"\\\*", ".*"), r"\\\^", _SEPARATOR.replace("$", r"\$"))
    # An open end may touch more letters: a star there says so.
    bounded = F.concat(F.when(start == "", "*").otherwise("^"), body, F.when(end == "", "*").otherwise("^"))
    return rules.where("rule IS NOT NULL AND rule <> ''").select(
        "rule", "action", F.lit("pattern").alias("kind"), F.concat(F.lit("(?s)"), start, regex, end).alias("regex"),
        F.regexp_extract_all(bounded, F.lit("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0)).alias("tokens"),
    )


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(url), "[^a-z0-9]+"))


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """File each rule under the token that the fewest addresses (``url``) hold; counts cover all of them."""
    tokens = rules.select("kind", "rule", F.explode("tokens").alias("token")).distinct()
    wanted = tokens.select("token").distinct()
    counts = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").count()
    rarest = (
        tokens.join(counts, "token", "left")
        .groupBy("kind", "rule")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    return rules.drop("tokens").join(rarest, ["kind", "rule"], "left").withColumn("token", F.coalesce("token", F.lit(_ANY)))


def judge_urls(pages: DataFrame, sites: DataFrame, patterns: DataFrame, default: str = "allow") -> DataFrame:
    """Add host, path, rule, pattern and verdict to ``pages`` (url); columns of those names are replaced.

    ``sites`` and ``patterns`` have rule and action; rows with a null rule are
    ignored.  The longest fitting site rule decides (of equal length the one
    with the longer host, then the greater string); else the pattern, where
    allow goes before block; else ``default``.  A null address has an empty
    host and path, no rule and the default.  Rows that repeat each get their
    verdict; an empty table gives no rows.
    """
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "pattern", "verdict")]
    urls = pages.select(F.col("url").cast("string").alias("url")).where("url IS NOT NULL")
    columns = ["kind", "rule", "action", "regex", "tokens"]
    both = site_rules(sites).select(*columns).unionByName(pattern_rules(patterns).select(*columns)).dropDuplicates(["kind", "rule"])
    index = index_rules(both, urls)
    url = F.col("url")
    looked_up = F.explode(F.array_union(url_tokens(url), F.array(F.lit(_ANY))))
    fits = (
        urls.select("url", looked_up.alias("token")).join(index, "token")
        .where(F.rlike(F.when(F.col("kind") == "site", F.concat(host_of(url), path_of(url))).otherwise(ascii_lower(url)), F.col("regex")))
    )
    site, host_length = F.col("kind") == "site", F.length(F.regexp_extract("rule", "^[^/]*", 0))
    best = fits.groupBy("url").agg(
        F.max(F.when(site, F.struct(F.length("rule").alias("a"), host_length.alias("b"), "rule", "action"))).alias("s"),
        F.max(F.when(~site, F.struct((F.col("action") == "allow").alias("a"), F.length("rule").alias("b"), "rule", "action"))).alias("p"),
    )
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("url").cast("string").alias("url"))
    return rows.join(best, "url", "left").select(
        "row.*", host_of(url).alias("host"), path_of(url).alias("path"), F.col("s.rule").alias("rule"), F.col("p.rule").alias("pattern"),
        F.coalesce("s.action", "p.action", F.lit(default)).alias("verdict"),
    )


def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = [spark.createDataFrame(r, "rule string, action string") for r in (SITE_RULES, PATTERN_RULES)]
    return judge_urls(pages, *rules).drop("url")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
sites(rule, rhost, rpath, action) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
patterns(pattern, regex, action) AS (VALUES
  ('||ads-track.', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?ads-track\.', 'block'),
  ('||spam-farm.', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?spam-farm\.', 'block'),
  ('||casino-win.', '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?casino-win\.', 'block'),
  ('^adserver^', '([^a-z0-9_.%-]|$)adserver([^a-z0-9_.%-]|$)', 'block'),
  ('/banner*/click^', '/banner.*/click([^a-z0-9_.%-]|$)', 'block'),
  ('|ftp://', '^ftp://', 'block'), ('.exe|', '\.exe$', 'block'),
  ('^utm_campaign^sponsored^', '([^a-z0-9_.%-]|$)utm_campaign([^a-z0-9_.%-]|$)sponsored([^a-z0-9_.%-]|$)', 'block'),
  ('/spam-farm/help/', '/spam-farm/help/', 'allow'))
SELECT page_id, host, path, rule, pattern, coalesce(s, p, 'allow') AS verdict FROM (
  SELECT page_id, host, path,
    (SELECT arg_max(rule, length(rule)) FROM sites WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
    (SELECT arg_max(action, length(rule)) FROM sites WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS s,
    (SELECT arg_max(pattern, (action = 'allow', length(pattern), pattern)) FROM patterns WHERE regexp_matches(low, '(?s)' || regex)) AS pattern,
    (SELECT arg_max(action, (action = 'allow', length(pattern), pattern)) FROM patterns WHERE regexp_matches(low, '(?s)' || regex)) AS p
  FROM u)"""
