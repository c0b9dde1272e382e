"""Shards of near-equal bytes by histogram sort.

Documents are ordered by a key of hexadecimal digits: the head of their text's
digest, then the digest of their id, so equal texts lie next to each other and
a group of any size can still be cut.  The splitters are the byte quantiles of
that order.  Each round counts the exact bytes below candidate boundaries -
the digits of the bins that still hold a splitter - across all partitions; only
those bins are probed again, with two more digits, until a splitter is exact to
``tolerance`` bytes.  The splitters then stand in the plan as literals, at most
one for each shard, and the rows are exchanged once, by shard and a stretch of
keys of at most about ``bin_rows`` rows, inside which they are numbered; what
stands before a stretch comes from counts of the key table.

A round brings at most 256 counts for each shard to the driver, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.rows import table
from scriptoria.session import cut_lineage

N_SHARDS = 40
BIN_ROWS = 100_000
# Digits of the text's digest in the key, digits that a round adds, digits in all.
TEXT_DIGITS, ROUND_DIGITS, KEY_DIGITS = 8, 2, 40
# Stretches over ``bin_rows`` that are broadcast to be cut further; more of them meet the rows by a shuffle.
BROADCAST_STRETCHES = 50_000


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")


def key_of(doc_id: Column, text: Column) -> Column:
    of = lambda c: F.md5(F.coalesce(c.cast("string"), F.lit("")))
    return F.concat(F.substring(of(text), 1, TEXT_DIGITS), of(doc_id))


class Splitters:
    """(smallest key, shard) of each shard that has rows, in order, and the bins that each round probed further."""

    def __init__(self) -> None:
        self.opened: list[list[str]] = []
        self.bounds: list[tuple[str, int]] = []

    def shard(self, key: Column) -> Column:
        smallest = F.array(*[F.lit(k) for k, _ in self.bounds])
        return F.element_at(F.array(*[F.lit(n).cast("int") for _, n in self.bounds]), F.size(F.filter(smallest, lambda k: k <= key)))


def find_splitters(keyed: DataFrame, n_shards: int = N_SHARDS, tolerance: int = 0) -> Splitters:
    """``keyed`` has ``key`` and ``size``; it is read once for each round, so it should be stored."""
    out, digits = Splitters(), ROUND_DIGITS
    leaves = _counts(keyed, digits)
    while True:
        total, below, opened = sum(b for b, _ in leaves.values()), 0, []
        for prefix in sorted(leaves):
            size, rows = leaves[prefix]
            # A splitter lies inside unless the first and the last byte fall into one shard.
            cut = below * n_shards // total != (below + size - 1) * n_shards // total
            if cut and size > tolerance and rows > 1 and len(prefix) == digits < KEY_DIGITS:
                opened.append(prefix)
            below += size
        if not opened:
            break
        out.opened.append(opened)
        part = keyed.where(F.substring("key", 1, digits).isin(opened))
        digits += ROUND_DIGITS
        for prefix in opened:
            del leaves[prefix]
        leaves |= _counts(part, digits)
    below, first = 0, {}
    for prefix in sorted(leaves):
        size = leaves[prefix][0]
        # With a tolerance the middle of a bin decides; else a bin that is cut holds one key, and its start decides.
        first.setdefault((below + (size // 2 if tolerance else 0)) * n_shards // total, prefix)
        below += size
    out.bounds = [(prefix if k else "", shard) for k, (shard, prefix) in enumerate(sorted(first.items()))] or [("", 0)]
    return out


def _counts(keyed: DataFrame, digits: int) -> dict[str, tuple[int, int]]:
    counted = keyed.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    return {r["prefix"]: (r["b"], r["n"]) for r in counted.toLocalIterator()}


def stretches(keyed: DataFrame, bin_rows: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``stretch``, a head of the key, to rows with a ``key``.

    Heads are as long as even keys of that number of rows ask for.  A head with
    more than ``bin_rows`` rows, as of a text that many documents share, is
    continued into the digest of the ids.
    """
    rows, digits = keyed.count(), 1
    while digits < TEXT_DIGITS and rows > bin_rows // 2 * 16**digits:
        digits += 1
    head = F.substring("key", 1, digits)
    large = keyed.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bin_rows)
    n_large, largest = large.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_large:
        return lambda df: df.withColumn("stretch", head)
    more = 1
    while TEXT_DIGITS + more < KEY_DIGITS and largest > bin_rows // 2 * 16**more:
        more += 1
    marked = cut_lineage(large.select("head"))
    marked = F.broadcast(marked) if n_large <= BROADCAST_STRETCHES else marked

    def add(df: DataFrame) -> DataFrame:
        longer = F.when(F.col("head").isNotNull(), F.substring("key", 1, TEXT_DIGITS + more)).otherwise(head)
        return df.join(marked, head == F.col("head"), "left").withColumn("stretch", longer).drop("head")

    return add


def place(rows: DataFrame, keyed: DataFrame, splitters: Splitters, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``, whose keys are those of ``keyed``."""
    cut = stretches(keyed, bin_rows)
    shard = splitters.shard(F.col("key"))
    counts = cut(keyed.select("key")).groupBy(shard.alias("shard"), "stretch").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("shard").orderBy("stretch")
    before = counts.select("shard", "stretch", (F.sum("n").over(along) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy("key")) - 1
    numbered = cut(rows.withColumn("shard", shard)).withColumn("inside", inside)
    return numbered.join(before, ["shard", "stretch"]).withColumn("slot", F.col("first") + F.col("inside")).drop("stretch", "first", "inside")


def key_table(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key: what the rounds need, stored once."""
    text = F.col("text").cast("string")
    return cut_lineage(
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), size_of(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), key_of(F.col("doc_id"), text).alias("key"),
        )
    )


def shard_table(documents: DataFrame, n_shards: int = N_SHARDS, tolerance: int = 0, bin_rows: int = BIN_ROWS) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: with c the bytes of all rows before a row in key order,
    its shard is floor(c * n_shards / all bytes), so no shard is off by more
    than one document.  Rows that repeat doc_id and text have one key; they
    share a shard and get slots of their own.  A null text has no bytes, a
    null doc_id counts as an empty one, an empty table gives no rows, a very
    long text is its size and digest, other columns are not read.
    """
    keyed = key_table(documents)
    return place(keyed, keyed, find_splitters(keyed, n_shards, tolerance), bin_rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_documents(documents: DataFrame, n_shards: int = N_SHARDS, tolerance: int = 0, bin_rows: int = BIN_ROWS) -> DataFrame:
    """All columns of ``documents`` with ``shard`` and ``slot``, which replace columns of those names."""
    keyed = key_table(documents).select("key", "size")
    own = [c for c in documents.columns if c.lower() not in ("shard", "slot")]
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), key_of(F.col("doc_id"), F.col("text")).alias("key"))
    return place(packed, keyed, find_splitters(keyed, n_shards, tolerance), bin_rows).select("row.*", "shard", "slot")


def op6_sharding(spark, sf_dir):
    return shard_table(table(spark, sf_dir, "documents"))


_CRC_STEP = "CASE WHEN c{0} & 1 = 1 THEN xor(c{0} >> 1, 3988292384) ELSE c{0} >> 1 END AS c{1}"


def _crc_table() -> str:
    """SQL of the byte table of CRC-32 (polynomial EDB88320 reflected), eight shifts for each byte."""
    sql = "SELECT range AS b, range AS c0 FROM range(256)"
    for k in range(8):
        sql = f"SELECT b, {_CRC_STEP.format(k, k + 1)} FROM ({sql})"
    return f"SELECT list(c8 ORDER BY b) AS t FROM ({sql})"


# Every text as hexadecimal digits; the bytes go through the table one after the other.
OP6_SQL = f"""
WITH crc AS ({_crc_table()}),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(strlen(text), 0) + 16 AS size,
         md5(coalesce(text, ''))[:{TEXT_DIGITS}] || md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
p AS (
  SELECT doc_id, size, key, text,
         sum(size) OVER (ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(size) OVER (PARTITION BY key) AS below,
         sum(size) OVER () AS total
  FROM d),
s AS (SELECT doc_id, size, key, text, CAST(below * {N_SHARDS} // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size,
       xor(list_reduce(
         list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s, crc"""
