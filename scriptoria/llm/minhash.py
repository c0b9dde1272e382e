"""Near-duplicates by MinHash with tensored banding, confirmed on full sets.

A document's set is its distinct shingles of consecutive words.  Two small
collections, A and B, hold ``width`` groups of ``depth`` minhashes each; a table
of the index takes one group of A and one of B as its key, so 2 x width groups
give width x width tables, and minhashes are computed for the root of what as
many independent tables would need.  At a similarity of 0.8 a pair misses all
tables with a probability of 2e-6, far less above it.

Keys are formed only where they can meet: two documents share the table (i, j)
only if they share group i of A and group j of B, so a first exchange finds, for
each document, the groups that any other document shares; the table keys
are the pairs of these.

Within a table's bucket no pairs are listed.  Its centre is the member whose
groups most others share - the original rather than one of its variants - and
each other member is compared with it; linked ones form components.  Only where
a comparison has failed, all that were compared with that centre meet once more by the rarest
shingles of their sets - an exact filter that passes every pair that can be
linked - and pairs of different components are compared, so no link between two
components is lost.  Equal sets are one node all along.  A centre's members are compared as a stream that holds one
set; a centre with many is dealt out to several tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.rows import byte_texts, column_of, map_slices, table
from scriptoria.llm.wordhash import mixed, word_hashes
from scriptoria.session import cut_lineage

SHINGLE_WORDS = 2
# Link where 100 * intersection >= PERCENT * union.
PERCENT = 80
WIDTH, DEPTH = 26, 4
# Members of one centre that one task compares, and ids that may be broadcast (some 64 MB).
CENTRE_ROWS = 500
BROADCAST_ROWS = 2_000_000

_rng = np.random.default_rng(20_251_201)
_SCALE = _rng.integers(1, 1 << 63, size=2 * WIDTH * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, size=2 * WIDTH * DEPTH, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes | None], shingle_words: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text, A-Z lower-cased, as 64-bit fingerprints.

    Fewer words than a shingle are one shingle; no words are an empty set.
    """
    h, lengths = word_hashes(texts)
    out, at = [], 0
    total = h[: max(0, len(h) - shingle_words + 1)].copy()
    for j in range(1, shingle_words):
        total = mixed(total * _A + h[j : j + len(total)])
    for n in lengths.tolist():
        if n >= shingle_words:
            out.append(np.unique(total[at : at + n - shingle_words + 1]))
        elif n:
            whole = np.full(1, n, dtype=np.uint64)
            for x in h[at : at + n]:
                whole = mixed(whole * _B + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minhashes of a set that is not empty."""
    least = np.full(len(_SCALE), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 256):
        part = shingles[at : at + 256, None] * _SCALE[None, :] + _SHIFT[None, :]
        least = np.minimum(least, part.min(axis=0))
    return least


def group_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each group of minhashes: 2 x WIDTH for each row; the number of the group goes into the key."""
    groups = signatures.reshape(len(signatures), 2 * WIDTH, DEPTH)
    key = np.broadcast_to(np.arange(1, 2 * WIDTH + 1, dtype=np.uint64), groups.shape[:2])
    for k in range(DEPTH):
        key = mixed(key * _A + mixed(groups[:, :, k]))
    return key.astype(np.int64)


def _name(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for the set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sets(documents: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (null for an empty set) and group keys of each row."""
    def run(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(byte_texts(batch), shingle_words)
        full = [k for k, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if full:
            for k, row in zip(full, group_keys(np.stack([signature(sets[k]) for k in full]))):
                keys[k] = row
        own = {c: column_of(batch, c) for c in ("doc_id", "text_hash")}
        return own | {"n_shingles": [len(s) for s in sets], "node": [_name(s) for s in sets], "keys": keys}

    return map_slices(documents.withColumn("text_hash", F.xxhash64("text")), "doc_id bigint, text_hash bigint, n_shingles bigint, node binary, keys array<bigint>", run)


def _shared_groups(nodes: DataFrame) -> DataFrame:
    """(id, size, score, a, b): the groups of A and B that a second node shares, and how many share them in all."""
    groups = nodes.select("id", F.posexplode("keys").alias("i", "key"))
    shared = groups.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("_n > 1")
    half = lambda low: F.collect_list(F.when((F.col("i") < WIDTH) == F.lit(low), F.col("key")))
    found = shared.groupBy("id").agg(F.sum("_n").alias("score"), half(True).alias("a"), half(False).alias("b"))
    return found.where("size(a) > 0 AND size(b) > 0").join(nodes.select("id", F.col("n_shingles").alias("size")), "id")


def _buckets(groups: DataFrame) -> DataFrame:
    """(bucket, id, size, c) of all tables; c is the bucket's centre."""
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    rows = groups.select(F.explode(pairs).alias("bucket"), "id", "size", "score")
    return rows.withColumn("c", F.max(F.struct("score", "id", "size")).over(Window.partitionBy("bucket"))).drop("score")


def _fits(percent: int):
    """Sets of these sizes can be similar enough."""
    least, most = F.least("x_size", "y_size"), F.greatest("x_size", "y_size")
    return least * 100 >= most * percent


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    """A hint behind a count of the stored rows; beyond the bound Spark shuffles the join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts_of(wanted: DataFrame, documents: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """(id, text) of one document of each node among ``wanted``."""
    members = cut_lineage(nodes.join(wanted.select("id").distinct(), "id").select("id", "node", F.col("doc_id").alias("_doc")))
    def named(batch: pa.RecordBatch) -> dict:
        """An id may stand in several rows of documents: only a text that gives the node passes."""
        made = [_name(s) == node for s, node in zip(shingle_sets(byte_texts(batch), shingle_words), column_of(batch, "node").to_pylist())]
        right = batch.filter(pa.array(made))
        return {c: column_of(right, c) for c in ("id", "text")}

    texts = documents.join(_broadcast_if_small(members), F.expr("doc_id <=> _doc")).select("id", "node", "text")
    return map_slices(texts, "id bigint, text string", named).groupBy("id").agg(F.min("text").alias("text"))


def _close_pairs(texts: DataFrame, labels: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Pairs (x, y) of different components among ``texts`` (id, text) that can be similar enough, by their rarest shingles.

    With the shingles of each set in order of rarity, two sets that share at
    least o of them share one among the first size - o + 1 of each.  Variants of
    one text that are too far apart begin with shingles of their own, so they
    do not meet, though they share most of the text.
    """
    def run(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(byte_texts(batch), shingle_words)
        return {"id": column_of(batch, "id"), "size": [len(s) for s in sets], "shingles": [s.astype(np.int64) for s in sets]}

    sets = cut_lineage(map_slices(texts, "id bigint, size bigint, shingles array<bigint>", run))
    tokens = sets.select("id", "size", F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Shingles of one set only come first; how many there are is what matters.
    shared = tokens.join(common, "token").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ranked"))
    own = F.col("size") - F.size("ranked")
    first = F.floor(F.col("size") * (100 - percent) / 100) + 1
    heads = shared.where(own < first).select("id", "size", own.alias("own"), F.posexplode(F.slice("ranked", F.lit(1), (first - own).cast("int"))).alias("k", "r"))
    heads = heads.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select(
        "id", "size", F.coalesce("label", "id").alias("label"), (F.col("own") + F.col("k")).alias("place"), F.col("r.token").alias("token")
    )
    # The smaller set needs a shorter head: what it must share with one of its own size at least.
    least = F.ceil(F.col("size") * 2 * percent / (100 + percent))
    small = heads.where(F.col("place") <= F.col("size") - least)
    x, y = (df.select("token", *(F.col(c).alias(f"{n}_{c}") for c in ("id", "size", "label", "place"))) for df, n in ((small, "x"), (heads, "y")))
    overlap = F.ceil((F.col("x_size") + F.col("y_size")) * percent / (100 + percent))
    fits = (
        ((F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_id") < F.col("y_id"))))
        & (F.col("x_label") != F.col("y_label")) & _fits(percent)
        & (F.col("x_place") <= F.col("x_size") - overlap) & (F.col("y_place") <= F.col("y_size") - overlap)
    )
    met = x.join(y.withColumnRenamed("token", "_token"), (F.col("token") == F.col("_token")) & fits)
    return met.select(F.col("x_id").alias("x"), F.col("y_id").alias("y")).distinct()


def _confirmed(pairs: DataFrame, documents: DataFrame, nodes: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Add ``linked`` to distinct pairs of ids (x, y) from their full sets, made again from one document of each.

    Under each x, and part of its pairs, comes the text of x and then those of its ys.
    """
    pairs = cut_lineage(pairs.select("x", "y"))
    counts = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / CENTRE_ROWS).alias("parts"))
    dealt = pairs.join(counts, "x").select("x", F.pmod(F.xxhash64("y"), F.col("parts")).alias("part"), F.col("y").alias("id"), F.lit(1).alias("place"))
    heads = counts.select("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("x").alias("id"), F.lit(0).alias("place"))
    wanted = dealt.unionByName(heads)
    texts = _texts_of(wanted, documents, nodes, shingle_words)
    rows = wanted.join(texts, "id").select("x", "part", "place", "id", "text").repartition("x", "part").sortWithinPartitions("x", "part", "place")
    centre: list = [None, np.zeros(0, np.uint64)]

    def compared(batch: pa.RecordBatch) -> dict:
        x, place, y = (column_of(batch, c).to_pylist() for c in ("x", "place", "id"))
        out: dict[str, list] = {"x": [], "y": [], "linked": []}
        for c, at, other, own in zip(x, place, y, shingle_sets(byte_texts(batch), shingle_words)):
            if at == 0:
                centre[:] = c, own
                continue
            both = len(np.intersect1d(centre[1], own, assume_unique=True))
            for name, value in zip(out, (c, other, 100 * both >= percent * (len(centre[1]) + len(own) - both))):
                out[name].append(value)
        return out

    return map_slices(rows, "x bigint, y bigint, linked boolean", compared)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of connected nodes from links (x, y): the least node that each can reach.

    Rounds take the least label among neighbours and then the label of the
    label, so chains shorten by half and more; each round is stored.
    """
    both = cut_lineage(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut_lineage(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = hooked.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved"))
        after = cut_lineage(after)
        moved = after.where("moved").limit(1).count()
        labels = after.drop("moved")
        if not moved:
            return labels


def near_duplicates(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept, text_hash.

    ``component_id`` is the smallest doc_id reachable over links.  An empty
    set - a null text or one without words - is linked with nothing and has
    its own doc_id.  Rows that repeat a doc_id count by their texts; a null
    doc_id is never a component's id unless all its rows have none.  Equal
    sets are linked.  Very long texts are whole.  ``text_hash`` (xxhash64 of
    the text) tells rows that repeat a doc_id apart.  Other columns are not
    read; an empty table gives no rows.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut_lineage(_sets(texts, shingle_words))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")
    )
    # Short names for the nodes; they are fixed once they are stored.
    nodes = cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()))
    groups = cut_lineage(_shared_groups(nodes))
    buckets = _buckets(groups)
    star = buckets.where("id <> c.id").select(
        F.col("c.id").alias("x"), F.col("id").alias("y"), F.col("c.size").alias("x_size"), F.col("size").alias("y_size")
    )
    tried = cut_lineage(star.distinct())
    near = cut_lineage(_confirmed(tried.where(_fits(percent)), texts, nodes, shingle_words, percent))
    links = near.where("linked").select("x", "y")
    failed = tried.select("x", "y").join(links, ["x", "y"], "left_anti")
    failed = cut_lineage(failed)
    labels, merged = components(links), None
    if failed.limit(1).count():
        label = lambda df, n: df.join(labels.select(F.col("node").alias(n), F.col("label").alias(f"{n}_label")), n, "left").withColumn(
            f"{n}_label", F.coalesce(f"{n}_label", n)
        )
        # A failed member that has meanwhile met the centre's component by another way needs no more.
        still = label(label(failed, "x"), "y").where("x_label <> y_label").select(F.col("x").alias("_c"), F.col("y").alias("_y"))
        # The members of a bucket are among those that its centre was compared with.
        centres = still.select(F.col("_c").alias("x")).distinct()
        involved = tried.join(centres, "x", "left_semi").select(F.explode(F.array("x", "y")).alias("id")).distinct()
        pairs = _close_pairs(_texts_of(involved, texts, nodes, shingle_words), labels, shingle_words, percent)
        met = _confirmed(pairs, texts, nodes, shingle_words, percent).where("linked")
        # Links between components, each once, however many of their members are linked.
        merged = components(label(label(met, "x"), "y").select(F.col("x_label").alias("x"), F.col("y_label").alias("y")).distinct())
    classes = nodes.select("node", "id", F.col("doc_id").alias("_least")).join(labels.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.withColumn("label", F.coalesce("label", "id"))
    if merged is not None:
        wider = merged.select(F.col("node").alias("label"), F.col("label").alias("_wider"))
        classes = classes.join(wider, "label", "left").withColumn("label", F.coalesce("_wider", "label"))
    ids = classes.groupBy("label").agg(F.min("_least").alias("component_id"))
    named = classes.select("node", "label").join(ids, "label").select("node", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash")
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "text_hash")


def keep_one_of_each(documents: DataFrame, shingle_words: int, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents``, all columns, that stand for their group of near-duplicates; each row is judged by its own text.

    The row with the smallest doc_id of a group stays, one where several have
    that id and the same text; of several texts under one id each that stands
    for its group.  Rows without words stay, one for each id and text; rows
    without id stay only where their whole group has none.
    """
    judged = near_duplicates(documents, shingle_words, percent).where("kept")
    kept = cut_lineage(judged.groupBy(F.col("doc_id").alias("_kept"), "text_hash").agg(F.count(F.lit(1)).alias("_n")))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("_own"), F.xxhash64(F.col("text").cast("string")).alias("_hash"), F.struct("*").alias("_row"))
    rows = rows.join(kept, F.expr("_own <=> _kept AND _hash = text_hash"), "left_semi")
    repeated = kept.where("_n > 1").limit(1).count() > 0
    return (rows.dropDuplicates(["_own", "_hash"]) if repeated else rows).select("_row.*")


def op7_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


# Only pairs whose sizes allow a link share shingles here; links spread by recursion.
OP7_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[p] || ' ' || w[p + 1] END AS k FROM w, unnest(range(1, greatest(len(w), 2))) AS r(p) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sized AS MATERIALIZED (SELECT doc_id, k, n FROM s JOIN n USING (doc_id)),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b ON a.k = b.k AND a.doc_id <> b.doc_id AND 100 * a.n >= {PERCENT} * b.n AND 100 * b.n >= {PERCENT} * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach(doc_id, id) AS (SELECT doc_id, doc_id FROM w UNION SELECT y, id FROM reach JOIN links ON x = reach.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(id) AS component_id, w.doc_id = min(id) AS kept
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id, n"""
