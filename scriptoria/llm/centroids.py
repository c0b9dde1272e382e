"""Centroid clustering (Lloyd) with ns-bounds.

Vectors are integers, so distances, sums and means are exact on every machine
and in every order.  Each vector keeps, beside its cluster, an upper bound of
its distance to its own centroid and one lower bound for each group of
centroids, every one with the round in which it was last measured.  The
history of all centroids is kept: in a later round a bound is loosened by the
norm of the total displacement between the centroid of that round and the
present one - ``ns``, the norm of the sum - and not by the sum of the moves of
the rounds between, which is never smaller.  A vector whose upper bound stays
below all lower bounds keeps its cluster without a look at any centroid; the
others first measure their own centroid and then, exactly, every group whose
bound still fails.  Ties always fail, so the smaller number wins them.

Sums of clusters are not added up again: a round sends only what left and
entered a cluster, summed in each batch, so no cluster - one may hold a third
of all rows - is ever brought together.  The state of a round is stored; only
k centroids and their sums reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.rows import column_of, map_slices, table
from scriptoria.session import cut_lineage

DIMENSIONS, SCALE = 64, 64
CLUSTERS, ROUNDS, SEED = 16, 3, "1"
# Centroids that share one lower bound.
GROUP = 8
# Components whose squared distances are sure to fit a long.
MOST = 1 << 27
ROWS = 4096
# Bounds are compared with this relative slack, far above the rounding of a square root.
SLACK = 1e-9
_WIDTHS = ((np.int8, 1 << 7), (np.int16, 1 << 15), (np.int32, 1 << 31))


def pack(vector: np.ndarray) -> bytes:
    """Integers as bytes of the smallest width that holds them all; the length tells the width."""
    low, high = (int(vector.min()), int(vector.max())) if len(vector) else (0, 0)
    return vector.astype(next(kind for kind, most in _WIDTHS if -most <= low and high < most)).tobytes()


def unpack(packed: pa.Array, dimensions: int) -> np.ndarray:
    """One row of int64 for each packed vector."""
    values = packed.to_pylist()
    out = np.zeros((len(values), dimensions), dtype=np.int64)
    widths = np.array([len(v) // dimensions for v in values])
    for kind, _ in _WIDTHS:
        at = np.flatnonzero(widths == np.dtype(kind).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(values[k] for k in at), dtype=kind).reshape(len(at), dimensions)
    return out


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with exactly ``dimensions`` components, all finite."""
    values = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = values.where((F.size("v") == dimensions) & F.forall("v", finite)).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("x"))
    too_far = F.exists("x", lambda c: F.abs(c) >= MOST)
    return kept.withColumn("x", F.when(too_far, F.raise_error(F.concat(F.lit("component too large for exact distances, vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))).otherwise(F.col("x")))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in that order; fewer if there are fewer."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact, by floats where every partial sum is an integer they hold."""
    most = max((int(np.abs(a).max()) for a in (x, centroids) if a.size), default=0)
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 52 else np.int64
    a, b = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


@dataclass
class Assignment:
    """State of a batch of vectors: bounds and the rounds in which they were measured."""

    cluster: np.ndarray
    upper: np.ndarray
    upper_round: np.ndarray
    lower: np.ndarray
    lower_round: np.ndarray
    measured: int = field(default=0)  # distances computed, for tests and figures


class Bounds:
    """Assignment to the last of ``history`` (rounds x k x dimensions) by ns-bounds."""

    def __init__(self, history: np.ndarray, group: int = GROUP):
        self.history = np.asarray(history)
        rounds, k, _ = self.history.shape
        self.groups = [np.arange(g, min(g + group, k)) for g in range(0, k, group)]
        # Norm of the total displacement since each round, of each centroid and the largest of each group.
        self.moved = np.sqrt(((self.history - self.history[-1]).astype(np.float64) ** 2).sum(axis=2))
        self.moved_group = np.stack([self.moved[:, g].max(axis=1) for g in self.groups], axis=1)
        self.now, self.centroids = rounds - 1, self.history[-1]

    def first(self, x: np.ndarray) -> Assignment:
        """All distances measured."""
        d = squared_distances(x, self.centroids)
        cluster = d.argmin(axis=1)
        n, rows = len(x), np.arange(len(x))
        upper = np.sqrt(d[rows, cluster].astype(np.float64))
        s = Assignment(cluster, upper, np.full(n, self.now), np.zeros((n, len(self.groups))), np.full((n, len(self.groups)), self.now), d.size)
        for g, numbers in enumerate(self.groups):
            s.lower[:, g] = self._least_other(d[:, numbers], cluster[:, None] == numbers[None, :])
        return s

    @staticmethod
    def _least_other(d: np.ndarray, own: np.ndarray) -> np.ndarray:
        least = np.where(own, np.iinfo(np.int64).max, d).min(axis=1)
        return np.where(least == np.iinfo(np.int64).max, np.inf, np.sqrt(least.astype(np.float64)))

    def _fails(self, s: Assignment, at: np.ndarray) -> np.ndarray:
        """Which groups of the rows ``at`` may hold a centroid that is as near as the own one."""
        upper = s.upper[at] + self.moved[s.upper_round[at], s.cluster[at]]
        lower = s.lower[at] - self.moved_group[s.lower_round[at], np.arange(len(self.groups))[None, :]]
        slack = SLACK * (1 + upper[:, None] + np.where(np.isinf(s.lower[at]), 0, s.lower[at]))
        return upper[:, None] + slack >= lower

    def step(self, x: np.ndarray, s: Assignment) -> Assignment:
        """The state after the centroids have moved to the last of the history."""
        at = np.flatnonzero(self._fails(s, np.arange(len(x))).any(axis=1))
        # Tighten by the own centroid first.
        own = ((x[at] - self.centroids[s.cluster[at]]) ** 2).sum(axis=1)
        s.upper[at], s.upper_round[at] = np.sqrt(own.astype(np.float64)), self.now
        s.measured += len(at)
        fails = self._fails(s, at)
        at, own, fails = at[fails.any(axis=1)], own[fails.any(axis=1)], fails[fails.any(axis=1)]
        # Rescan the groups that fail; a group that holds doesn't hold the nearest centroid.
        old = s.cluster[at].copy()
        best, where = own.copy(), old.copy()
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for g, numbers in enumerate(self.groups):
            rows = np.flatnonzero(fails[:, g])
            if not len(rows):
                continue
            d = squared_distances(x[at[rows]], self.centroids[numbers])
            s.measured += d.size
            least = d.argmin(axis=1)
            near = d[np.arange(len(rows)), least]
            nearer = (near < best[rows]) | ((near == best[rows]) & (numbers[least] < where[rows]))
            best[rows[nearer]], where[rows[nearer]] = near[nearer], numbers[least[nearer]]
            found.append((g, rows, d))
        for g, rows, d in found:
            s.lower[at[rows], g] = self._least_other(d, where[rows][:, None] == self.groups[g][None, :])
            s.lower_round[at[rows], g] = self.now
        # The old centroid is one of the others now: where its group was not rescanned, its distance bounds the group.
        changed = where != old
        for g, numbers in enumerate(self.groups):
            rows = np.flatnonzero(changed & ~fails[:, g] & np.isin(old, numbers))
            now = np.maximum(s.lower[at[rows], g] - self.moved_group[s.lower_round[at[rows], g], g], 0)
            s.lower[at[rows], g] = np.minimum(now, np.sqrt(own[rows].astype(np.float64)))
            s.lower_round[at[rows], g] = self.now
        s.cluster[at], s.upper[at], s.upper_round[at] = where, np.sqrt(best.astype(np.float64)), self.now
        return s


_STATE = "vec_id bigint, x binary, cluster int, was int, distance bigint, upper double, upper_round int, lower binary, lower_round binary"


def _assign(rows: DataFrame, history: np.ndarray, group: int, first: bool) -> DataFrame:
    """The state after an assignment; ``was`` is the cluster before it (-1: none)."""
    bounds, n_groups, dimensions = Bounds(history, group), -(-history.shape[1] // group), history.shape[2]

    def run(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        if first:
            x = column_of(batch, "x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dimensions)
            packed = [pack(v) for v in x]
            s, was = bounds.first(x), np.full(n, -1)
        else:
            packed = column_of(batch, "x")
            x = unpack(packed, dimensions)
            number = lambda c: column_of(batch, c).to_numpy(zero_copy_only=False).copy()
            blob = lambda c, kind: np.frombuffer(b"".join(column_of(batch, c).to_pylist()), dtype=kind).reshape(n, n_groups).copy()
            was = number("cluster").astype(np.int64)
            s = bounds.step(x, Assignment(was.copy(), number("upper"), number("upper_round").astype(np.int64), blob("lower", np.float64), blob("lower_round", np.int32).astype(np.int64)))
        distance = ((x - bounds.centroids[s.cluster]) ** 2).sum(axis=1)
        return {
            "vec_id": column_of(batch, "vec_id"), "x": packed, "cluster": s.cluster.astype(np.int32), "was": was.astype(np.int32), "distance": distance,
            "upper": s.upper, "upper_round": s.upper_round.astype(np.int32), "lower": [r.tobytes() for r in s.lower],
            "lower_round": [r.tobytes() for r in s.lower_round.astype(np.int32)],
        }

    return map_slices(rows, _STATE, run, ROWS)


def _changes(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """What entered less what left each cluster: counts (k) and sums (k x dimensions)."""

    def run(batch: pa.RecordBatch) -> dict:
        was, now = (column_of(batch, c).to_numpy(zero_copy_only=False) for c in ("was", "cluster"))
        x = unpack(column_of(batch, "x"), dimensions)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        np.add.at(counts, now, 1)
        np.add.at(sums, now, x)
        left = was >= 0
        np.subtract.at(counts, was[left], 1)
        np.subtract.at(sums, was[left], x[left])
        used = np.flatnonzero(counts.astype(bool) | sums.any(axis=1))
        place = np.tile(np.arange(-1, dimensions, dtype=np.int32), len(used))
        return {"cluster": np.repeat(used, dimensions + 1).astype(np.int32), "place": place, "value": np.concatenate([counts[used, None], sums[used]], axis=1).ravel()}

    moved = map_slices(state.where("was <> cluster").select("x", "cluster", "was"), "cluster int, place int, value bigint", run, ROWS)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
    for c, place, value in moved.groupBy("cluster", "place").agg(F.sum("value")).collect():  # k x (dimensions + 1) rows at most
        if place < 0:
            counts[c] = value
        else:
            sums[c, place] = value
    return counts, sums


def cluster_vectors(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED, group: int = GROUP
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept row of ``vectors`` (vec_id, embedding), and the final centroids.

    Rows whose vector is null, has another length or a component that is null
    or not finite are left out.  A component beyond 2^27 after scaling stops
    the job with its vec_id, since distances would not fit a long.  Repeated
    rows count each; a null vec_id hashes as an empty one.  With fewer than k
    vectors there are as many centroids; equal distances go to the smaller
    number, equal hashes to the smaller vector.  An empty table gives no rows.
    Other columns are not read.
    """
    rows = integer_vectors(vectors, dimensions, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).where("false"), np.zeros((0, dimensions), np.int64)
    history, counts, sums = [centroids], np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    state = cut_lineage(_assign(rows, np.stack(history), group, True))
    for _ in range(rounds):
        entered, added = _changes(state, len(centroids), dimensions)
        counts, sums = counts + entered, sums + added
        history.append(np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], history[-1]))
        state = cut_lineage(_assign(state, np.stack(history), group, False))
    return state.select("vec_id", "cluster", "distance"), history[-1]


def op11_centroid_clustering(spark, sf_dir):
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    sums = found.groupBy("cluster").agg(F.sum("distance").cast("bigint").alias("cluster_inertia")).collect()  # one row for each centroid
    total = sum(r.cluster_inertia for r in sums)
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(r.cluster, r.cluster_inertia, total, name[r.cluster]) for r in sums], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    near = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIMENSIONS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS n, x AS c FROM k ORDER BY sha256('{SEED}:' || vec_id), x LIMIT {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, min(struct_pack(d := CAST({near} AS BIGINT), n := n)) AS b FROM k, c{r} GROUP BY vec_id, x)")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT n, p, CAST(sum(v) AS BIGINT) AS s, count(*) AS m FROM (SELECT b.n AS n, unnest(x) AS v, unnest(range(1, {DIMENSIONS + 1})) AS p FROM a{r}) GROUP BY n, p)")
            steps.append(f"m{r} AS (SELECT n, list((s - ((s % m) + m) % m) // m ORDER BY p) AS c FROM s{r} GROUP BY n)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT n, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (n))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(b.n AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.n) AS BIGINT) AS cluster_inertia,
       CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON b.n = n"""


# The rounds, written out.
OP11_SQL = _sql()
