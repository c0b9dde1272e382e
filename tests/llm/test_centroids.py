"""Clustering by bounds against plain Lloyd rounds."""

import hashlib
import math

import numpy as np
import pytest

from scriptoria.llm import centroids as C

SCHEMA = "vec_id bigint, embedding array<double>, label int, cluster string, x string, upper string"


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0, "c", "x", "u") for i, v in data], SCHEMA)


def brute(data, k, rounds, dimensions, scale):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in data if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            members = [v for (_, v), o in zip(kept, own) if o == n]
            if members:
                centres[n] = [sum(c) // len(members) for c in zip(*members)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), centres


@pytest.mark.parametrize("k,rounds,group", [(5, 3, 2), (16, 6, 8), (3, 1, 1), (100, 2, 8)])
def test_lloyd(spark, k, rounds, group):
    rng = np.random.default_rng(k)
    hot = rng.normal(size=4)
    data = [(n, (hot if n % 3 == 0 else rng.normal(size=4) + 2 * (n % 5)).tolist()) for n in range(150)]
    data += [(7, data[7][1]), (7, data[8][1]), (None, [0.5, -0.25, 0.0, 1e5]), (None, [0.5, -0.25, 0.0, 0.125])]
    data += [(200, None), (201, []), (202, [1.0, 2.0, 3.0]), (203, [1.0, None, 2.0, 3.0]), (204, [1.0, float("nan"), 2.0, 3.0]), (205, [1.0, float("-inf"), 2.0, 3.0])]
    found, centres = C.cluster_vectors(frame(spark, data).repartition(5), k, rounds, 4, 8, group=group)
    rows, wanted = brute(data, k, rounds, 4, 8)
    assert sorted((tuple(r) for r in found.collect()), key=str) == rows and centres.tolist() == wanted


def test_ties_go_to_the_smaller_number(spark):
    data = [(n, [float(n % 4), float(n // 4 % 4)]) for n in range(64)]
    found, centres = C.cluster_vectors(frame(spark, data), 6, 4, 2, 1)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(data, 6, 4, 2, 1)[0]


def test_bounds_skip_and_stay_exact():
    """Bounds from the norm of the total displacement give the nearest centroid and measure less than all distances."""
    rng = np.random.default_rng(5)
    centre = rng.integers(-300, 300, (24, 6))
    x = np.concatenate([c + rng.integers(-40, 40, (60, 6)) for c in centre])
    history = [centre]
    state = C.Bounds(np.stack(history)).first(x)
    state.measured = 0
    for step in range(6):
        # Centroids that swing to and fro: the moves sum up, their sum does not.
        history.append(centre + (rng.integers(-15, 15, centre.shape) if step % 2 == 0 else rng.integers(-2, 2, centre.shape)))
        bounds = C.Bounds(np.stack(history))
        state = bounds.step(x, state)
        assert (state.cluster == C.squared_distances(x, history[-1]).argmin(axis=1)).all()
        summed = sum(np.sqrt(((b - a) ** 2).sum(axis=1)) for a, b in zip(history, history[1:]))
        assert (bounds.moved[0] <= summed + 1e-9).all()
    assert state.measured < 6 * len(x) * len(centre) / 3


def test_packing():
    for row in ([0, 127, -128], [128, 0, 0], [-32769, 5, 2**27 - 1]):
        import pyarrow as pa

        assert C.unpack(pa.array([C.pack(np.array(row)), C.pack(np.array([1, 2, 3]))]), 3).tolist() == [row, [1, 2, 3]]


def test_nothing_and_too_much(spark):
    found, centres = C.cluster_vectors(frame(spark, [(1, None)]))
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance"] and len(centres) == 0
    with pytest.raises(Exception, match="vec_id 9"):
        C.cluster_vectors(frame(spark, [(9, [1e30, 0.0])]), 2, 1, 2)[0].collect()
