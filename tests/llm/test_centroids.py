import hashlib
import math

import numpy as np
import pytest

from gridweave.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, v string, cluster int"


def brute(rows, k=16, rounds=3):
    """Plain rounds over (vec_id, whole components)."""
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    cents = [rows[i][1] for i in order[:k]]
    near = lambda v: min(range(len(cents)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, cents[j])), j))
    for _ in range(rounds):
        own = [near(v) for _, v in rows]
        for j in range(len(cents)):
            if mine := [v for (_, v), o in zip(rows, own) if o == j]:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = [near(v) for _, v in rows]
    dist = [sum((a - b) ** 2 for a, b in zip(v, cents[o])) for (_, v), o in zip(rows, own)]
    return sorted((i, o, d, sum(x for x, p in zip(dist, own) if p == o), sum(dist), hashlib.sha256(",".join(map(str, cents[o])).encode()).hexdigest()) for (i, _), o, d in zip(rows, own, dist))


def result(spark, data, dims=64, k=16, rounds=3):
    state, cents = C.clustered(C.whole_vectors(spark.createDataFrame(data, SCHEMA), dims), k, rounds)
    return state, sorted(tuple(r) for r in C.described(state, cents).collect())


@pytest.mark.parametrize("spread", [0.02, 5.0, 100_000.0])
def test_against_plain_rounds(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(7, 64)) * spread * 3
    vectors = (centres[rng.integers(0, 7, 300)] + rng.normal(size=(300, 64)) * spread).astype(np.float32)
    data = [(i, [float(x) for x in v], "a", 1) for i, v in enumerate(vectors)]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in data]
    _, got = result(spark, data)
    assert got == brute(whole)


def test_bounds_hold_and_spare_scans(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 64)) * 4
    data = [(i, [float(x) for x in (centres[i % 16] + rng.normal(size=64) * 0.2).astype(np.float32)], "a", 1) for i in range(800)]
    state, cents = C.clustered(C.whole_vectors(spark.createDataFrame(data, SCHEMA)), rounds=6)
    rows = state.collect()
    assert sum(r.scanned for r in rows) < len(rows) / 2
    for r in rows:
        others = [math.dist(r.v, c) for j, c in enumerate(cents) if j != r.cluster]
        assert r.lower <= min(others) * (1 + 1e-9) + 1e-6


def test_loss_is_less_than_the_drift_and_never_less_than_true():
    rng = np.random.default_rng(1)
    tighter = 0
    for _ in range(300):
        old = rng.normal(size=(3, 5)) * 10
        new = old + rng.normal(size=(3, 5))
        r = float(rng.uniform(0, 8))
        loss = C.loosening(old.tolist(), new.tolist(), [r, 0.0, 0.0])[0]
        full = max(np.linalg.norm(new[j] - old[j]) for j in (1, 2))
        assert loss <= full * (1 + 1e-6) + 1e-6
        tighter += loss < 0.98 * full
        x = rng.normal(size=(200, 5))
        x = old[0] + r * x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0, 1, (200, 1)) ** 0.2
        for j in (1, 2):
            assert (np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() <= loss + 1e-6
    assert tighter > 100


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, [0.5, -0.5], "x", 9), (1, [0.5, -0.5], "x", 9), (None, [3.0, 3.0], None, None), (2, [1.0], None, 1), (3, None, None, 1), (4, [None, 1.0], "", 1), (5, [nan, 1.0], "", 1), (6, [inf, 1.0], "", 1), (7, [3e30, 1.0], "", 1), (8, [3.0, 3.0], "", 1)]
    state, cents = C.clustered(C.whole_vectors(spark.createDataFrame(data, SCHEMA), 2), 16, 2)
    out = C.described(state, cents).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in out) == [(False, 1), (False, 1), (False, 8), (True, 0)]
    assert all(r.distance == 0 and r.inertia == 0 for r in out)  # as many centroids as vectors; equals go to the smaller number
    state, cents = C.clustered(C.whole_vectors(spark.createDataFrame([], SCHEMA), 2), 16, 2)
    assert C.described(state, cents).count() == 0


def test_ties_go_to_the_smaller_number_and_floors_are_exact(spark):
    data = [(i, [float(x)], "", 0) for i, x in enumerate([-1.0, 1.0, 0.0, -0.015625, 0.015625, -3.0])]
    whole = [(i, [math.floor(64 * v[0])]) for i, v, *_ in data]
    assert result(spark, data, dims=1, k=2)[1] == brute(whole, k=2)
