"""The similarity join against all pairs in numpy."""

import numpy as np
import pytest

from mosaiq.operators import simjoin


def clustered(seed, n, centres, dim, noise):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    return c[r.integers(0, centres, n)] + noise * r.normal(size=(n, dim))


def brute(rows, threshold, labelled):
    first = {}
    for i, v, w in rows:
        if i is not None and v is not None:
            key = (tuple(v), w if labelled else 0)
            first.setdefault(key, []).append(i)
    reps = [(min(ids), len(ids), np.array(v), w) for (v, w), ids in first.items()]
    unit = [x / (np.linalg.norm(x) + 1e-9) for _, _, x, _ in reps]
    found = set()
    for s, (a, na, x, w) in enumerate(reps):
        for t in range(s):
            b, nb, y, z = reps[t]
            if w == z and len(x) == len(y) and unit[s] @ unit[t] >= threshold:
                found.add(tuple(sorted([(a, na), (b, nb)])))
    return {(a, b, na, nb) for (a, na), (b, nb) in found}


@pytest.mark.parametrize("threshold, labelled", [(0.95, False), (0.7, True), (0.3, False), (0.0, True), (-0.2, False)])
def test_join_equals_all_pairs(spark, monkeypatch, threshold, labelled):
    monkeypatch.setattr(simjoin, "BLOCK", 40)
    x = clustered(1, 260, 12, 6, 0.35)
    rows = [(i, [float(f) for f in v], [None, "a", "b"][i % 3] if i % 2 else "a") for i, v in enumerate(x)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 3)] + [(2000 + i, rows[7][1], "a") for i in range(90)]
    rows += [(3000, None, "a"), (3001, [0.0] * 6, "a"), (3002, [0.0] * 6, "a"), (3003, [1.0, 2.0], "a"), (3004, [2.0, 4.1], "a"), (3005, [], None), (None, rows[3][1], "a"), (3006, [1e-200] * 6, "b")]
    df = spark.createDataFrame(rows, "id long, v array<double>, kind string").repartition(5)
    found = simjoin.threshold_pairs(df, "id", "v", threshold, "kind" if labelled else None).collect()
    got = [(r["a"], r["b"], r["a_copies"], r["b_copies"]) for r in found]
    assert len(got) == len(set(got)) and set(got) == brute(rows, threshold, labelled)
    assert all(r["sim"] >= threshold for r in found)


def test_few_pairs_of_clustered_vectors_are_compared(spark):
    x = clustered(2, 6000, 60, 32, 0.15)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    n = len(x)
    assert simjoin.compared(df, "id", "v", 0.85) < 0.05 * n * (n - 1) / 2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert simjoin.threshold_pairs(df, "id", "v", 0.85).count() == (np.triu(unit @ unit.T, 1) >= 0.85).sum()


def test_join_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert simjoin.threshold_pairs(none, "id", "v", 0.9).count() == 0
    assert simjoin.threshold_pairs(spark.createDataFrame([(1, None)], "id long, v array<double>"), "id", "v", 0.9).count() == 0
