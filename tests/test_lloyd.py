"""Many k-means models in one scan, silhouettes and mini-batches, against numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import cluster, lloyd


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(6, 8))[r.integers(0, 6, 700)] * 2 + 0.4 * r.normal(size=(700, 8))
    y = r.normal(size=(700, 8))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>").repartition(5)
    return x, y, df.union(spark.createDataFrame([(900, None, None), (901, [0.0] * 8, None)], df.schema)).cache()


def plain(x, centres, rounds, tol):
    c, inertia = centres.copy(), None
    for _ in range(rounds):
        d = ((x[:, None] - c) ** 2).sum(-1)
        at, inertia = d.argmin(1), d.min(1).sum()
        new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        moved, c = np.sqrt(((new - c) ** 2).sum(1)).max(), new
        if moved <= tol:
            break
    return c, inertia


def test_models_in_one_scan_equal_single_fits(data, spark, monkeypatch):
    x, y, df = data
    models, wanted = [], []
    for k, start, w in [(1, 0, (1.0, 0.0)), (3, 1, (1.0, 0.5)), (6, 2, (0.3, 1.7)), (9, 3, (2.0, 0.1))]:
        mix = w[0] * x + w[1] * y
        models.append(lloyd.Model(f"{k}", mix[start * 20 : start * 20 + k], w))
        wanted.append(plain(mix, models[-1].centres, 12, 1e-4))
    for most in (8_000_000, 30):
        monkeypatch.setattr(lloyd, "MAX_COMPONENTS", most)
        for m, (c, inertia) in zip(lloyd.fit_many(df, ["x", "y"], models, 12, 1e-4), wanted):
            assert np.allclose(m.centres, c) and m.inertia == pytest.approx(inertia) and m.sizes.sum() == 700


def test_a_round_is_one_job_whatever_the_number_of_models(data, spark):
    x, _, df = data
    sc = spark.sparkContext
    jobs = []
    for n in (1, 12):
        sc.setJobGroup(f"many{n}", "")
        lloyd.fit_many(df, ["x"], [lloyd.Model(str(i), x[i : i + 4]) for i in range(n)], 4, 0.0)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"many{n}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_silhouettes_by_squared_distance(data):
    x, _, df = data
    c = plain(x, x[:5], 5, 0.0)[0]
    models = [lloyd.Model("5", c), lloyd.Model("1", c[:1]), lloyd.Model("far", np.vstack([c, np.full((1, 8), 1e6)]))]
    d = ((x[:, None] - x) ** 2).sum(-1)
    at = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
    s = []
    for i in range(len(x)):
        a = d[i, at == at[i]].sum() / ((at == at[i]).sum() - 1)
        b = min(d[i, at == j].mean() for j in set(at) - {at[i]})
        s.append((b - a) / max(a, b))
    rows = df.where("id < 700")
    assert lloyd.silhouettes(rows, ["x"], models) == pytest.approx([np.mean(s), 0.0, np.mean(s)])
    assert lloyd.silhouettes(df.where("false"), ["x"], models[:1]) == [0.0]


def test_seeds_and_assignment(data):
    x, _, df = data
    order = sorted(range(700), key=lambda i: hashlib.md5(f"5|{i}".encode()).hexdigest())
    rows = df.where("id < 700")
    assert np.allclose(lloyd.seeds(rows, "x", "id", 9, 5), x[order[:9]])
    assert len(lloyd.seeds(rows.limit(3), "x", "id", 9, 5)) == 3
    got = {r["id"]: (r["cluster"], r["d"]) for r in lloyd.assign(df, "x", x[:4], distance="d").collect()}
    d = ((x[:, None] - x[:4]) ** 2).sum(-1)
    assert got[900] == (None, None) and all(got[i][0] == d[i].argmin() and got[i][1] == pytest.approx(d[i].min()) for i in range(700))


def test_minibatch_comes_near_full_rounds(data):
    x, _, df = data
    rows = df.where("id < 700")
    mini = lloyd.fit_minibatch(rows, "x", "id", 6, batch_rows=100, epochs=4, seed=3)
    full = lloyd.fit_many(rows, ["x"], [lloyd.Model("full", lloyd.seeds(rows, "x", "id", 6, 3))], 30)[0]
    inertia = lambda c: ((x[:, None] - c) ** 2).sum(-1).min(1).sum()
    assert mini.sizes.sum() == 4 * 700 and mini.rounds == 28
    assert inertia(mini.centres) < 1.05 * inertia(full.centres)


def test_grid_of_weights_covers_all_rows(data):
    x, y, df = data
    rows = df.where("id < 700")
    grid = cluster.weight_grid(rows, "x", "y", "id", steps=4, k=3, starts=2, rounds=5)
    assert len(grid) == 16
    known = {(round(r["a"], 3), round(r["b"], 3)): r["silhouette"] for r in grid}
    assert known[0.1, 0.1] == known[2.0, 2.0]
    a, b = grid[1]["a"], grid[1]["b"]
    best = None
    for seed in (42, 43):
        order = sorted(range(700), key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())[:3]
        mix = x + b / a * y
        c, inertia = plain(mix, mix[order], 5, 1e-4)
        if best is None or inertia < best[0]:
            best = inertia, lloyd.silhouettes(rows, ["x", "y"], [lloyd.Model("", c, (1.0, b / a))])[0]
    assert grid[1]["silhouette"] == pytest.approx(best[1])
