"""Vectors, assignment, labels: against numpy and worked cases."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators import joins, labels, stats, topk

GOLDEN = [
    ([[-0.090, 0.183, -0.089, -0.006, -0.011], [-0.007, -0.021, 0.081, 0.002, -0.049], [-0.205, -0.021, -0.089, 0.382, -0.063], [0.355, -0.231, 0.183, -0.191, -0.123], [-0.272, 0.003, -0.170, 0.065, 0.411]], [1, 2, 3, 0, 4], 0),
    ([[-0.037, 0.310, -0.141, -0.053, -0.120], [0.032, -0.143, 0.302, -0.245, -0.026], [0.365, -0.068, 0.090, -0.127, -0.169], [-0.171, -0.038, -0.149, 0.373, -0.078], [-0.076, -0.090, 0.012, -0.065, 0.297]], [1, 2, 0, 3, 4], 0),
    ([[0.025, 0.080, -0.043, 0.039, -0.130], [-0.041, -0.014, 0.015, 0.016, 0.002], [0.091, -0.075, 0.077, 0.006, -0.117], [-0.144, 0, -0.077, 0.158, 0.029], [-0.090, -0.046, -0.066, 0.130, 0.085]], [1, 2, 0, 3, 4], 4),
    ([[0.90, 0.80, 0.10], [0.85, 0.10, 0.05], [0.20, 0.30, 0.25]], [1, 0, 2], None),
]


def _matrix(spark, m):
    return spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(m) for j, x in enumerate(r)], "anchor int, cluster int, sim double")


@pytest.mark.parametrize("m,best,low", GOLDEN)
def test_assignment_and_margins(spark, m, best, low):
    sims = _matrix(spark, m)
    assert [r["cluster"] for r in labels.assign(sims).orderBy("anchor").collect()] == best
    if low is not None:
        assert labels.margins(sims).where("low_conf").count() == low


def test_least_cost_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        c = rng.normal(size=(n, n)).round(1)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        got = labels.least_cost(c)
        assert sorted(got) == list(range(n)) and abs(c[np.arange(n), got].sum() - best) < 1e-9


def test_large_assignment_matches_driver(spark):
    m = np.random.default_rng(1).normal(size=(9, 9))
    got = labels.assign(_matrix(spark, m.tolist())).orderBy("anchor").collect()
    assert [r["cluster"] for r in got] == labels.least_cost(-m).tolist()


def test_vector_edges(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "i int, v array<float>")
    got = {r["i"]: r for r in df.select("i", V.norm(F.col("v")).alias("n"), V.normalise(F.col("v")).alias("u"), V.dot(F.col("v"), F.array(F.lit(1.0), F.lit(1.0))).alias("d")).collect()}
    assert got[1]["n"] == 5 and got[1]["u"] == [0.6, 0.8] and got[1]["d"] == 7
    assert got[2]["u"] == [0.0, 0.0] and got[3]["n"] is None and got[4]["d"] is None


@pytest.mark.parametrize("d,h", [([1.0] * 5, 1.609438), ([1.0, 2, 4, 4, 4], 1.427061), ([0.0, 1, 1, 1, 1], 7.7e-7)])
def test_entropy(spark, d, h):
    got = spark.range(1).select(labels.soft_entropy(F.array(*map(F.lit, map(float, d))))).first()[0]
    assert abs(got - h) < 1e-6


def test_top2(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.9]), (3, [-1.0, -1.0])], "i int, v array<double>")
    centres = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 1.0])], "type string, centroid array<double>")
    got = {r["i"]: (r["type1"], r["type2"]) for r in labels.top2_types(df, F.col("v"), centres, ["i"], 0.95).collect()}
    assert got == {1: ("a", None), 2: ("b", None)}


def test_topk_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    exact = topk.batch_search(df, q, 3)
    for r in exact.collect():
        assert r["vec_id"] == np.argsort(-s[r["query_id"]], kind="stable")[r["rank"] - 1]
    full = topk.CellIndex(df, 4).search(q, 3, 4)
    assert topk.recall(full, exact) == 1.0
    assert [r["vec_id"] for r in topk.search(df, x[0].tolist(), 300, exclude=[0, 1]).collect()][:1] != [0]
    assert topk.search(df, x[0].tolist(), 300, exclude=[0, 1]).count() == 198


def test_align_policies(spark):
    a = spark.createDataFrame([(1,), (2,)], "uuid int")
    b = spark.createDataFrame([(1, [1.0, 2.0])], "uuid int, v array<float>")
    assert joins.align(a, b, "uuid", "v", 2, "drop").count() == 1
    assert {r["uuid"]: r["v"] for r in joins.align(a, b, "uuid", "v", 2, "zero").collect()}[2] == [0.0, 0.0]
    with pytest.raises(KeyError):
        joins.align(a, b, "uuid", "v", 2)


def test_attach_score(spark):
    cards = spark.createDataFrame([("a",), ("b",), ("c",)], "uuid string")
    scores = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("b", "x", 2)], "uuid string, score string, ord int")
    assert {r["uuid"]: r["score"] for r in joins.attach_score(cards, scores, "uuid", "score").collect()} == {"a": 2.0, "b": 0.0, "c": 0.0}


def test_stats(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4, 1.0)], "x double")
    r = df.agg(*stats.bundle("x")).first()
    assert abs(r["mean"] - 0.4) < 1e-12 and r["p50"] == 0.3 and abs(r["p95"] - 0.88) < 1e-12
    assert tuple(df.where("x > 5").agg(*stats.bundle("x")).first()) == (0, 0, 0, 0, 0, 0)
    pairs = spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "a int, b int")
    assert stats.adjusted_rand(pairs, "a", "b").first()["ari"] == 1.0
