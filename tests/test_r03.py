"""Findings of round 3: what the encoder, k-means, the searches and joins got wrong or did at too great a cost."""

import tracemalloc

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from mosaiq.functions import encode
from mosaiq.functions import text as T
from mosaiq.operators import lloyd, projection, simjoin, topk


def test_texts_whose_signs_cancel_are_not_zero():
    e = encode.HashingEncoder(32)
    v = e.encode(["Enenor heener bleon thndin.", "Lo que ta los.", " \t", ""])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 1, 0, 0])
    words = "Lo que ta los.".split()
    assert np.allclose(e.encode([" ".join(words[::-1])]), v[1])


def test_sizes_of_clusters_are_counts(spark):
    ids = spark.range(0, 40_000, 1, 7).select(F.col("id"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("v"))
    rows = ids.where("id % 3 < 2 OR id % 7 = 0")
    model = lloyd.Model("m", np.array([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]]))
    found = lloyd.fit_many(rows, ["v"], [model], 1)[0]
    wanted = [rows.where(f"id % 3 = {i}").count() for i in range(3)]
    assert [int(n) for n in found.sizes] == wanted and list(found.sizes) == wanted


def _unit(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_best_forms_few_scores_at_a_time():
    x = _unit(20_000, 16, 1)
    rows, best = pd.Series(list(x)), topk._Best(np.arange(2000), x[:2000], 10, True)
    tracemalloc.start()
    best.add(np.arange(len(x)), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    scores = x[:2000] @ x.T
    scores[np.arange(2000), np.arange(2000)] = -np.inf
    assert (best.ids == np.lexsort((np.broadcast_to(np.arange(len(x)), scores.shape), -scores), axis=1)[:, :10]).all()


def test_many_queries_are_cut_into_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "MAX_COMPONENTS", 1000)
    monkeypatch.setattr(topk, "PRODUCTS", 4000)
    x = _unit(400, 4, 2)
    df = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>")
    found = topk.batch_search(df, df.withColumnRenamed("vec_id", "query_id"), 3).orderBy("query_id", "rank").collect()
    scores = x @ x.T - 9 * np.eye(400)
    assert {(r[0], r[1]) for r in found} == {(f"r{i}", f"r{j}") for i, row in enumerate(np.argsort(-scores, axis=1)[:, :3]) for j in row}


def test_vectors_that_do_not_cluster_are_copied_once_a_group(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK", 64)
    monkeypatch.setattr(simjoin, "GROUPS", 4)
    x = _unit(800, 8, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    reps = simjoin._numbered(simjoin.distinct_vectors(df, "id", "v", 0.3))
    assert simjoin._deal(reps, 0.3).probes.count() <= 4 * 800
    found = {(r["a"], r["b"]) for r in simjoin.threshold_pairs(df, "id", "v", 0.3).collect()}
    assert found == set(zip(*(c.tolist() for c in np.nonzero(np.triu(x @ x.T, 1) >= 0.3))))


def test_cosine_sums():
    x = _unit(50, 6, 4)
    c = x[:3]
    got, at = lloyd.Cosines([c])(x, 0), (x @ c.T).argmax(1)
    for j in range(3):
        assert np.allclose(got[j], [(2 - 2 * x[at == j] @ c[j]).sum(), *x[at == j].sum(0)])


def test_fuzzy_weights_of_many_rows(spark):
    d = np.sort(np.random.default_rng(5).random((40, 6)), axis=1)
    d[0, :2] = 0
    w = projection._fuzzy(np.c_[d, np.full(40, np.inf)], 6)
    assert np.allclose(w.sum(1)[1:], np.log2(6)) and np.allclose(w[:, 0], 1) and (w[:, 6] == 0).all()
    rows = spark.createDataFrame([(i, r[: i % 7].tolist()) for i, r in enumerate(d)], "i long, d array<double>")
    for r in rows.select("i", projection.fuzzy_weights(F.col("d"), 6).alias("w")).collect():
        assert np.allclose(r["w"], projection._fuzzy(d[r["i"] : r["i"] + 1, : r["i"] % 7], 6)[0])


def test_runs_of_words_evaluate_the_words_once(spark):
    rows = spark.createDataFrame([("a b c d e f g",), ("a",), ("",)], "t string")
    found = rows.select(T.ngrams(T.tokens(F.col("t")), 2).alias("g")).collect()
    assert [r["g"] for r in found] == [["a b", "b c", "c d", "d e", "e f", "f g"], [], []]
    plan = rows.select(T.ngrams(T.tokens(F.col("t")), 2).alias("g"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


def test_a_mini_batch_is_one_stage(spark):
    rows = spark.range(0, 3000, 1, 3).select("id", F.array((F.col("id") % 5).cast("double"), F.lit(1.0)).alias("v"))
    spark.sparkContext.setJobGroup("mini", "mini")
    model = lloyd.fit_minibatch(rows, "v", "id", 3, batch_rows=1000, epochs=2)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getJobInfo(j).stageIds for j in tracker.getJobIdsForGroup("mini")][: model.rounds]
    spark.sparkContext.setJobGroup("", "")
    assert model.rounds == 6 and model.sizes.sum() == 6000
    assert all(len(s) == 1 for s in stages)
