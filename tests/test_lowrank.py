"""Subspaces by random projections against the exact decomposition, and the encoder fitted by them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import encode
from mosaiq.functions import text as T
from mosaiq.functions import vectors as V
from mosaiq.operators import lowrank


def _table(n=600, dim=20, seed=3):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, 5)) * [9, 7, 5, 4, 3] @ r.normal(size=(5, dim)) + 0.05 * r.normal(size=(n, dim)) + 4


def test_components_span_the_exact_subspace(spark):
    x = _table()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    found = lowrank.components(df, "v", 20, 5)
    centred = x - x.mean(0)
    _, values, exact = np.linalg.svd(centred, full_matrices=False)
    cosines = np.linalg.svd(exact[:5] @ found.basis)[1]
    assert cosines.min() > 1 - 1e-9
    assert np.allclose(found.variances, values[:5] ** 2 / len(x), rtol=1e-6) and np.isclose(found.total, (centred**2).sum() / len(x))
    rows = {r["id"]: r for r in found.project(df, "v").collect()}
    left = centred - centred @ exact[:5].T @ exact[:5]
    assert all(abs(rows[i]["residual"] - (left[i] ** 2).sum()) < 1e-6 for i in range(len(x)))
    assert np.allclose([np.dot(rows[0]["projected"], rows[0]["projected"])], [(centred[0] @ exact[:5].T @ exact[:5] @ centred[0])])


def test_vectors_that_cannot_be_used_have_no_coordinates(spark):
    good = [[1.0, 2.0, 3.0], [2.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    bad = [None, [], [1.0], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good + bad)], "id int, v array<double>")
    found = lowrank.components(df, "v", 3, 2)
    assert np.allclose(found.mean, np.mean(good, axis=0))
    rows = {r["id"]: r for r in found.project(df, "v").collect()}
    assert all(rows[i]["residual"] < 1e-9 and len(rows[i]["projected"]) == 2 for i in range(3))
    assert all(rows[i]["residual"] is None and rows[i]["projected"] is None for i in range(3, 9))
    none = lowrank.components(df.where("id > 2"), "v", 3, 2)
    assert none.total == 0 and not none.variances.any()
    same = lowrank.components(spark.createDataFrame([([1.0, 2.0],)] * 4, "v array<double>"), "v", 2, 1)
    assert np.allclose(same.variances, 0) and np.isclose(same.total, 0)


def test_terms_are_the_same_in_tables_and_in_texts(spark):
    texts = ["", "  ", "A b\tB a\nÄ ä", "x" * 5000, "one\x1ctwo three four", "İ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.term_buckets(F.col("t"), 97).alias("b")).collect()
    assert [r["b"] for r in rows] == [T.terms_of(t, 97) for t in texts]
    assert spark.sql("select cast(null as string) t").select(T.term_buckets(F.col("t"), 97)).first()[0] == []


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    topics = [[f"{t}{i}" for i in range(40)] for t in ("sea", "law", "oven", "star")]
    texts = [" ".join(r.choices(topics[i % 4], k=60)) for i in range(200)]
    texts += [texts[i].replace(" ", " also ", 1) for i in range(20)] + ["", None]
    return texts, spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(6)


def test_near_copies_are_encoded_close_and_topics_apart(corpus, spark):
    texts, df = corpus
    model = lowrank.fit_terms(df, "text", 8, 4096)
    found = {r["id"]: np.array(r["v"]) for r in df.withColumn("v", encode.encoded("text", lambda: model)).collect()}
    cosine = lambda a, b: found[a] @ found[b] / (np.linalg.norm(found[a]) * np.linalg.norm(found[b]))
    assert min(cosine(i, 200 + i) for i in range(20)) > 0.98
    assert max(abs(cosine(0, i)) for i in (1, 2, 3, 5, 6, 7)) < 0.3
    assert not found[220].any() and not found[221].any()


def test_fitted_terms_against_a_dense_table(corpus):
    texts, df = corpus
    model = lowrank.fit_terms(df, "text", 4, 512, rounds=6)
    counts = np.zeros((len(texts), 512))
    for i, t in enumerate(texts):
        for b in T.terms_of(t or "", 512):
            counts[i, b] += 1
    x = counts * (np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    exact = np.linalg.svd(x, full_matrices=False)[2][:4]
    assert np.linalg.svd(exact @ model.basis)[1].min() > 0.999
    assert np.allclose(model.encode([texts[3]])[0], x[3] @ model.basis)


def test_parts_of_sparse_rows_do_not_change_the_sum(spark, corpus, monkeypatch):
    _, df = corpus
    whole = lowrank.fit_terms(df, "text", 3, 256)
    monkeypatch.setattr(lowrank, "_ENTRIES", 1)
    assert np.allclose(lowrank.fit_terms(df.coalesce(1), "text", 3, 256).basis, whole.basis, atol=1e-8)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "text string")
    model = lowrank.fit_terms(empty, "text", 2, 64)
    assert np.isfinite(model.encode(["a b"])).all()
    vectors = spark.createDataFrame([], "v array<float>")
    assert lowrank.components(vectors, "v", 4, 2).project(vectors, "v").count() == 0
    assert vectors.select(V.norm(F.col("v"))).count() == 0
