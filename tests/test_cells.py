"""Search in cells and in blocks on both sides, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import topk


def _clustered(n, dim, groups, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, groups, n)] + rng.normal(scale=0.03, size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def _asked(df):
    return df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _lists(found):
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def _brute(x, k):
    return {i: sorted((j for j in range(len(x)) if j != i), key=lambda j: (-(x[i] @ x[j]), j))[:k] for i in range(0, len(x), 20)}


def test_clustered_vectors_need_few_cells(spark):
    x = _clustered(4000, 16, 60)
    df = _table(spark, x)
    q = _asked(df).cache()
    index = topk.CellIndex(df)
    probes = index.probes_for(q, 10, 0.95)
    assert probes <= len(index.centres) // 4
    want = _brute(x, 10)
    got = _lists(index.search(q, 10, probes))
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9
    first = index.search(q, 10, 4)
    looked = q.count() * 4 + index.further_cells(q, first, 10, 4).count()
    assert looked <= q.count() * len(index.centres) / 4  # bounds rule out the rest
    for copy in (0, 700, topk.COPY):  # by cells alone, some queries against all rows, all of them
        assert _lists(index.search_exact(q, 10, 4, copy=copy)) == want


@pytest.mark.parametrize("components,most,slab", [(8_000_000, 8_000_000, 64_000_000), (40, 600, 60)])
def test_exact_search_whatever_the_shape(spark, monkeypatch, tmp_path, components, most, slab):
    x = np.random.default_rng(9).integers(-2, 3, size=(300, 4)).astype(float)  # many ties, zero vectors, repeated ones
    x[200:] = x[0]  # a third in one cell
    df = _table(spark, x)
    index = topk.CellIndex(df, 9)
    index.save(str(tmp_path / "index"))
    monkeypatch.setattr(topk, "MAX_COMPONENTS", components)
    monkeypatch.setattr(topk, "MAX_SCORES", most)
    monkeypatch.setattr(topk, "SLAB_COMPONENTS", slab)
    loaded = topk.CellIndex.load(spark, str(tmp_path / "index"))
    for some in (index, loaded):
        assert _lists(some.search_exact(_asked(df), 7, 1, copy=0)) == _brute(x, 7)
    assert _lists(topk.batch_search(df, _asked(df), 7)) == _brute(x, 7)


def test_names_nulls_and_lengths(spark, monkeypatch):
    rows = [("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", None), (None, [9.0, 9.0]), ("d", [3.0]), ("e", [2.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    want = {"a": ["b"], "b": ["a"], "d": ["e"], "e": ["d"]}
    assert _lists(topk.batch_search(df, q, 3)) == want
    monkeypatch.setattr(topk, "MAX_COMPONENTS", 2)
    assert _lists(topk.batch_search(df, q, 3)) == want
    assert topk.batch_search(df.where("false"), q, 3).count() == 0
    assert topk.batch_search(df, q.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        topk.CellIndex(df.where("false"))
