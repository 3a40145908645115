"""Findings of round 3 on growth: the encoder's fit, comparisons of reductions and the grid of weights."""

import hashlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import text as T
from mosaiq.operators import lloyd, stats
from mosaiq.plans import catalogue


def test_terms_are_counted_as_they_are_listed_and_hashed_once_a_word(monkeypatch):
    texts = ["b A a\tb\nB ", None, "", " \x0b ", "one\x1ctwo \xa0three İ 　", "x" * 300, "a a a"]
    hashed = Counter()
    monkeypatch.setattr(T, "hashlib", SimpleNamespace(md5=lambda w: hashed.update([w]) or hashlib.md5(w)))
    got = T.counted_terms(pa.array(texts), 97)
    assert max(hashed.values()) == 1
    for most in (1, 20, 1 << 20):
        lengths, terms, counts = T.counted_terms(pa.array(["skipped", *texts]).slice(1), 97, most)
        assert all((a == b).all() for a, b in zip(got, (lengths, terms, counts)))
        ends = np.cumsum(lengths)
        for text, n, end in zip(texts, lengths, ends):
            part = slice(end - n, end)
            assert dict(zip(terms[part], counts[part])) == Counter(T.terms_of(text or "", 97)) and (np.diff(terms[part]) > 0).all()
    assert [len(x) for x in T.counted_terms(pa.array([], pa.string()), 97)] == [0, 0, 0]


def test_the_encoder_reads_texts_once(spark, sf_dir):
    found = catalogue.fitted_encoder(spark, sf_dir)
    assert not [f for f in found.inputFiles() if "documents.parquet" in f]
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def _counted(df, spark):
    """``df``, and how many of its rows have been computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


def test_quality_of_clusters_takes_two_scans(spark):
    x = np.random.default_rng(6).normal(size=(300, 4)) + 3
    at = [None if i % 50 == 0 else i % 3 for i in range(300)]
    df = spark.createDataFrame([*((a, v.tolist()) for a, v in zip(at, x)), (1, [1.0]), (2, None)], "kind int, v array<double>").repartition(3)
    rows, seen = _counted(df, spark)
    got = stats.cluster_quality(rows, "kind", "v", 4).first()
    assert seen.value <= 2 * 302
    parts = [x[[a == j for a in at]] for j in range(3)]
    c, s = [p.mean(0) for p in parts], [np.linalg.norm(p - p.mean(0), axis=1) for p in parts]
    worst = [max((s[i].mean() + s[j].mean()) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)]
    n = sum(map(len, parts))
    between = sum(len(p) * ((m - x.mean(0)) ** 2).sum() for p, m in zip(parts, c))
    assert got["k"] == 3 and got["n"] == n and got["davies_bouldin"] == pytest.approx(np.mean(worst))
    assert got["calinski_harabasz"] == pytest.approx(between / 2 / (sum((t**2).sum() for t in s) / (n - 3)))


def test_agreement_of_labels_takes_one_scan(spark):
    rows, seen = _counted(spark.range(0, 200, 1, 3).select((F.col("id") % 4).alias("a"), (F.col("id") % 7).alias("b")), spark)
    assert -1 <= stats.adjusted_rand(rows, "a", "b").first()["ari"] < 0.1
    assert seen.value == 200


def test_many_models_are_multiplied_at_a_time(monkeypatch):
    r = np.random.default_rng(8)
    a, b = r.normal(size=(2, 90, 6))
    models = [lloyd.Model(str(i), r.normal(size=(k, 6)), (1.0, float(w))) for i, (k, w) in enumerate(zip([1, 3, 3, 5, 3, 5] * 20, r.random(120) * 3))]
    models.append(lloyd.Model("ties", np.ones((4, 6)), (2.0, 0.5)))
    assert len(list(lloyd._Sums(models).blocks(90, 6))) == 4
    for block in (1 << 18, 200):
        monkeypatch.setattr(lloyd, "BLOCK", block)
        got = {(i, j): line for i, j, line in lloyd._Sums(models).every([a, b])}
        assert len(got) == sum(len(m.centres) for m in models)
        for i, m in enumerate(models):
            x = m.weights[0] * a + m.weights[1] * b
            far = ((x[:, None] - m.centres) ** 2).sum(-1)
            for j in range(len(m.centres)):
                mine = far.argmin(1) == j if m.name != "ties" else np.full(90, j == 0)
                assert got[i, j][0] == mine.sum()
                assert np.allclose(got[i, j], [mine.sum(), far[mine, j].sum(), (x[mine] ** 2).sum(), *x[mine].sum(0)])
