"""Operators that were made for size, with their bounds lowered: the same results as by brute force."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators import cluster, diversity, grouping, prompts, quantiles, stats, topk
from mosaiq.sources import tables


def test_percentiles_and_order_statistics(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(x)) for g in ("a", "b", None) for x in rng.choice([rng.normal(), 1.0, 2.0, 5.5], size=rng.integers(1, 90))] + [("a", None), ("c", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.937, 1.0]
    got = {r["g"]: r["p"] for r in quantiles.percentiles(quantiles.counts(df, F.col("x"), F.col("g")), shares).collect()}
    for g in ("a", "b", "c", None):
        x = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(got[g], np.quantile(x, shares))
    every = sorted(v for _, v in rows if v is not None)
    found = quantiles.order_statistics(quantiles.counts(df, F.col("x")), [0, 3, len(every) - 1, len(every)]).collect()
    assert {r["rank"]: r["value"] for r in found} == {k: every[k] for k in (0, 3, len(every) - 1)}
    assert quantiles.percentiles(quantiles.counts(df.limit(0), F.col("x")), [0.5]).count() == 0


def test_bundles_of_groups(spark):
    rows = [("a", 1.0), ("a", 4.0), ("b", None), (None, 2.0)]
    got = {r["k"]: r for r in stats.bundle_by(spark.createDataFrame(rows, "k string, x double"), "k", "x", over=1.5).collect()}
    assert (got["a"]["mean"], got["a"]["p50"], got["a"]["n"], got["a"]["over"]) == (2.5, 2.5, 2, 0.5) and got["a"]["std"] == pytest.approx(np.std([1, 4], ddof=1))
    assert got["b"]["n"] == 0 and got["b"]["mean"] == 0 and got[None]["n"] == 1 and got["ALL"]["n"] == 3


def test_prefixes_with_sparse_ids(spark):
    """Prefixes count rows, whatever their ids."""
    rows = [(10**6 * i, w) for i, ws in enumerate(["a b", "b", "c", "a", "a"]) for w in ws.split()]
    items = spark.createDataFrame(rows, "i long, w string")
    got = stats.prefix_saturation(items.select("i").distinct(), items, "i", "w", [1, 2, 3]).orderBy("prefix").collect()
    assert [(r["prefix"], r["n_unique"], r["saturated"]) for r in got] == [(1, 2, False), (2, 2, True), (3, 3, False), (5, 3, False)]


def test_best_of_resolves_ties_by_id():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = int(rng.integers(1, 30)), int(rng.integers(1, 12))
        ids, scores = np.stack([rng.permutation(n) for _ in range(3)]), rng.integers(0, 4, size=(3, n)).astype(float)
        a, b = topk.best_of(ids, scores, k)
        for i in range(3):
            want = sorted(zip(-scores[i], ids[i]))[:k]
            assert list(zip(-b[i], a[i])) == want


@pytest.mark.parametrize("components,most", [(8_000_000, 8_000_000), (40, 600)])
def test_search_in_parts(spark, monkeypatch, components, most):
    monkeypatch.setattr(topk, "MAX_COMPONENTS", components)
    monkeypatch.setattr(topk, "MAX_SCORES", most)
    x = np.random.default_rng(5).integers(-2, 3, size=(300, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    q = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    apart = q.select("query_id", (F.col("query_id") + 1).alias("vec_id"))
    got: dict = {}
    for r in topk.batch_search(df, q, 7, exclude=apart).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i in range(0, 300, 20):
        assert got[i] == sorted((j for j in range(300) if j not in (i, i + 1)), key=lambda j: (-(x[i] @ x[j]), j))[:7]


@pytest.mark.parametrize("walked,block", [(2_000_000, 1024), (3, 16), (0, 16)])
def test_greedy_groups_of_any_size(spark, monkeypatch, walked, block):
    monkeypatch.setattr(grouping, "WALKED", walked)
    monkeypatch.setattr(grouping, "BLOCK", block)
    x = np.random.default_rng(8).normal(size=(90, 3))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(90, None, 1)], "vec_id long, v array<double>, c int")
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    near = (u @ u.T >= 0.8) & (np.arange(90)[:, None] % 3 == np.arange(90) % 3)
    pairs = grouping.similar_pairs(df, "vec_id", "v", "c", 0.8)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near))) if a != b}
    heads: list[int] = []
    for i in range(91):
        if i == 90 or not any(near[i, h] for h in heads):
            heads.append(i)
    assert sorted(r["id"] for r in grouping.heads(df, pairs, "vec_id").collect()) == heads


def test_means_of_long_vectors(spark):
    x = np.random.default_rng(3).normal(size=(40, 5120))
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "g int, v array<double>")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(V.mean_by_position("v").alias("m")).collect()}
    assert all(np.allclose(got[g], x[g::2].mean(axis=0)) for g in (0, 1))


def test_regress_out_is_least_squares(spark):
    rng = np.random.default_rng(4)
    z, kind, x = rng.normal(size=60), rng.integers(0, 3, 60), rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist(), float(z[i]), str(kind[i])) for i, v in enumerate(x)], "i int, v array<double>, z double, k string")
    s = (z - z.mean()) / z.std()
    design = np.stack([np.ones(60), s, s * s, kind == 1, kind == 2], axis=1).astype(float)
    want = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
    got = cluster.regress_out(df, "v", 4, ["z"], ["k"]).orderBy("i").select("residual").collect()
    assert np.allclose([r["residual"] for r in got], want)


def test_spherical_kmeans(spark):
    rng = np.random.default_rng(6)
    truth = rng.normal(size=(3, 8)) * 5
    at = np.arange(120) % 3
    x = truth[at] + rng.normal(size=(120, 8)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    centres, inertia = cluster.spherical_kmeans(df, "v", "i", 3)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert inertia == pytest.approx((2 - 2 * (u @ centres.T).max(axis=1)).sum(), abs=1e-3)
    got = {r["i"]: r["cluster"] for r in cluster.by_cosine(df.select("i", V.normalise(F.col("v")).alias("u")), "u", centres).collect()}
    assert len({(at[i], c) for i, c in got.items()}) == 3


def test_silhouette_against_definition(spark):
    rng = np.random.default_rng(7)
    x, lab = rng.normal(size=(70, 3)), rng.integers(0, 4, 70)
    lab[:1] = 9  # alone
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(70):
        own = [j for j in range(70) if lab[j] == lab[i] and j != i]
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - d[i, own].mean()) / max(b, d[i, own].mean()) if own else 0)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, lab))], "i int, v array<double>, c int")
    assert stats.silhouette(df, "i", "c", "v").first()[0] == pytest.approx(np.mean(s), abs=1e-6)


def test_pairs_of_a_large_group(spark):
    df = spark.createDataFrame([(1, i, f"w{i}") for i in range(60)] + [(2, 0, "x")], "g int, o int, t string")
    assert diversity.pairs(df, "g", "o", "t").count() == 60 * 59 // 2


def test_templates(spark):
    df = spark.createDataFrame([("n{b}", None), ("x", "y")], "a string, b string")
    text = prompts.filled(F.lit("{a}-{b}-{c}{a}}{"), {"a": F.col("a"), "b": F.col("b")})
    assert [r[0] for r in df.select(text).collect()] == ["n{b}--{c}n{b}}{", "x-y-{c}x}{"]
    guides = spark.createDataFrame([(1, "g1"), (2, "g2")], "type int, guide string")
    panel = spark.createDataFrame([(1, "사회적 소비"), (2, None), (3, "자기 중심적")], "i int, tag string")
    got = {r["i"]: (r["type"], r["prompt"]) for r in prompts.system_prompts(panel, [(2, "B {guide}"), (1, "A {type}")], guides, {"type": F.col("type")}).collect()}
    assert got == {1: (2, "A 2\n\nB g2"), 2: (1, "A 1\n\nB g1"), 3: (5, "A 5\n\nB ")}
    answers = spark.createDataFrame([(1, "one"), (2, "two")], "type int, text string")
    assert {r["i"]: r["text"] for r in prompts.table_answers(panel, answers).collect()} == {1: "two", 2: "one", 3: "one"}


def test_mapping_is_one_object(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "ä")], "key int, label string")
    tables.write_mapping(df, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("*.txt"))
    assert text.strip() == '{"1":"ä","2":"b"}'
    assert sorted(map(tuple, tables.read_mapping(spark, str(tmp_path / "m")).collect())) == [("1", "ä"), ("2", "b")]


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from mosaiq import runtime

    class Context:
        master = "spark://x"

    class Session:
        conf = {"spark.checkpoint.dir": None}
        sparkContext = Context()

    with pytest.raises(ValueError):
        runtime.shared_base(Session())
    assert runtime.shared_base(spark)
