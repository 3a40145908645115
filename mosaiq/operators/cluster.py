"""Clustering with ``pyspark.ml``: several starts, centred projection, regressing out covariates, stability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators import labels as names
from mosaiq.operators import lloyd, stats
from mosaiq.operators.sampling import exact_sample
from mosaiq.runtime import ship


@dataclass(frozen=True)
class Config:
    """The defaults of the offline steps."""

    k: int = 5
    starts: int = 10
    pca: int = 100
    seed: int = 42
    noise_percent: float = 10.0
    low_margin: float = 0.05


def kmeans(df: DataFrame, vector: str, k: int = 5, starts: int = 10, seed: int = 42, cosine: bool = False) -> KMeansModel:
    """The model of least cost among several starts. The input is read once and cached over the starts."""
    rows = df.select(array_to_vector(V.as_double(F.col(vector))).alias("features")).cache()
    kind = "cosine" if cosine else "euclidean"
    models = [KMeans(k=k, seed=seed + i, distanceMeasure=kind).fit(rows) for i in range(starts)]
    rows.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def labels(df: DataFrame, model: KMeansModel, vector: str, out: str = "cluster") -> DataFrame:
    rows = df.withColumn("__f", array_to_vector(V.as_double(F.col(vector))))
    return model.setFeaturesCol("__f").setPredictionCol(out).transform(rows).drop("__f")


def pca(df: DataFrame, vector: str, n: int, out: str = "projected") -> tuple[DataFrame, np.ndarray]:
    """``df`` with the first n components of the centred vectors, and the shares of variance they explain."""
    rows = df.withColumn("__f", array_to_vector(V.as_double(F.col(vector))))
    rows = StandardScaler(withMean=True, withStd=False, inputCol="__f", outputCol="__c").fit(rows).transform(rows)
    model = PCA(k=n, inputCol="__c", outputCol="__p").fit(rows)
    return model.transform(rows).withColumn(out, vector_to_array("__p")).drop("__f", "__c", "__p"), model.explainedVariance.toArray()


def components_for(shares: np.ndarray, threshold: float) -> int:
    """The least number of components whose shares add up to the threshold, or all."""
    return int(min(len(shares), np.searchsorted(np.cumsum(shares), threshold) + 1))


def spherical_pipeline(df: DataFrame, vector: str, config: Config = Config()) -> DataFrame:
    """Unit vectors, projected, made unit again, clustered: ``df`` with ``cluster`` and ``projected``."""
    unit = df.withColumn("__u", V.normalise(F.col(vector)))
    projected, _ = pca(unit, "__u", config.pca)
    rows = projected.withColumn("projected", V.normalise(F.col("projected"))).drop("__u")
    return labels(rows, kmeans(rows, "projected", config.k, config.starts, config.seed), "projected")


def regress_out(df: DataFrame, vector: str, dim: int, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``df`` with ``residual``: the vectors less what covariates explain, by least squares.

    The design has a constant, each number's z-score and its square, and a column per
    category but the first in order. Spark sums the design's products with itself and with
    the vectors; only those sums, of the design's width, come to the driver.
    """
    facts = df.agg(*(f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first() if numeric else None
    design: list[Column] = [F.lit(1.0)]
    for c in numeric:
        z = (F.col(c) - facts[f"m_{c}"]) / (facts[f"s_{c}"] or 1.0)
        design += [z, z * z]
    for c in categorical:
        values = [r[0] for r in df.select(c).distinct().orderBy(c).collect()]
        design += [F.col(c).eqNullSafe(F.lit(v)).cast("double") for v in values[1:]]
    # For each element of the design the sum of its products with the design and the vector: as many rows as the design is wide.
    rows = df.withColumn("__x", F.array(*design))
    each = rows.where(F.size(vector) == dim).select(F.posexplode("__x").alias("i", "x"), V.concat(F.col("__x"), F.col(vector)).alias("y")).select("i", V.scale(F.col("y"), F.col("x")).alias("xy"))
    sums = np.array([r["s"] for r in each.groupBy("i").agg(V.sum_by_position("xy").alias("s")).orderBy("i").collect()])
    k = len(design)
    b = np.linalg.pinv(sums[:, :k]) @ sums[:, k:]
    coefficients = df.sparkSession.createDataFrame([(b.tolist(),)], "__b array<array<double>>")
    fitted = F.aggregate(F.arrays_zip(F.col("__x").alias("x"), F.col("__b").alias("b")), F.array_repeat(F.lit(0.0), dim), lambda a, t: V.add(a, V.scale(t["b"], t["x"])))
    return rows.crossJoin(F.broadcast(coefficients)).withColumn("residual", V.subtract(F.col(vector), fitted)).drop("__x", "__b")  # one row


def bootstrap_ari(df: DataFrame, vector: str, id_col: str, k: int = 5, starts: int = 5, seed: int = 42) -> float:
    """Agreement of two clusterings on what two random halves of all rows share."""
    n = df.count() // 2
    found, halves = [], []
    for i in (1, 2):
        half = exact_sample(df, n, id_col, str(seed + i)).cache()
        found.append(labels(half, kmeans(half, vector, k, starts, seed + i), vector, f"c{i}").select(id_col, f"c{i}"))
        halves.append(half)
    agreed = stats.adjusted_rand(found[0].join(found[1], id_col), "c1", "c2").first()["ari"]
    for half in halves:
        half.unpersist()
    return agreed


def spherical_kmeans(df: DataFrame, vector: str, id_col: str, k: int = 5, most: int = 300, tol: float = 1e-4, seed: int = 42, sample: int = 20_000) -> tuple[np.ndarray, float]:
    """Unit centroids by cosine, and the inertia, the sum of 2 - 2 cos over all rows.

    Seeds are drawn from a bounded sample in proportion to one minus the largest similarity
    with those before. A round assigns every vector and sums up by centroid in Spark; new
    centroids are made unit again, an empty one is the zero vector, and rounds end when no
    centroid moves by more than ``tol``. Only k sums come to the driver.
    """
    ship(df.sparkSession)
    unit = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), V.normalise(F.col(vector)).alias("u")).cache()
    some = np.array([r["u"] for r in exact_sample(unit, sample, "id", str(seed)).select("u").collect()])
    rng = np.random.default_rng(seed)
    centres = some[[rng.integers(len(some))]]
    while len(centres) < k:
        away = np.maximum(1 - (some @ centres.T).max(axis=1), 0.0)
        centres = np.vstack([centres, some[rng.choice(len(some), p=away / away.sum()) if away.sum() > 0 else rng.integers(len(some))]])
    inertia = 0.0
    for _ in range(most):
        sums = lloyd.scan(unit, ["u"], [lloyd.Model("cosine", centres)], lloyd.Cosines([centres]))
        moved = np.zeros_like(centres)
        for (_, j), line in sums.items():
            moved[j] = line[1:] / max(np.linalg.norm(line[1:]), 1e-10)
        inertia, shift = sum(line[0] for line in sums.values()), np.linalg.norm(moved - centres, axis=1).max()
        centres = moved
        if shift <= tol:
            break
    unit.unpersist()
    return centres, float(inertia)


def by_cosine(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """``df`` with ``cluster``, the first centroid of the largest cosine, and ``sim``; for unit vectors and centroids."""
    listed = df.sparkSession.createDataFrame([(centres.tolist(),)], "__c array<array<double>>")
    sims = F.transform("__c", lambda c, i: F.struct(V.dot(F.col(vector), c).alias("sim"), (-i).alias("i")))
    rows = df.crossJoin(F.broadcast(listed)).withColumn("__b", F.array_max(sims))  # one row
    return rows.withColumn("cluster", -F.col("__b.i")).withColumn("sim", F.col("__b.sim")).drop("__b", "__c")


def quality(df: DataFrame, vector: str, dim: int, id_col: str) -> dict:
    """Silhouette, Davies-Bouldin, Calinski-Harabasz and balance of all rows with ``cluster``, which are kept meanwhile."""
    df = df.select(id_col, vector, "cluster").cache()
    q = stats.cluster_quality(df, "cluster", vector, dim).first()
    sil = stats.silhouette(df, id_col, "cluster", vector).first()[0]
    balance = stats.imbalance(df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))).first()["balance"]
    df.unpersist()
    return {"silhouette": sil, "davies_bouldin": q["davies_bouldin"], "calinski_harabasz": q["calinski_harabasz"], "balance": balance}


def sweep(df: DataFrame, vector: str, dim: int, id_col: str, ks: range = range(3, 8), starts: int = 3, seed: int = 42, rounds: int = 20) -> list[dict]:
    """Quality of k-means for several k, a row each; all k and starts are fitted by the same scans, and the start of least inertia counts."""
    models = [lloyd.Model(str(k), lloyd.seeds(df, vector, id_col, k, seed + i)) for k in ks for i in range(starts)]
    fitted: dict[str, lloyd.Model] = {}
    for m in lloyd.fit_many(df, [vector], models, rounds):
        if m.name not in fitted or m.inertia < fitted[m.name].inertia:
            fitted[m.name] = m
    return [{"k": k, **quality(lloyd.assign(df, vector, fitted[str(k)].centres), vector, dim, id_col)} for k in ks]


def compare_reductions(df: DataFrame, vector: str, dim: int, id_col: str, dims: tuple[int, ...] = (50, 100, 200), k: int = 5, starts: int = 3, seed: int = 42) -> list[dict]:
    """Quality of clusters of the unit vectors as they are and of several projections made unit again, a row each with its stability."""
    rows = []
    unit = df.select(id_col, V.normalise(F.col(vector)).alias("u")).cache()
    for name, n in [("baseline", dim), *((f"pca_{n}", n) for n in dims)]:
        arm = unit.select(id_col, F.col("u").alias("x")) if name == "baseline" else pca(unit, "u", n)[0].select(id_col, V.normalise(F.col("projected")).alias("x"))
        arm = arm.cache()
        found = quality(labels(arm, kmeans(arm, "x", k, starts, seed), "x"), "x", n, id_col)
        rows.append({"method": name, "dim": n, **found, "bootstrap_ari": bootstrap_ari(arm, "x", id_col, k, starts=starts, seed=seed)})
        arm.unpersist()
    unit.unpersist()
    return rows


def pca_sweep(df: DataFrame, vector: str, dim: int, anchors: DataFrame, dims: tuple[int, ...], k: int = 5, starts: int = 3, seed: int = 42) -> list[dict]:
    """How well clusters of several projections match ``anchors`` (``anchor, vector``, k of them): least and mean similarity, least margin, balance."""
    rows = []
    for n in dims:
        config = Config(k=k, starts=starts, pca=n, seed=seed)
        clustered = spherical_pipeline(df, vector, config).select("cluster", vector)
        sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        clusters = names.centroids(clustered, "cluster", vector, dim).select("cluster", "centroid")
        sims = names.similarity_matrix(anchors, clusters, names.overall_mean(df, vector, dim))
        found = names.assignment_quality(names.assign(sims), names.margins(sims)).first()
        rows.append({"pca": n, "min_cos": found["min_cos"], "mean_cos": found["mean_cos"], "min_margin": found["min_margin"], "balance": stats.imbalance(sizes).first()["balance"]})
    return rows


def best(rows: list[dict], metric: str, largest: bool = True) -> dict:
    """The row with the best value of a metric, the first if several have it."""
    return (max if largest else min)(rows, key=lambda r: r[metric])


def weight_grid(df: DataFrame, first: str, second: str, id_col: str, steps: int = 20, low: float = 0.1, high: float = 2.0, k: int = 5, starts: int = 5, rounds: int = 20, seed: int = 42) -> list[dict]:
    """Silhouette of ``a * first + b * second`` clustered, all rows, for a grid of weights; the first best is kept by :func:`best`.

    All pairs of weights and all starts are fitted by the same scans
    (:func:`mosaiq.operators.lloyd.fit_many`), and of the starts that of least inertia
    counts. Silhouettes are exact, over all rows, by squared distance. Neither they nor the
    clusters change when both weights are scaled, so one fit serves all pairs of equal ratio.
    """
    grid = np.linspace(low, high, steps)
    ratio = {(a, b): round(float(b / a), 9) for a in grid for b in grid}
    sown = [[lloyd.seeds(df, c, id_col, k, seed + i) for c in (first, second)] for i in range(starts)]
    models = [lloyd.Model(str(r), x + r * y, (1.0, r)) for r in sorted(set(ratio.values())) for x, y in sown]
    fitted: dict[str, lloyd.Model] = {}
    for m in lloyd.fit_many(df, [first, second], models, rounds):
        if m.name not in fitted or m.inertia < fitted[m.name].inertia:
            fitted[m.name] = m
    scores = dict(zip(fitted, lloyd.silhouettes(df, [first, second], list(fitted.values()))))
    return [{"a": float(a), "b": float(b), "silhouette": scores[str(ratio[a, b])]} for a in grid for b in grid]
