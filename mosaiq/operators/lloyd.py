"""k-means over many models at once, and in mini-batches.

Starts, numbers of clusters and weights of joined parts are models of their own, but one scan
of the rows serves a round of all of them: a task assigns its rows by every model and sends a
row of sums for each centroid. The driver holds centroids only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators.ordered import first_k
from mosaiq.runtime import scratch, ship

#: Components of all centroids in one scan at most (64 MB); with more models, groups of them take scans of their own. Rows assigned at a time.
MAX_COMPONENTS, CHUNK = 8_000_000, 4096
#: Distances from one centroid of each model that a task forms at a time.
BLOCK = 1 << 18


@dataclass
class Model:
    """Centroids to begin with, and the weights of the parts whose weighted sum is clustered."""

    name: str
    centres: np.ndarray
    weights: tuple[float, ...] = (1.0,)
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Sum of squared distances to the centroids that the last round began with.
    inertia: float = float("inf")
    rounds: int = 0


def seeds(df: DataFrame, vector: str, id_col: str, k: int, seed: int = 42) -> np.ndarray:
    """The vectors of the first k rows in a seeded hash order of the ids; all if there are fewer."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col)))
    rows = df.where(F.col(vector).isNotNull()).select(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key"), digest.alias("digest"), V.as_double(F.col(vector)).alias("v"))
    found = rows.where(first_k(rows.select("key"), ["key"], k)).orderBy("digest", "v").limit(k).collect()
    return np.array([r["v"] for r in found], dtype=np.float64)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row the nearest centroid, the first of several, and its squared distance."""
    far = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    at = far.argmin(1)
    return at, np.maximum(far[np.arange(len(x)), at], 0.0)


def _mixed(batch: pd.DataFrame, parts: Sequence[str]) -> Iterator[list[np.ndarray]]:
    for at in range(0, len(batch), CHUNK):
        yield [np.stack(batch[p].iloc[at : at + CHUNK].to_numpy()).astype(np.float64) for p in parts]


def scan(rows: DataFrame, parts: Sequence[str], models: list[Model], each, few: bool = False) -> dict[tuple[int, int], np.ndarray]:
    """``each(x, model number)`` gives an array with a row a centroid; by model and centroid the sums of these rows over all chunks.

    The first column is summed by itself, since element-wise sums come from means and are not exact for counts. Of a
    ``few`` rows the tasks' sums come to the driver as they are, without a shuffle. An ``each`` with a method ``every``
    does all models of a chunk by that.
    """
    shared = rows.sparkSession.sparkContext.broadcast((models, each))  # bounded by MAX_COMPONENTS

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ours, add = shared.value
        totals: list = [None] * len(ours)
        for batch in batches:
            for split in _mixed(batch, parts):
                if hasattr(add, "every"):
                    for i, j, line in add.every(split):
                        if totals[i] is None:
                            totals[i] = np.zeros((len(ours[i].centres), len(line)))
                        totals[i][j] += line
                    continue
                for i, model in enumerate(ours):
                    got = add(sum(w * x for w, x in zip(model.weights, split)), i)
                    totals[i] = got if totals[i] is None else totals[i] + got
        rows = [(i, j, float(line[0]), line[1:].tolist()) for i, total in enumerate(totals) if total is not None for j, line in enumerate(total)]
        yield pd.DataFrame(rows, columns=["model", "centre", "first", "sums"])

    found = rows.select(*parts).mapInPandas(task, "model int, centre int, first double, sums array<double>")
    if few:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for r in found.collect():  # a row a centroid and task
            line = np.array([r["first"], *r["sums"]])
            totals[r["model"], r["centre"]] = totals.get((r["model"], r["centre"]), 0.0) + line
        return totals
    sums = found.groupBy("model", "centre").agg(F.sum("first").alias("first"), V.sum_by_position("sums").alias("sums"))
    return {(r["model"], r["centre"]): np.array([r["first"], *r["sums"]]) for r in sums.collect()}  # a row a centroid


def _groups(models: list[Model]) -> Iterator[list[Model]]:
    group, held = [], 0
    for m in models:
        if group and held + m.centres.size > MAX_COMPONENTS:
            yield group
            group, held = [], 0
        group.append(m)
        held += m.centres.size
    if group:
        yield group


class _Sums:
    """By centroid: how many rows, the sum of their squared distances and of their squared norms, and of themselves.

    Rows are multiplied by the centroids of many models at a time. A weighted sum of parts is never formed: the parts side
    by side are multiplied by the weighted centroids, and sums by part are weighted afterwards.
    """

    def __init__(self, models: list[Model]) -> None:
        self.models = models

    def blocks(self, rows: int, dims: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Numbers of models with equally many centroids, their weights, and by place among a model's centroids its column: what is added to ``-2 x c`` of all."""
        by_k: dict[int, list[int]] = {}
        for i, m in enumerate(self.models):
            by_k.setdefault(len(m.centres), []).append(i)
        most = max(1, BLOCK // rows)
        for k, numbers in by_k.items():
            for at in range(0, len(numbers), most):
                some = numbers[at : at + most]
                w = np.array([self.models[i].weights for i in some])
                c = np.array([self.models[i].centres for i in some]).reshape(len(some), k, dims).transpose(1, 0, 2)  # place, model, component
                yield some, w, np.concatenate([*(-2 * w[:, p, None] * c for p in range(w.shape[1])), (c**2).sum(2)[:, :, None]], axis=2)

    def every(self, split: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """A model's number, a centroid's, and the centroid's sums over rows of which ``split`` has the parts."""
        n, dims, parts = *split[0].shape, len(split)
        one = np.ones((n, 1))
        products = [(x * y).sum(1)[:, None] for i, x in enumerate(split) for y in split[i:]]
        z, facts = np.concatenate([*split, one], axis=1), np.concatenate([one, *products, *split], axis=1)
        pairs = [(i, j) for i in range(parts) for j in range(i, parts)]
        for numbers, w, table in self.blocks(n, dims):
            best, at = z @ table[0].T, np.zeros((n, len(numbers)), dtype=np.int32)
            for j in range(1, len(table)):
                far = z @ table[j].T
                np.putmask(at, far < best, j)
                np.minimum(best, far, out=best)
            squares = np.array([w[:, i] * w[:, j] * (1 if i == j else 2) for i, j in pairs])
            for j in range(len(table)):
                sums = (at == j).astype(np.float64).T @ facts  # a row a model
                count, rest = sums[:, 0], sums[:, 1 + len(pairs) :].reshape(len(numbers), parts, dims)
                square, total = np.einsum("pm,mp->m", squares, sums[:, 1 : 1 + len(pairs)]), np.einsum("mp,mpd->md", w, rest)
                c = np.array([self.models[i].centres[j] for i in numbers])
                inertia = np.maximum(square - 2 * (c * total).sum(1) + count * (c**2).sum(1), 0.0)
                yield from zip(numbers, [j] * len(numbers), np.concatenate([count[:, None], inertia[:, None], square[:, None], total], axis=1))


class Cosines:
    """By centroid the sum of 2 - 2 cos of the rows of which it is the first with the largest cosine, and their sum; for unit rows."""

    def __init__(self, centres: list[np.ndarray]) -> None:
        self.centres = centres

    def __call__(self, x: np.ndarray, i: int) -> np.ndarray:
        sims = x @ self.centres[i].T
        at, here = sims.argmax(1), np.arange(len(x))
        mine = np.zeros((len(self.centres[i]), len(x)))
        mine[at, here] = 1.0
        return mine @ np.concatenate([(2 - 2 * sims[here, at])[:, None], x], axis=1)


class _Silhouettes:
    """Sums and numbers of silhouettes by squared distance, from sums of the clusters."""

    def __init__(self, models: list[Model], held: list[np.ndarray]) -> None:
        self.centres, self.held = [m.centres for m in models], held

    def __call__(self, x: np.ndarray, i: int) -> np.ndarray:
        at, _ = _nearest(x, self.centres[i])
        n, squares, sums = self.held[i][:, 0], self.held[i][:, 2], self.held[i][:, 3:]
        total = n * (x**2).sum(1)[:, None] + squares - 2 * x @ sums.T
        here = np.arange(len(x))
        own = total[here, at] / np.maximum(n[at] - 1, 1)
        other = np.where(n > 0, total / np.maximum(n, 1), np.inf)
        other[here, at] = np.inf
        nearest = other.min(1)
        scored = (n[at] > 1) & np.isfinite(nearest)
        nearest = np.where(scored, nearest, 0.0)
        s = np.where(scored, (nearest - own) / np.maximum(np.maximum(nearest, own), 1e-300), 0.0)
        return np.array([[s.sum(), float(len(x))]])


def _rows(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    ship(df.sparkSession)
    there = [F.col(p).isNotNull() for p in parts]
    rows = df.select(*(V.as_double(F.col(p)).alias(f"p{i}") for i, p in enumerate(parts)))
    return rows.where(" AND ".join(f"p{i} IS NOT NULL" for i in range(len(there))))


def _names(parts: Sequence[str]) -> list[str]:
    return [f"p{i}" for i in range(len(parts))]


def fit_many(df: DataFrame, parts: Sequence[str], models: Sequence[Model], rounds: int = 20, tol: float = 1e-4) -> list[Model]:
    """The models after Lloyd rounds from their centroids, until none moves by more than ``tol`` or ``rounds`` are over.

    ``parts`` are vector columns of one length; a model clusters their sum by its weights.
    Rows with a null part are left out. A centroid without rows stays. One scan a round for
    all models that still move.
    """
    rows = _rows(df, parts).cache()
    done = [Model(m.name, np.array(m.centres, dtype=np.float64), tuple(m.weights), np.zeros(len(m.centres))) for m in models]
    moving = list(done)
    for _ in range(rounds):
        still = []
        for group in _groups(moving):
            sums = scan(rows, _names(parts), group, _Sums(group))
            for i, m in enumerate(group):
                lines = np.array([sums.get((i, j), np.zeros(3 + m.centres.shape[1])) for j in range(len(m.centres))])
                fresh = np.where(lines[:, :1] > 0, lines[:, 3:] / np.maximum(lines[:, :1], 1), m.centres)
                moved = np.sqrt(((fresh - m.centres) ** 2).sum(1)).max(initial=0.0)
                m.centres, m.sizes, m.inertia, m.rounds = fresh, lines[:, 0], float(lines[:, 1].sum()), m.rounds + 1
                if moved > tol:
                    still.append(m)
        moving = still
        if not moving:
            break
    rows.unpersist()
    return done


def silhouettes(df: DataFrame, parts: Sequence[str], models: Sequence[Model]) -> list[float]:
    """By model the mean silhouette of all rows by squared distance, exactly, in two scans.

    A row's mean squared distance to a cluster follows from the cluster's number of rows, sum
    and sum of squared norms. A row alone in its cluster, or with all in one, has 0; so has
    an empty table.
    """
    rows, found = _rows(df, parts).cache(), []
    for group in _groups(list(models)):
        sums = scan(rows, _names(parts), group, _Sums(group))
        held = [np.array([sums.get((i, j), np.zeros(3 + m.centres.shape[1])) for j in range(len(m.centres))]) for i, m in enumerate(group)]
        scores = scan(rows, _names(parts), group, _Silhouettes(group, held))
        found += [float(s[0] / s[1]) if (s := scores.get((i, 0))) is not None else 0.0 for i in range(len(group))]
    rows.unpersist()
    return found


def assign(df: DataFrame, vector: str, centres: np.ndarray, out: str = "cluster", distance: str | None = None) -> DataFrame:
    """``df`` with the number of its nearest centroid, the first of several, and if named the squared distance; null for null vectors."""
    listed = F.lit(centres.tolist()) if centres.size < 4096 else None
    rows = df
    if listed is None:
        rows = df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(centres.tolist(),)], "__c array<array<double>>")))  # one row
        listed = F.col("__c")
    gap = lambda c: F.aggregate(F.zip_with(V.as_double(F.col(vector)), c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, d: a + d)
    best = F.array_min(F.transform(listed, lambda c, i: F.struct(gap(c).alias("d"), i.alias("i"))))
    rows = rows.withColumn("__b", F.when(F.col(vector).isNotNull(), best)).withColumn(out, F.col("__b.i"))
    return (rows.withColumn(distance, F.col("__b.d")) if distance else rows).drop("__b", "__c")


def fit_minibatch(df: DataFrame, vector: str, id_col: str, k: int, batch_rows: int = 4096, epochs: int = 3, seed: int = 42) -> Model:
    """k-means in mini-batches: after each batch a centroid moves towards its rows' mean by their share of all rows it has had so far.

    Rows are dealt into batches of about ``batch_rows`` by a hash of their ids, stored by
    batch, and read in order, ``epochs`` times; each batch is one small job. All rows take
    part. ``inertia`` is not measured. Rows with a null vector are left out.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), V.as_double(F.col(vector)).alias("p0"))
    model = Model("minibatch", seeds(rows, "p0", "id", k, seed))
    model.sizes = np.zeros(len(model.centres))
    n = max(1, -(-rows.count() // batch_rows))
    path = scratch(df.sparkSession)
    batch = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n))
    rows.withColumn("batch", batch).repartition("batch").write.partitionBy("batch").parquet(path)
    stored = df.sparkSession.read.schema("id string, p0 array<double>, batch long").parquet(path)
    for _ in range(epochs):
        for number in range(n):
            sums = scan(stored.where(F.col("batch") == number).select("p0"), ["p0"], [model], _Sums([model]), few=True)
            for (_, j), line in sums.items():
                if line[0]:
                    model.sizes[j] += line[0]
                    model.centres[j] += (line[3:] - line[0] * model.centres[j]) / model.sizes[j]
            model.rounds += 1
    return model
