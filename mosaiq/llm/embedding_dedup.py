"""Near duplicates among embedding vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted independently; a vector's cell
is the pair of its nearest centroids, so the cells form a product grid. From a vector,
cells are visited in order of the summed squared distances of their two centroids (a
multi-sequence traversal of the two sorted lists) until the sum exceeds that of the first
cell by a margin. The margin is set on the sample so that copies at exactly the linking
similarity lie in a visited cell with the target recall. All candidates met are then
verified by cosine in double precision. Vectors of different lengths never link: each
length has an index of its own, and one whose vectors fit a single block is compared
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm._common import written
from mosaiq.llm._components import components
from mosaiq.runtime import ship

THRESHOLD, RECALL = 0.98, 0.999
#: Vectors the codebooks of a length are fitted on, and bytes that the samples of all lengths take together, about; every vector is indexed.
SAMPLE, SAMPLE_BYTES = 20_000, 1 << 28
#: Copies at the linking similarity by which the margin is set, at least.
COPIES = 10_000
#: Vectors a cell should hold, centroids of a codebook at least, and vectors of the sample for each centroid.
CELL_ROWS, LEAST_CENTROIDS, SAMPLE_SHARE = 64, 4, 4
#: Values of the hash that picks the sample.
HASHES = 1 << 60
#: Vectors on either side of a task's comparison: larger cells are dealt out in blocks.
BLOCK = 1024
SEED = 42


class MultiIndex:
    """Codebooks of the two halves, and how far to visit."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float) -> None:
        rng = np.random.default_rng(SEED)
        self.dim, self.cut = sample.shape[1], sample.shape[1] // 2
        k = int(min(max(LEAST_CENTROIDS, (n / CELL_ROWS) ** 0.5), max(1, len(sample) // SAMPLE_SHARE)))
        self.books = [self._book(part, k, rng) for part in (sample[:, : self.cut], sample[:, self.cut :])]
        mine, at, beyond = self.distances(sample), np.arange(len(sample)), []
        # Few vectors stand for more, by several copies of each: the quantile is one of ``COPIES`` at least.
        for _ in range(-(-COPIES // len(sample))):
            noise = rng.normal(size=sample.shape)
            noise -= (noise * sample).sum(1, keepdims=True) * sample
            noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
            copies = threshold * sample + (1 - threshold**2) ** 0.5 * noise
            theirs = [d.argmin(1) for d in self.distances(copies)]
            beyond.append(sum(d[at, c] - d.min(1) for d, c in zip(mine, theirs)))
        self.margin = float(np.quantile(np.concatenate(beyond), recall, method="higher")) + 1e-9

    @staticmethod
    def _book(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            near = (((x**2).sum(1)[:, None] - 2 * x @ centres.T) + (centres**2).sum(1)).argmin(1)
            sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=k)
            np.add.at(sums, near, x)
            centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        return centres

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half to its codebook."""
        return [(h**2).sum(1)[:, None] - 2 * h @ b.T + (b**2).sum(1) for h, b in zip((x[:, : self.cut], x[:, self.cut :]), self.books)]

    def visited(self, x: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """For each row the cells to visit, nearest first; the first is the row's own."""
        d1, d2 = self.distances(x)
        for a, b, p, q in zip(np.sort(d1, 1).tolist(), np.sort(d2, 1).tolist(), d1.argsort(1).tolist(), d2.argsort(1).tolist()):
            most, heap, cells = a[0] + b[0] + self.margin, [(a[0] + b[0], 0, 0)], []
            while heap:
                total, i, j = heappop(heap)
                if total > most:
                    break
                cells.append((p[i], q[j]))
                # (i, j) is reached along one path only: right along the second list, down only from its start.
                if j + 1 < len(b):
                    heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(a):
                    heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            yield cells


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite throughout and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    # By a power of two, which is exact, so that squares neither overflow nor vanish.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``vectors``: ``id_col, n_links, component_id, kept``.

    Vectors of one label and length link at a cosine of ``threshold`` or more. ``n_links``
    counts the other rows linked directly; equal vectors are compared once and counted as
    often as they occur. Vectors that are null, zero or not finite and those without a label
    link with nothing. Rows that repeat an id count each with its own vector; null ids are
    passed over for ``component_id``, which is null where a group has no other. Other columns
    are not read. An empty table gives an empty result.

    Codebooks grow with the square root of the rows, to a quarter of the sample (``SAMPLE``)
    at most: up to 1.6 billion vectors a cell holds ``CELL_ROWS`` of them on average; beyond
    that cells grow, and are dealt out in blocks as any large cell is.
    """
    ship(vectors.sparkSession)
    rows = written(vectors.select(F.col(id_col).alias("row_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")))
    ok = F.col("label").isNotNull() & usable(F.col("v"))
    kinds = rows.where(ok).groupBy("label", "v").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # Numbered as they are written: ids may repeat.
    reps = written(kinds.withColumn("rep", F.monotonically_increasing_id()))
    lengths = {r["dim"]: r["count"] for r in reps.groupBy(F.size("v").alias("dim")).count().collect()}
    indexes, long = {}, {dim: n for dim, n in lengths.items() if dim > 1 and n > BLOCK}
    for dim, n in sorted(long.items()):
        most = min(SAMPLE, max(LEAST_CENTROIDS * SAMPLE_SHARE, SAMPLE_BYTES // (8 * dim * len(long))))
        picked = F.pmod(F.xxhash64("first", "v"), F.lit(HASHES)) < int(min(1.0, most / n) * HASHES)
        fit = reps.where((F.size("v") == dim) & picked).select("first", F.xxhash64("v").alias("h"), "v").toPandas()
        if len(fit):
            indexes[dim] = MultiIndex(_unit(fit.fillna({"first": -1}).sort_values(["first", "h"])["v"]), n, threshold, recall)
    parts = [vectors.sparkSession.createDataFrame([], "a long, b long, n long")]
    if any(dim > 1 for dim in lengths):
        index = vectors.sparkSession.sparkContext.broadcast(indexes)
        parts.append(_compare(reps.where(F.size("v") > 1) if 1 in lengths else reps, index, threshold))
    if 1 in lengths:
        parts += _numbers(reps.where(F.size("v") == 1))
    found = written(reduce(DataFrame.unionByName, parts))
    groups = components(found.where("b is not null").select("a", "b"))
    direct = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    rooted = written(reps.select("rep", "first").join(groups, F.col("rep") == F.col("node"), "left").select("rep", "first", F.coalesce("component", "rep").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("rep", "component")
    of = reps.join(named, "rep").join(direct, "rep", "left").select(
        F.col("label").alias("l"), F.col("v").alias("w"), "copies", "component", F.coalesce("others", F.lit(0)).alias("others")
    )
    joined = rows.join(of, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("copies").isNull(), F.col("row_id")).otherwise(F.col("component"))
    return joined.select(
        F.col("row_id").alias(id_col),
        F.coalesce(F.col("copies") - 1 + F.col("others"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("row_id")).alias("kept"),
    )


def _numbers(reps: DataFrame) -> list[DataFrame]:
    """What ``_compare`` gives, for vectors of length one: those of one sign have a cosine of one."""
    reps = reps.select("label", (F.get("v", F.lit(0)) > 0).alias("sign"), "rep", "copies")
    all_of = reps.groupBy("label", "sign").agg(F.sum("copies").alias("total"), F.min("rep").alias("first"))
    reps = reps.join(all_of, ["label", "sign"])
    counts = reps.select(F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("total") - F.col("copies")).alias("n"))
    return [counts, reps.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"), F.lit(0).cast("long").alias("n"))]


def _compare(reps: DataFrame, index, threshold: float) -> DataFrame:
    """``(a, null, n)``: copies of other vectors that ``a`` links with, by task; ``(a, b, 0)``: links that connect.

    A pair counts once for both of its ends, whichever of them visits the other's cell.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, same in batch.groupby(batch["v"].map(len)):
                for at in range(0, len(same), 4096):
                    part = same.iloc[at : at + 4096]
                    one = index.value.get(dim)
                    cells = list(one.visited(_unit(part["v"]))) if one else [[(0, 0)]] * len(part)
                    yield pd.DataFrame({"dim": dim, "rep": part["rep"].to_numpy(), "label": part["label"].to_numpy(), "v": part["v"].to_numpy(), "copies": part["copies"].to_numpy(), "cells": [[p << 16 | q for p, q in c] for c in cells]})

    placed = written(reps.mapInPandas(place, "dim int, rep long, label string, v array<double>, copies long, cells array<int>"))
    key = ["dim", "label", "cell"]
    first = F.get("cells", F.lit(0))
    visits = placed.select("dim", "label", F.explode("cells").alias("cell"))
    own = placed.select("dim", "label", first.alias("cell"))
    blocks = lambda df, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = written(blocks(own, "km").join(blocks(visits, "kp"), key))
    mine = lambda k: F.pmod(F.xxhash64("rep"), k).cast("int")
    others = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    row = (*key, "rep", "v", "copies", "cells")
    # A member brings the cells that it visits, a probe its own one.
    members = placed.select("dim", "rep", "label", "v", "copies", first.alias("cell"), "cells").join(sizes, key)
    members = members.select(*row, mine(F.col("km")).alias("i"), others(F.col("kp")).alias("j"), F.lit(True).alias("member"))
    probes = placed.select("dim", "rep", "label", "v", "copies", F.explode("cells").alias("cell"), F.array(first).alias("cells")).join(sizes, key)
    probes = probes.select(*row, others(F.col("km")).alias("i"), mine(F.col("kp")).alias("j"), F.lit(False).alias("member"))

    def task(part: pd.DataFrame) -> pd.DataFrame:
        from mosaiq.llm.simhash import spanning

        member = part["member"].to_numpy()
        ids, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
        empty = pd.DataFrame({"a": [], "b": [], "n": []})
        if member.all() or not member.any():
            return empty
        x = _unit(part["v"])
        p, m = np.flatnonzero(~member), np.flatnonzero(member)
        near = (x[p] @ x[m].T >= threshold) & (ids[p][:, None] != ids[m])
        # Where the member visits the probe's cell too, the pair is met twice, and the one whose probe comes first counts.
        visited = part["cells"].to_numpy()[m]
        homes, home = np.unique(np.concatenate(part["cells"].to_numpy()[p]), return_inverse=True)
        flat = np.concatenate(visited)
        slot = np.minimum(np.searchsorted(homes, flat), len(homes) - 1)
        by = np.repeat(np.arange(len(m)), [len(c) for c in visited])
        sees = np.zeros((len(m), len(homes)), dtype=bool)
        hit = homes[slot] == flat
        sees[by[hit], slot[hit]] = True
        near &= ~sees[:, home].T | (ids[p][:, None] < ids[m])
        n = np.zeros(len(ids), dtype=np.int64)
        np.add.at(n, p, near @ copies[m])
        np.add.at(n, m, copies[p] @ near)
        some = n > 0
        names, at = np.unique(ids, return_inverse=True)
        i, j = np.nonzero(near)
        root = spanning(len(names), at[p][i], at[m][j])
        moved = np.flatnonzero(root != np.arange(len(names)))
        a = np.concatenate([ids[some], names[root[moved]]])
        b = pd.array([None] * int(some.sum()) + names[moved].tolist(), dtype="Int64")
        return pd.DataFrame({"a": a, "b": b, "n": np.concatenate([n[some], np.zeros(len(moved), dtype=np.int64)])})

    both = members.unionByName(probes)
    return both.groupBy(*key, "i", "j").applyInPandas(task, "a long, b long, n long")
