"""Exact and cell-pruned vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.runtime import saved, ship

#: Components of queries that are held at once, and scores that a task holds: 64 MB of doubles each.
MAX_COMPONENTS, MAX_SCORES = 8_000_000, 8_000_000
#: Scores that a task forms at a time (8 MB), of so many vectors; products that a task forms in all before the work is cut further.
CHUNK_SCORES, CHUNK_VECTORS, PRODUCTS = 1_000_000, 2048, 1 << 32
#: Components of vectors that stream past one block of queries where both sides are cut into blocks, 512 MB of doubles.
SLAB_COMPONENTS = 64_000_000
#: Cells at most; their centroids are held by each task, within MAX_COMPONENTS.
MAX_CELLS = 16_384
#: Inner products that take about as long as moving one query to one more cell.
COPY = 4096


def search(vectors: DataFrame, query: list[float], k: int, exclude: list | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, score)`` of the k vectors with the largest inner product with one query, ties by id.

    Excluded ids are left out before the cut, so k results remain. Plans as a bounded heap
    in each task (TakeOrderedAndProject).
    """
    rows = vectors.where(~F.col(id_col).isin(exclude)) if exclude else vectors
    score = V.dot(F.col(vector_col), F.array(*map(F.lit, map(float, query))))
    return rows.select(id_col, score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the k largest scores, descending, ties by id."""
    if scores.shape[1] > k:
        at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(scores, at, 1).min(axis=1, keepdims=True)
        for i in np.flatnonzero((scores >= least).sum(axis=1) > k):  # which of the equal ones the cut kept is arbitrary
            at[i] = np.lexsort((ids[i], -scores[i]))[:k]
        ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
    order = np.lexsort((ids, -scores), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def _plain(ids: np.ndarray) -> np.ndarray:
    return ids.astype(str) if ids.dtype == object else ids


class _Best:
    """The k best of the vectors seen so far for each of a block of queries of one length.

    Scores are formed in chunks, and of a chunk only those that reach a query's k-th so far are looked at.
    """

    def __init__(self, names: np.ndarray, q: np.ndarray, k: int, skip_self: bool) -> None:
        self.names, self.q, self.k = names, q, k
        self.ids, self.scores = None, np.full((len(names), k), -np.inf)
        mine = _plain(names)
        self.order = np.argsort(mine, kind="stable") if skip_self else None
        self.sorted = mine[self.order] if skip_self else None

    def add(self, ids: np.ndarray, vectors: pd.Series) -> None:
        tall = max(1, CHUNK_SCORES // CHUNK_VECTORS)
        for at in range(0, len(ids), CHUNK_VECTORS):
            new_ids, x = _plain(ids[at : at + CHUNK_VECTORS]), _matrix(vectors.iloc[at : at + CHUNK_VECTORS])
            if self.ids is None:
                self.ids = np.zeros(self.scores.shape, dtype=new_ids.dtype)
            own, here = self._own(new_ids)
            for low in range(0, len(self.names), tall):
                new = self.q[low : low + tall] @ x.T
                some = (own >= low) & (own < low + tall)
                new[own[some] - low, here[some]] = -np.inf
                self._take(low, new_ids, new)

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which query is which of these vectors itself."""
        if self.order is None or not len(self.names) or (self.sorted.dtype.kind == "U") != (ids.dtype.kind == "U"):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        low, high = np.searchsorted(self.sorted, ids, "left"), np.searchsorted(self.sorted, ids, "right")
        here = np.repeat(np.arange(len(ids)), high - low)
        steps = np.arange(len(here)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        return self.order[np.repeat(low, high - low) + steps], here

    def _take(self, low: int, ids: np.ndarray, new: np.ndarray) -> None:
        reach = np.maximum(self.scores[low : low + len(new), -1:], np.finfo(np.float64).min)
        row, at = np.divmod(np.flatnonzero(new >= reach), new.shape[1])
        if len(row) > 4 * self.k * len(new):  # at first above all
            new = np.where(np.isfinite(new), new, -np.inf)
            found, score = best_of(np.broadcast_to(ids, new.shape), new, self.k)
            row, found, score = np.repeat(np.arange(len(new)), found.shape[1]), found.ravel(), score.ravel()
        else:
            found, score = ids[at], new[row, at]
        row, found, score = (c[np.isfinite(score)] for c in (row, found, score))
        if not len(row):
            return
        rows, place = np.unique(row, return_inverse=True)
        self.ids = self.ids.astype(np.result_type(self.ids, ids), copy=False)  # strings may be longer
        name = np.concatenate([self.ids[low + rows].ravel(), found])
        value = np.concatenate([self.scores[low + rows].ravel(), score])
        owner = np.concatenate([np.repeat(np.arange(len(rows)), self.k), place])
        order = np.lexsort((name, -value, owner))
        first = order[np.searchsorted(owner[order], np.arange(len(rows)))[:, None] + np.arange(self.k)]
        self.ids[low + rows], self.scores[low + rows] = name[first], value[first]

    def rows(self) -> Iterator[pd.DataFrame]:
        if self.ids is not None:
            keep = np.isfinite(self.scores)
            yield pd.DataFrame({"query": np.repeat(self.names, keep.sum(axis=1)), "id": self.ids[keep], "score": self.scores[keep]})


def _beside(members: DataFrame, probes: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """``(query, id, score)``: each task's k best of every query, where queries are too many to be held by every task.

    ``members`` has ``id, v`` and ``probes`` ``query, v``, never null. Both are cut into blocks
    by a hash and every block of queries meets every slab of vectors; a task holds one block
    of queries and lets the slab pass. So the vectors are read once and shuffled once for each block
    of queries.
    """
    return _in_cells(members.withColumn("cell", F.lit(0)), probes.withColumn("cell", F.lit(0)), k, skip_self)


def _in_cells(members: DataFrame, probes: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """As :func:`_beside`, but queries meet the members of their ``cell`` only; cells of any size are cut into blocks on both sides."""
    spark = members.sparkSession
    count = lambda df: df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).collect()  # noqa: E731 - a row a cell
    asked, there = {r["cell"]: r for r in count(probes)}, {r["cell"]: r for r in count(members.where(F.col("cell").isNotNull()))}
    sizes = []
    for cell in asked.keys() & there.keys():
        dim = max(1, asked[cell]["dim"])
        block, slab = max(1, min(MAX_COMPONENTS // dim, MAX_SCORES // (4 * k))), max(1, SLAB_COMPONENTS // dim)
        tasks = -(-asked[cell]["n"] * there[cell]["n"] // PRODUCTS)
        slabs = max(-(-there[cell]["n"] // slab), int(tasks**0.5 / 2))
        sizes.append((cell, max(-(-asked[cell]["n"] // block), -(-tasks // slabs)), slabs))
    met = F.broadcast(spark.createDataFrame(sizes, "cell int, blocks int, slabs int"))  # a row a cell
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    hashed = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    query, one = probes.schema["query"].dataType.simpleString(), members.schema["id"].dataType.simpleString()
    key = ["cell", "dim", "i", "j"]
    left = probes.join(met, "cell").select("cell", F.size("v").alias("dim"), hashed("query", "blocks").alias("i"), every("slabs").alias("j"), F.lit(False).alias("member"), "query", F.lit(None).cast(one).alias("id"), V.as_double(F.col("v")).alias("v"))
    right = members.join(met, "cell").select("cell", F.size("v").alias("dim"), every("blocks").alias("i"), hashed("id", "slabs").alias("j"), F.lit(True).alias("member"), F.lit(None).cast(query).alias("query"), "id", V.as_double(F.col("v")).alias("v"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, waiting, best = None, [], None
        for batch in batches:
            keys = batch[key].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(batch) else []
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                if here != tuple(keys[a]):
                    if best is not None:
                        yield from best.rows()
                    here, waiting, best = tuple(keys[a]), [], None
                run = batch.iloc[a:b]
                member = run["member"].to_numpy(dtype=bool)
                if not member.all():
                    waiting.append(run.loc[~member, ["query", "v"]])
                if member.any() and (best is not None or waiting):
                    if best is None:
                        block = pd.concat(waiting)
                        best, waiting = _Best(block["query"].to_numpy(), _matrix(block["v"]), k, skip_self), []
                    best.add(run.loc[member, "id"].to_numpy(), run.loc[member, "v"])
        if best is not None:
            yield from best.rows()

    # Queries come first. Pandas would make floats of integers beside nulls, so what a row lacks is filled.
    filled = left.withColumn("id", _some(one)).union(right.withColumn("query", _some(query)))
    return filled.repartition(*key).sortWithinPartitions(*key, "member").mapInPandas(walk, f"query {query}, id {one}, score double")


def _some(kind: str):
    """A value of a type of ids in place of null, which pandas would turn integers into floats for."""
    return (F.lit("") if kind == "string" else F.lit(0)).cast(kind)


def _ranked(found: DataFrame, k: int, query_col: str, id_col: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(query_col).orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def batch_search(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", skip_self: bool = True,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """``(query_col, id_col, score, rank)``: for every query its k vectors of largest inner product, ties by id.

    ``queries`` has ``query_col`` (unique) and ``vector_col``; ``exclude`` has ``query_col`` and
    ``id_col``, a few results a query that do not count. Ids are integers or strings. Null
    vectors and ids are left out; vectors of different lengths do not meet. Queries of up to
    MAX_COMPONENTS components in all are broadcast, and the vectors stay where they are; more
    are cut into blocks, which meet slabs of the vectors in a shuffle, whatever their number.
    A task keeps k rows a query throughout, and a ranked window reduces the tasks' rows to k.
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    asked = queries.where(F.col(vector_col).isNotNull() & F.col(query_col).isNotNull()).select(F.col(query_col).alias("query"), F.col(vector_col).alias("v"))
    facts = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    deep = k + (exclude.groupBy(query_col).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] if exclude is not None else 0)
    members = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    if facts["n"] * max(1, facts["dim"] or 1) > MAX_COMPONENTS or facts["n"] * 4 * deep > MAX_SCORES:
        found = _beside(members, asked, deep, skip_self)
    else:
        rows = asked.toPandas()
        lengths = rows["v"].map(len)
        shared = spark.sparkContext.broadcast({d: (rows["query"][lengths == d].to_numpy(), _matrix(rows["v"][lengths == d])) for d in lengths.unique()})

        def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = {d: _Best(names, q, deep, skip_self) for d, (names, q) in shared.value.items()}
            for batch in batches:
                for d, part in batch.groupby(batch["v"].map(len)):
                    if d in best:
                        best[d].add(part["id"].to_numpy(), part["v"])
            for some in best.values():
                yield from some.rows()

        key, kind = queries.schema[query_col].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
        found = members.mapInPandas(block, f"query {key}, id {kind}, score double")
    found = found.select(F.col("query").alias(query_col), F.col("id").alias(id_col), "score")
    if exclude is not None:
        found = found.join(exclude.select(query_col, id_col), [query_col, id_col], "left_anti")
    return _ranked(found, k, query_col, id_col)


class CellIndex:
    """Vectors under the nearest of ``cells`` coarse centroids, for searches that look into a few cells only.

    The number of cells is the square root of the number of rows unless it is given. Centroids are fitted on
    at most ``max(50 * cells, 100_000)`` vectors picked by a hash of the id; all vectors are indexed. Vectors are
    of one length; null ones and null ids are left out. ``table`` is stored below the shared folder and has a ``cell`` column;
    written partitioned by it, a search reads no other cells' files. Each cell knows how far its members lie from
    its centroid, so :meth:`search_exact` can tell which cells a query need not look into.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> None:
        self.id_col, self.vector_col = id_col, vector_col
        vectors = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
        n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size(vector_col))).first()
        if not n:
            raise ValueError("an index needs vectors")
        cells = max(2, min(cells or int(np.ceil(n**0.5)), MAX_CELLS, MAX_COMPONENTS // max(1, dim)))
        most = max(50 * cells, 100_000)
        sample = vectors if n <= most else vectors.where(F.pmod(F.xxhash64(id_col), F.lit(n)) < most)
        features = array_to_vector(V.as_double(F.col(vector_col))).alias("features")
        self.model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample.select(features))
        self.centres = np.array(self.model.clusterCenters())
        self.table = saved(self.model.setPredictionCol("cell").transform(vectors.withColumn("features", features)).drop("features"))
        self.radii = self._radii()

    def _radii(self) -> np.ndarray:
        """The largest distance of a cell's members from its centroid; below zero where it has none."""
        centres = self.table.sparkSession.sparkContext.broadcast(self.centres)

        def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    far = np.linalg.norm(_matrix(batch["v"]) - centres.value[batch["cell"].to_numpy()], axis=1)
                    yield pd.DataFrame({"cell": batch["cell"], "far": far}).groupby("cell", as_index=False).max()

        ship(self.table.sparkSession)
        rows = self.table.select("cell", F.col(self.vector_col).alias("v")).mapInPandas(farthest, "cell int, far double").groupBy("cell").agg(F.max("far")).collect()
        radii = np.full(len(self.centres), -np.inf)
        for cell, far in rows:  # a row a cell
            radii[cell] = far
        return radii

    def _lists_of(self, asked: DataFrame, choose) -> DataFrame:
        """``(query, v, cells)``: the cells that ``choose(batch, vectors, products with the centroids)`` gives for each query, null where it gives none at all."""
        centres = self.table.sparkSession.sparkContext.broadcast(self.centres)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                step = max(1, CHUNK_SCORES // len(centres.value))
                for at in range(0, len(batch), step):
                    part = batch.iloc[at : at + step]
                    q = _matrix(part["v"])
                    yield part[["query", "v"]].assign(cells=choose(part, q, q @ centres.value.T))

        ship(self.table.sparkSession)
        kind = asked.schema["query"].dataType.simpleString()
        return asked.mapInPandas(look, f"query {kind}, v array<double>, cells array<int>")

    def _cells_of(self, asked: DataFrame, choose) -> DataFrame:
        return self._lists_of(asked, choose).select("query", "v", F.explode("cells").alias("cell"))

    def _asked(self, queries: DataFrame, query_col: str) -> DataFrame:
        v = F.col(self.vector_col)
        return queries.where((F.size(v) == self.centres.shape[1]) & F.col(query_col).isNotNull()).select(F.col(query_col).alias("query"), V.as_double(v).alias("v"))

    def nearest_cells(self, queries: DataFrame, probes: int, query_col: str = "query_id") -> DataFrame:
        """``(query, v, cell)``: each query's ``probes`` cells of largest inner product."""
        return self._cells_of(self._asked(queries, query_col), lambda batch, q, s: np.argsort(-s, axis=1, kind="stable")[:, :probes].tolist())

    def _meet(self, wanted: DataFrame, k: int, skip_self: bool, query_col: str) -> DataFrame:
        wanted = saved(wanted)
        cells = [r["cell"] for r in wanted.select("cell").distinct().collect()]  # a row a cell
        table = self.table if len(cells) == len(self.centres) else self.table.where(F.col("cell").isin(cells))
        found = _in_cells(table.select(F.col(self.id_col).alias("id"), F.col(self.vector_col).alias("v"), "cell"), wanted, k, skip_self)
        return found.select(F.col("query").alias(query_col), F.col("id").alias(self.id_col), "score")

    def search(self, queries: DataFrame, k: int, probes: int, query_col: str = "query_id", skip_self: bool = True) -> DataFrame:
        """As :func:`batch_search`, among the vectors of each query's ``probes`` cells of largest inner product."""
        return _ranked(self._meet(self.nearest_cells(queries, probes, query_col), k, skip_self, query_col), k, query_col, self.id_col)

    def further_cells(self, queries: DataFrame, found: DataFrame, k: int, probes: int, query_col: str = "query_id") -> DataFrame:
        """``(query, v, cell)``: cells beyond the first ``probes`` that may hold one of a query's k best, given what was found in those.

        No member's product exceeds the centroid's by more than the query's length times the
        cell's radius, so a cell whose bound is below the k-th score found is left out.
        """
        return self._further(queries, found, k, probes, query_col).select("query", "v", F.explode("cells").alias("cell"))

    def _further(self, queries: DataFrame, found: DataFrame, k: int, probes: int, query_col: str, most: float = float("inf")) -> DataFrame:
        """As :meth:`further_cells`, as a list a query, which is null where it would have more than ``most`` cells."""
        last = found.where(F.col("rank") == k).select(F.col(query_col).alias("name"), "score")
        asked = self._asked(queries, query_col).join(last, F.col("query") == F.col("name"), "left").select("query", "v", F.coalesce("score", F.lit(float("-inf"))).alias("least"))
        radii = self.radii

        def choose(batch, q, s):
            size = np.linalg.norm(q, axis=1, keepdims=True)
            slack = 1e-9 * (1 + np.abs(s).max(initial=0) + size)
            may = s + size * np.maximum(radii, 0) + slack >= batch["least"].to_numpy()[:, None]
            np.put_along_axis(may, np.argsort(-s, axis=1, kind="stable")[:, :probes], False, axis=1)
            may[:, radii < 0] = False
            return [None if row.sum() > most else np.flatnonzero(row).tolist() for row in may]

        return self._lists_of(asked, choose)

    def search_exact(self, queries: DataFrame, k: int, probes: int, query_col: str = "query_id", skip_self: bool = True, copy: int = COPY) -> DataFrame:
        """Exactly what :func:`batch_search` finds: the ``probes`` nearest cells first, then those that may still hold one of the k best.

        Each cell that a query looks into costs a copy of the query in a shuffle, as much as
        ``copy`` products. A query that would have to look into so many that comparing it
        with all rows is cheaper is compared with all rows. With ``copy=0`` none is.
        """
        n = self.table.count()
        most = n / (copy + n / len(self.centres)) if copy else float("inf")
        plain = lambda some: batch_search(self.table, some, k, self.id_col, self.vector_col, query_col, skip_self)
        if most < probes + 1:
            return plain(queries)
        first = saved(self.search(queries, k, probes, query_col, skip_self))
        cells = self._further(queries, first, k, probes, query_col, most - probes)
        exploded = lambda some: some.select("query", "v", F.explode("cells").alias("cell"))
        if not copy:
            return _ranked(first.drop("rank").union(self._meet(exploded(cells), k, skip_self, query_col)), k, query_col, self.id_col)
        cells = saved(cells)  # a row a query: vectors are copied for those cells only that are looked into
        wide = cells.where("cells IS NULL").select(F.col("query").alias(query_col), F.col("v").alias(self.vector_col))
        rest = self._meet(exploded(cells.where("cells IS NOT NULL")), k, skip_self, query_col)
        kept = first.join(wide.select(query_col), query_col, "left_anti")
        return _ranked(kept.drop("rank").union(rest), k, query_col, self.id_col).union(plain(wide))

    def probes_for(self, queries: DataFrame, k: int, recall: float, query_col: str = "query_id", sample: int = 200) -> int:
        """How many cells find ``recall`` of the exact k best of up to ``sample`` queries, picked by a hash."""
        some = saved(queries.where((F.size(self.vector_col) == self.centres.shape[1]) & F.col(query_col).isNotNull()).select(query_col, self.vector_col).orderBy(F.xxhash64(query_col), query_col).limit(sample))
        exact = batch_search(self.table, some, k, self.id_col, self.vector_col, query_col).select(F.col(query_col).alias("query"), F.col(self.id_col).alias("id"))
        held = self.table.select(F.col(self.id_col).alias("id"), F.col("cell").alias("at"))
        homes = held.join(F.broadcast(exact), "id").select("query", "at").toPandas()  # up to k rows a query of the sample
        asked = {r["query"]: np.array(r["v"]) for r in self._asked(some, query_col).collect()}
        places = [int(np.flatnonzero(np.argsort(-(self.centres @ asked[q]), kind="stable") == at)[0]) for q, at in zip(homes["query"], homes["at"])]
        return 1 + int(np.sort(places)[max(0, int(np.ceil(recall * len(places))) - 1)]) if places else 1

    def save(self, path: str) -> None:
        """The vectors by cell, a folder a cell and a file for some 64 million components of it, and the centroids beside them."""
        slab = max(1, SLAB_COMPONENTS // self.centres.shape[1])
        held = self.table.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / slab).alias("__files"))
        spread = self.table.join(F.broadcast(held), "cell").withColumn("__file", F.pmod(F.xxhash64(self.id_col), F.col("__files")))  # a row a cell
        spread.repartition("cell", "__file").drop("__file", "__files").write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{path}/vectors")
        rows = [(i, c.tolist(), float(r)) for i, (c, r) in enumerate(zip(self.centres, self.radii))]
        self.table.sparkSession.createDataFrame(rows, "cell int, centre array<double>, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> CellIndex:
        """A saved index; searches read the cells that they probe."""
        found = cls.__new__(cls)
        found.id_col, found.vector_col, found.model = id_col, vector_col, None
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        found.centres, found.radii = np.array([r["centre"] for r in rows]), np.array([r["radius"] for r in rows])
        found.table = spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("int"))
        return found


def recall(found: DataFrame, exact: DataFrame, query_col: str = "query_id", id_col: str = "vec_id") -> float:
    """Share of the exact results that were found."""
    hits = exact.join(found.select(query_col, id_col), [query_col, id_col], "left_semi").count()
    return hits / max(1, exact.count())
