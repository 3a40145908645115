"""The leading subspace of a tall table by random projections: principal components, and vectors of texts.

A round multiplies the table's transpose by the table and a narrow basis. Tasks sum their
rows' shares; the driver gets one row a column of the table, of the basis' width, and makes
the basis orthonormal again. The square matrix of the columns is never formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from mosaiq.functions import text as T
from mosaiq.functions import vectors as V
from mosaiq.functions.encode import ENTRIES, Terms, weights
from mosaiq.runtime import ship, stored

#: Columns of the basis beyond those asked for, and rounds; more of either come nearer to the exact subspace.
EXTRA, ROUNDS = 10, 2
#: Rows, or entries of sparse rows, that a task multiplies at a time.
_ROWS, _ENTRIES = 2048, ENTRIES


def signs(rows: int, columns: int, seed: str = "42") -> np.ndarray:
    """A matrix of 1 and -1, each by the first bit of the MD5 digest of ``seed|row|column``."""
    one = lambda i, j: 1.0 if hashlib.md5(f"{seed}|{i}|{j}".encode()).digest()[0] < 128 else -1.0
    return np.array([[one(i, j) for j in range(columns)] for i in range(rows)]).reshape(rows, columns)


def finite(vector: Column, dim: int) -> Column:
    """Whether a vector is there, of the length asked for, and has numbers throughout."""
    bad = F.exists(V.as_double(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def _summed(rows: DataFrame, shares: Callable[[Iterator[pa.RecordBatch], np.ndarray], np.ndarray | None], basis: np.ndarray) -> np.ndarray:
    """The sum over all tasks of what ``shares`` gives for a task's batches: a matrix of the basis' shape."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(basis)  # columns x the basis' width

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shares(batches, shared.value)
        seen = [] if found is None else np.flatnonzero(found.any(axis=1))
        if len(seen):
            yield pa.RecordBatch.from_pydict({"i": seen, "s": list(found[seen])})

    total = np.zeros_like(basis)
    for r in rows.mapInArrow(part, "i long, s array<double>").groupBy("i").agg(V.sum_by_position("s").alias("s")).collect():
        total[r["i"]] = r["s"]
    shared.unpersist()
    return total


def subspace(multiply: Callable[[np.ndarray], np.ndarray], columns: int, width: int, rounds: int = ROUNDS, seed: str = "42") -> np.ndarray:
    """An orthonormal basis after ``rounds`` of multiplying by the columns' products, from a matrix of signs.

    Where the table has fewer directions than ``width``, the rest of the basis is arbitrary.
    """
    basis = signs(columns, min(width, columns), seed)
    for _ in range(rounds):
        basis = np.linalg.qr(multiply(basis))[0]
    return basis


@dataclass(frozen=True)
class Components:
    """Principal components: the mean, a column a component, the variances along them and the variance of all."""

    mean: np.ndarray
    basis: np.ndarray
    variances: np.ndarray
    total: float

    def project(self, df: DataFrame, vector: str, out: str = "projected", residual: str = "residual") -> DataFrame:
        """``df`` with the vectors' coordinates and ``residual``, the squared distance from what these restore.

        Both are null for vectors that are null, of another length or not finite.
        """
        table = (self.basis.T.tolist(), self.mean.tolist())
        shared = df.sparkSession.createDataFrame([table], "__basis array<array<double>>, __mean array<double>")
        rows = df.crossJoin(F.broadcast(shared))  # one row
        away = V.subtract(F.col(vector), F.col("__mean"))
        rows = rows.withColumn("__away", F.when(finite(F.col(vector), len(self.mean)), away))
        rows = rows.withColumn(out, F.when(F.col("__away").isNotNull(), F.transform("__basis", lambda b: V.dot(F.col("__away"), b))))
        square = lambda c: V.dot(F.col(c), F.col(c))
        return rows.withColumn(residual, F.greatest(square("__away") - square(out), F.lit(0.0)) + F.col("__away")[0] * 0).drop("__basis", "__mean", "__away")


def components(df: DataFrame, vector: str, dim: int, n: int, extra: int = EXTRA, rounds: int = ROUNDS, seed: str = "42") -> Components:
    """The first ``n`` principal components of centred vectors of length ``dim``; a scan a round and two more.

    Vectors that are null, of another length or not finite are left out; without any, or
    without two different ones, variances are 0.
    """
    rows = df.where(finite(F.col(vector), dim)).select(V.as_double(F.col(vector)).alias("v"))
    facts = rows.groupBy(F.lit(1)).agg(F.count(F.lit(1)).alias("n"), V.sum_by_position("v").alias("s")).first()  # none without rows
    count = facts["n"] if facts else 0
    mean = np.array(facts["s"]) / count if count else np.zeros(dim)

    def shares(batches: Iterator[pa.RecordBatch], basis: np.ndarray) -> np.ndarray | None:
        total = None
        for batch in batches:
            vectors = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for at in range(0, len(vectors), _ROWS):
                x = vectors[at : at + _ROWS] - mean
                found = x.T @ (x @ basis)
                total = found if total is None else total + found
        return total

    multiply = lambda basis: _summed(rows, shares, basis)
    basis = subspace(multiply, dim, n + extra, rounds, seed)
    values, turned = np.linalg.eigh(basis.T @ multiply(basis))
    first = np.argsort(-values)[:n]
    square = rows.select(V.subtract(F.col("v"), F.array(*map(F.lit, mean.tolist()))).alias("d")).agg(F.sum(V.dot(F.col("d"), F.col("d")))).first()[0] or 0.0
    return Components(mean, basis @ turned[:, first], np.maximum(values[first], 0) / max(1, count), square / max(1, count))


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The items of all lists of a column without nulls, one after the other."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _lists(lengths: np.ndarray, items: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(items, kind))


def count_terms(df: DataFrame, text: str, buckets: int = 1 << 14, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and ``terms, counts``: a text's different terms, and how often each occurs; stored, so that texts are read once.

    A null text is an empty one.
    """
    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            lengths, terms, counts = T.counted_terms(texts, buckets)
            yield pa.RecordBatch.from_arrays([*kept, _lists(lengths, terms, pa.int32()), _lists(lengths, counts, pa.int32())], [*keep, "terms", "counts"])

    rows = df.select(*keep, F.col(text))
    lists = S.StructType([S.StructField(n, S.ArrayType(S.IntegerType())) for n in ("terms", "counts")])
    return stored(rows.mapInArrow(count, S.StructType(rows.schema.fields[:-1] + lists.fields)))


def placed(counted: DataFrame, model: Terms, keep: Sequence[str], out: str = "vector") -> DataFrame:
    """``keep`` and the vectors of texts that :func:`count_terms` has counted."""
    ship(counted.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, _, _ = batch.columns
            found = model.place(np.diff(batch.column("terms").offsets.to_numpy()), _flat(batch, "terms"), _flat(batch, "counts"))
            yield pa.RecordBatch.from_arrays([*kept, _lists(np.full(len(found), found.shape[1]), found.ravel(), pa.float64())], [*keep, out])

    rows = counted.select(*keep, "terms", "counts")
    return rows.mapInArrow(place, S.StructType(rows.schema.fields[:-2]).add(out, S.ArrayType(S.DoubleType())))


def fit_terms(df: DataFrame, text: str, dims: int, buckets: int = 1 << 14, extra: int = EXTRA, rounds: int = ROUNDS, seed: str = "42") -> Terms:
    """Fit :class:`mosaiq.functions.encode.Terms` on all rows: weights of terms, and the leading subspace of the weighted table.

    Terms share ``buckets`` entries, by a hash, so that the model does not grow with the
    rows. A null text is an empty one; those without words count as rows and teach nothing.
    """
    return fit_counted(count_terms(df, text, buckets), dims, buckets, extra, rounds, seed)


def fit_counted(rows: DataFrame, dims: int, buckets: int = 1 << 14, extra: int = EXTRA, rounds: int = ROUNDS, seed: str = "42") -> Terms:
    """As :func:`fit_terms`, of texts that :func:`count_terms` has counted; a scan a round."""
    rows = rows.select("terms", "counts")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch, "terms"), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": seen, "n": total[seen]})

    seen = rows.mapInArrow(held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a bucket at most
    size = rows.count()
    rarity = np.full(buckets, np.log(1.0 + size) + 1)
    for r in seen:
        rarity[r["term"]] = np.log((1 + size) / (1 + r["n"])) + 1

    def shares(batches: Iterator[pa.RecordBatch], basis: np.ndarray) -> np.ndarray | None:
        total = np.zeros(basis.T.shape)
        columns = np.ascontiguousarray(basis.T)
        for batch in batches:
            lengths = np.diff(batch.column("terms").offsets.to_numpy())
            for starts, term, weight in weights(lengths[lengths > 0], _flat(batch, "terms"), _flat(batch, "counts"), rarity, _ENTRIES):
                n = np.diff(starts, append=len(term))
                for sums, column in zip(total, columns):
                    places = np.add.reduceat(weight * column[term], starts)
                    sums += np.bincount(term, weight * np.repeat(places, n), buckets)
        return total.T

    basis = subspace(lambda b: _summed(rows, shares, b), buckets, dims + extra, rounds, seed)
    values, turned = np.linalg.eigh(basis.T @ _summed(rows, shares, basis))
    return Terms(rarity, basis @ turned[:, np.argsort(-values)[:dims]])
