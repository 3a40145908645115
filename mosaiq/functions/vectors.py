"""Column expressions on vectors (``array<float>`` or ``array<double>``); all arithmetic is in double precision."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards against division by zero: a floor under the norm, or an addition to it.
FLOOR_EPS, ADDED_EPS = 1e-10, 1e-9


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where either vector is null or the lengths differ."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(as_double(v), lambda x: x * x)))


def normalise(v: Column, added: bool = False) -> Column:
    """Unit length. A zero vector stays zero. ``added`` adds a small number to the norm instead of raising it to one."""
    size = norm(v) + ADDED_EPS if added else F.greatest(norm(v), F.lit(FLOOR_EPS))
    return F.transform(as_double(v), lambda x: x / size)


def scale(v: Column, by: Column) -> Column:
    return F.transform(as_double(v), lambda x: x * by)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(FLOOR_EPS))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.transform(subtract(a, b), lambda x: x * x)))


def variance(v: Column) -> Column:
    """Population variance of a vector's components."""
    mean = total(as_double(v)) / F.size(v)
    return total(F.transform(as_double(v), lambda x: (x - mean) * (x - mean))) / F.size(v)


def concat(*vectors: Column) -> Column:
    """Vectors one after the other, in the given order."""
    return F.concat(*map(as_double, vectors))


def block(v: Column, i: int, width: int) -> Column:
    """The i-th of the equal parts that a concatenated vector is made of, from 0."""
    return F.slice(as_double(v), i * width + 1, width)


def mean_by_position(name: str) -> Column:
    """Aggregate: the element-wise mean of a vector column without nulls, of any one length, summed partially in each task."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(F.col(name)))))


def sum_by_position(name: str) -> Column:
    """Aggregate: the element-wise sum, as :func:`mean_by_position`."""
    return vector_to_array(Summarizer.sum(array_to_vector(as_double(F.col(name)))))


def top(v: Column, n: int) -> Column:
    """The n largest components, descending."""
    return F.slice(F.sort_array(as_double(v), asc=False), 1, n)


def margin(v: Column) -> Column:
    """The largest component minus the second largest."""
    best = top(v, 2)
    return F.get(best, F.lit(0)) - F.get(best, F.lit(1))
