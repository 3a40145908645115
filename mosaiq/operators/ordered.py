"""The first k rows of a total order, and row numbers over it, without a task that holds more than a range.

The k-th key is found digit by digit: counts by digit come to the driver, the digit in which
the k-th row lies is fixed, and only rows that share all fixed digits are counted again.
Rows themselves do not move. Row numbers come from sorted ranges and the sizes of those
before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.runtime import saved

#: Bits of a digit: a count for each of its values is all that the driver gets in a round.
DIGIT = 16
_SIGN = 1 << 63


def _digit(key: str, shift: int, bits: int) -> Column:
    """Bits of a long, counted so that their order is that of signed numbers."""
    return F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-_SIGN)), shift).bitwiseAND(F.lit((1 << bits) - 1))


def first_k(df: DataFrame, keys: Sequence[str], k: int) -> Column:
    """A condition on the columns ``keys`` that holds for the first k rows in their ascending order.

    Keys are longs without nulls. Rows that tie with the k-th on all keys fulfil it too;
    with fewer than k rows all do, with k below 1 none. A table that is not cheap to read
    should be stored before: it is read once a key and digit until the k-th row's digits
    are clear, keys alone.
    """
    if k < 1:
        return F.lit(False)
    left, here, total, bounds = k, df, None, []
    for key in keys:
        low, high, n = here.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        total = n if total is None else total
        if total <= k:
            return F.lit(True)
        shift = ((low + _SIGN) ^ (high + _SIGN)).bit_length()
        prefix = (low + _SIGN) >> shift << shift
        while shift:
            bits = min(DIGIT, shift)
            shift -= bits
            counts = {r["digit"]: r["count"] for r in here.groupBy(_digit(key, shift, bits).alias("digit")).count().collect()}
            for digit in sorted(counts):
                if left <= counts[digit]:
                    break
                left -= counts[digit]
            prefix |= digit << shift
            here = here.where(F.col(key).between(F.lit(prefix - _SIGN), F.lit(prefix + (1 << shift) - 1 - _SIGN)))
            if counts[digit] == left:
                return _up_to(keys, [*bounds, prefix + (1 << shift) - 1 - _SIGN])
        bounds.append(prefix - _SIGN)
    return _up_to(keys, bounds)


def _up_to(keys: Sequence[str], bounds: Sequence[int]) -> Column:
    """Whether the first keys are at most the bounds, compared one after the other."""
    pairs = list(zip(keys, bounds))
    found = F.col(pairs[-1][0]) <= F.lit(pairs[-1][1])
    for key, bound in reversed(pairs[:-1]):
        found = (F.col(key) < F.lit(bound)) | ((F.col(key) == F.lit(bound)) & found)
    return found


def ordinals(df: DataFrame, keys: Sequence[str | Column], out: str = "ord", start: int = 1) -> DataFrame:
    """``df`` with ``out``: dense row numbers from ``start`` in ascending order of ``keys``.

    Rows are sorted in ranges; a row's number is its place in its range plus the sizes of the
    ranges before, of which the driver gets one number each. Rows that tie on all keys are
    numbered in no particular order and share a range; add a key to part very many of them.
    A column named ``out`` is replaced, one named ``__place`` is taken.
    """
    ranged = saved(df.drop(out).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy(part.alias("part")).count().collect())
    starts, at = [], start
    for number, size in sizes:
        starts.append((number, at))
        at += size
    if not starts:
        return ranged.withColumn(out, F.lit(None).cast("long")).drop("__place")
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "__part long, __first long"))  # a row a range
    placed = ranged.join(first, part == F.col("__part"))
    return placed.withColumn(out, F.col("__first") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__place", "__part", "__first")


def running_sums(df: DataFrame, keys: Sequence[str | Column], value: Column, out: str = "before", number: str = "ord") -> DataFrame:
    """``df`` with ``number``, dense row numbers from 1 in ascending order of ``keys``, and ``out``, the sum of ``value`` over the rows before.

    Ranges and names are as in :func:`ordinals`; ``value`` is a whole number, null counts as 0.
    """
    ranged = saved(df.drop(out, number).withColumn("__n", F.coalesce(value.cast("long"), F.lit(0))).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__place", 33))
    starts, rows, total = [], 0, 0
    for r in sorted(ranged.groupBy("__part").agg(F.count(F.lit(1)), F.sum("__n")).collect()):
        starts.append((r[0], rows, total))
        rows, total = rows + r[1], total + r[2]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "__p long, __rows long, __total long"))  # a row a range
    within = F.sum("__n").over(W.partitionBy("__part").orderBy("__place").rowsBetween(W.unboundedPreceding, -1))
    placed = ranged.withColumn("__within", F.coalesce(within, F.lit(0))).join(first, F.col("__part") == F.col("__p"))
    placed = placed.withColumn(number, F.col("__rows") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).withColumn(out, F.col("__total") + F.col("__within"))
    return placed.drop("__n", "__place", "__part", "__within", "__p", "__rows", "__total")


def top_k(df: DataFrame, keys: Sequence[str], k: int, out: str = "ord") -> DataFrame:
    """Exactly the first k rows of ``df`` by ``keys`` with their numbers from 1; all if there are fewer."""
    return ordinals(df.where(first_k(df, keys, k)), keys, out).where(F.col(out) <= k)
