"""Exact similarity join of vectors: all pairs of a cosine at or above a threshold, by pivots.

Angles between vectors are a metric, so distances to a few pivots bound those between the
vectors. Each vector lives in the cell of its nearest pivot. It is compared with a cell's
members only if the cell can hold a partner:

* its angle to the cell's pivot is at most the cell's radius plus the threshold's angle, and
* at most its angle to its own pivot plus twice the threshold's angle, as a partner is
  nearer to the other pivot than to this one; and then only with the rings of the cell, by
  their angle to the pivot, that lie within the threshold's angle of its own.

A partner's cell and rings are always among these, so nothing is missed, and since that holds
for both ends of a pair, a vector looks into its own cell and those behind it only.

Rings are dealt into a bounded number of groups, and a vector is copied once for each group
that it looks into, not for each ring: where vectors hardly cluster it is copied as often as
there are groups. A task holds a group's members, of which there is a bounded number, and lets
those that look into it pass, each compared with the rings within its reach.

Equal vectors are joined once: pairs are between their first rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import acos

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.runtime import saved, ship

#: Pivots at most, vectors of the sample for each, components of the sample or of a task's members at most, and rows of a ring.
MAX_PIVOTS, SAMPLE_SHARE, MAX_COMPONENTS, BLOCK = 1024, 16, 4_000_000, 1024
#: Groups of rings at most; blocks of members that a task holds at most, and of vectors that pass it.
GROUPS, HELD, PASSED = 64, 16, 64
#: What angles are off by at most for rounding, near zero above all.
SLACK = 1e-6


def distinct_vectors(items: DataFrame, id_col: str, vector: str, threshold: float, within: str | None = None) -> DataFrame:
    """``(id, rep, copies, within, v)``: each row and the least id of those that equal it in vector and ``within``; null vectors are left out.

    Equal vectors so short that not even they reach the threshold, as zero ones, stay apart.
    """
    rows = items.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), (F.col(within) if within else F.lit(0)).alias("within"), V.as_double(F.col(vector)).alias("v"))
    size = V.norm(F.col("v"))
    rows = rows.withColumn("apart", F.when(F.pow(size / (size + V.ADDED_EPS), 2) < threshold, F.col("id")))
    kinds = rows.groupBy("within", "v", "apart").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    kinds = kinds.select("rep", "copies", F.col("within").alias("w"), F.col("v").alias("u"), F.col("apart").alias("x"))
    same = F.col("within").eqNullSafe(F.col("w")) & (F.col("v") == F.col("u")) & F.col("apart").eqNullSafe(F.col("x"))
    return rows.join(kinds, same).select("id", "rep", "copies", "within", "v")


@dataclass
class _Dealt:
    members: DataFrame
    probes: DataFrame
    key: list[str]
    pairs: Callable[[Iterator[pd.DataFrame], bool], Iterator[pd.DataFrame]]


def _unit(rows: pd.Series) -> np.ndarray:
    """Rows divided by their norm, to which a small number is added."""
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + V.ADDED_EPS)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    length = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.arccos(np.clip(x / length @ pivots.T, -1.0, 1.0))


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors of up to n rows, each the farthest from those before, so that no group of the sample is without one."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = (x / np.maximum(size, 1e-300))[size[:, 0] > 0]
    chosen, nearest = [0] if len(x) else [], np.full(len(x), -1.0)
    while 0 < len(chosen) < min(n, len(x)):
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
        if nearest.min() > 1 - 1e-9:
            break
        chosen.append(int(nearest.argmin()))
    return x[chosen]


def _deal(reps: DataFrame, threshold: float, width: str = "double") -> _Dealt:
    """Members of cells and who looks into them, by cell, ring and blocks of both; ``reps`` has ``n, within, v``, numbers unique, and is cheap to read."""
    spark = reps.sparkSession
    facts = reps.groupBy(F.size("v").alias("dim")).count().collect()
    reach = acos(min(1.0, max(-1.0, threshold)))
    pivots: dict[int, np.ndarray] = {}
    for r in facts:  # a row a length of vectors
        most = max(1, min(MAX_PIVOTS, int(r["count"] ** 0.5)))
        sample = max(1, min(SAMPLE_SHARE * most, MAX_COMPONENTS // max(1, r["dim"])))
        picked = reps.where((F.size("v") == r["dim"]) & (F.pmod(F.xxhash64("n"), F.lit(r["count"])) < sample)).orderBy("n").limit(2 * sample)
        if threshold > 0 and r["dim"] and (some := [x["v"] for x in picked.select("v").collect()]):
            pivots[r["dim"]] = _spread(np.array(some), most)
    shared = spark.sparkContext.broadcast(pivots)  # bounded components

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                cell, angle = np.zeros(len(part), dtype=np.int32), np.zeros(len(part))
                if len(p := shared.value.get(dim, ())):
                    angles = _angles(np.stack(part["v"].to_numpy()), p)
                    cell, angle = angles.argmin(1).astype(np.int32), angles.min(1)
                yield part.assign(dim=np.int32(dim), cell=cell, angle=angle)

    kind = f"n long, within {reps.schema['within'].dataType.simpleString()}, v array<double>"
    homes = saved(reps.select("n", "within", "v").mapInPandas(home, f"{kind}, dim int, cell int, angle double"))
    cells = {(r["dim"], r["cell"]): (r["radius"], max(1, -(-r["count"] // BLOCK))) for r in homes.groupBy("dim", "cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("count")).collect()}
    spread: dict[int, tuple[np.ndarray, ...]] = {}
    for dim in {d for d, _ in cells}:
        here = sorted(c for d, c in cells if d == dim)
        radii, rings = np.array([cells[dim, c][0] for c in here]), np.array([cells[dim, c][1] for c in here])
        spread[dim] = np.array(here), radii, rings, np.cumsum(rings) - rings
    known = spark.sparkContext.broadcast((spread, {d: max(1, min(GROUPS, int(x[2].sum()))) for d, x in spread.items()}))  # a row a pivot

    def ring_of(angle, radius, rings):
        return np.minimum((angle / max(radius, 1e-12) * rings).astype(np.int32), rings - 1)

    def reached(own, own_angle, to, cell, radius, rings):
        """Who looks into a cell, and the first and last of its rings for each."""
        near = (own == cell) | ((cell > own) & (to <= np.minimum(radius + reach, own_angle + 2 * reach) + SLACK))
        at = np.flatnonzero(near)
        low, high = (ring_of(np.clip(to[at] + s * (reach + SLACK), 0, radius), radius, rings) for s in (-1, 1))
        return at, low, high

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                p, (there, radii, rings, first) = shared.value.get(dim, ()), known.value[0][dim]
                groups = known.value[1][dim]
                group_of = lambda place, groups=groups, every=rings.sum(): place * groups // every
                angles = _angles(np.stack(part["v"].to_numpy()), p) if len(p) else np.zeros((len(part), 1))
                own, own_angle = part["cell"].to_numpy(), part["angle"].to_numpy()
                mine, steps = np.zeros(len(part), dtype=np.int32), np.zeros((len(part), groups + 1), dtype=np.int32)
                for cell, radius, n, start in zip(there, radii, rings, first):
                    here = own == cell
                    mine[here] = ring_of(own_angle[here], radius, n)
                    at, low, high = reached(own, own_angle, angles[:, cell], cell, radius, n)
                    steps[at, group_of(start + low)] += 1
                    steps[at, group_of(start + high) + 1] -= 1
                home = group_of(first[np.searchsorted(there, own)] + mine).astype(np.int32)
                visits = [np.flatnonzero(row).tolist() for row in np.cumsum(steps[:, :-1], axis=1) > 0]
                yield part.assign(ring=mine, group=home, visits=visits)[["n", "within", "v", "dim", "cell", "angle", "ring", "group", "visits"]]

    kind = kind.replace("array<double>", f"array<{width}>")  # as they came
    placed = saved(homes.mapInPandas(look, f"{kind}, dim int, cell int, angle double, ring int, group int, visits array<int>"))
    key = ["within", "dim", "group"]
    held = ["n", "within", "v", "dim", "cell", "angle", "ring"]
    members, probes = placed.select(*held, "group"), placed.select(*held, F.explode("visits").alias("group"))
    most = F.greatest(F.lit(1), F.least(F.lit(HELD * BLOCK), F.floor(F.lit(MAX_COMPONENTS) / F.greatest(F.col("dim"), F.lit(1)))))
    blocks = lambda df, name, size: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name)).select(*(F.col(c).alias(f"{c}_{name}") for c in key), name)
    same = lambda name: F.col("within").eqNullSafe(F.col(f"within_{name}")) & (F.col("dim") == F.col(f"dim_{name}")) & (F.col("group") == F.col(f"group_{name}"))
    m, p = saved(blocks(members, "km", most)), saved(blocks(probes, "kp", F.lit(PASSED * BLOCK)))
    hashed = lambda k: F.pmod(F.xxhash64("n"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    # Who shares a place is told by a number, as pandas would make floats of integers beside nulls.
    w = F.col("within") + F.lit(0.0) if reps.schema["within"].dataType.simpleString() in ("float", "double") else F.col("within")  # no zero below zero
    row = [F.xxhash64(w).alias("within"), F.coalesce(w.cast("string"), F.lit("")).alias("name"), F.col("within").isNull().alias("none"), "dim", "group", "n", "v", "cell", "angle", "ring"]
    sized = lambda df: df.join(m, same("km")).join(p, same("kp"))

    def pairs(batches: Iterator[pd.DataFrame], counted: bool) -> Iterator[pd.DataFrame]:
        """``(a, b, sim)`` by number, each pair once, or how many products are formed for it."""
        for dim, member, part in _runs(batches, ["within", "name", "none", "dim", "group", "i", "j"]):
            pivots, (there, radii, rings, _) = shared.value.get(dim, ()), known.value[0][dim]
            y, their, home = _unit(member["v"]), member["n"].to_numpy(), member["cell"].to_numpy()
            x, n = _unit(part["v"]), part["n"].to_numpy()
            own, own_angle, ring = part["cell"].to_numpy(), part["angle"].to_numpy(), member["ring"].to_numpy()
            for cell in np.unique(home):
                radius, count = radii[np.searchsorted(there, cell)], rings[np.searchsorted(there, cell)]
                to = _angles(np.stack(part["v"].to_numpy()).astype(np.float64), pivots[cell : cell + 1])[:, 0] if len(pivots) else np.zeros(len(part))
                at, low, high = reached(own, own_angle, to, cell, radius, count)
                for r in np.unique(ring[home == cell]):
                    p, m = at[(low <= r) & (r <= high)], np.flatnonzero((home == cell) & (ring == r))
                    for some in range(0, len(m), BLOCK) if len(p) else ():
                        block = m[some : some + BLOCK]
                        if counted:
                            yield pd.DataFrame({"a": [0], "b": [0], "sim": [float(len(p) * len(block))]})
                            continue
                        sims = x[p] @ y[block].T
                        a, b = np.divmod(np.flatnonzero(sims >= threshold), len(block))
                        # Within a cell both look for each other: the one numbered first counts.
                        once = (own[p][a] != cell) | (n[p][a] < their[block][b])
                        a, b = a[once], b[once]
                        yield pd.DataFrame({"a": n[p][a], "b": their[block][b], "sim": sims[a, b]})

    return _Dealt(
        sized(members).select(*row, hashed("km").alias("i"), every("kp").alias("j"), F.lit(True).alias("member")),
        sized(probes).select(*row, every("km").alias("i"), hashed("kp").alias("j"), F.lit(False).alias("member")),
        ["within", "name", "none", "dim", "group", "i", "j"],
        pairs,
    )


def _runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[int, pd.DataFrame, pd.DataFrame]]:
    """``(dim, members, others)`` by key, members whole and others in parts; rows come by key, members first."""
    here, waiting, held = None, [], None
    for batch in batches:
        if not len(batch):
            continue
        new = (batch[key] != batch[key].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], len(batch)]):
            run = batch.iloc[a:b]
            if here != tuple(run[key].iloc[0]):
                here, waiting, held = tuple(run[key].iloc[0]), [], None
            member = run["member"].to_numpy(dtype=bool)
            if member.any():
                waiting.append(run[member])
            if not member.all() and (held is not None or waiting):
                held = pd.concat(waiting) if held is None else held
                waiting = []
                others = run[~member]
                for at in range(0, len(others), 4096):
                    yield int(others["dim"].iloc[0]), held, others.iloc[at : at + 4096]


def _pairs(dealt: _Dealt, counted: bool = False) -> DataFrame:
    """``(a, b, sim)`` by number, each pair once; if ``counted``, ``sim`` sums up to the products that are formed for them."""
    pairs = dealt.pairs
    rows = dealt.members.union(dealt.probes).repartition(*dealt.key).sortWithinPartitions(*dealt.key, F.desc("member"))
    return rows.mapInPandas(lambda batches: pairs(batches, counted), "a long, b long, sim double")


def _numbered(distinct: DataFrame) -> DataFrame:
    reps = distinct.where(F.col("id") == F.col("rep"))
    return saved(reps.dropDuplicates(["rep", "within", "v"]).select("rep", "copies", "within", "v").withColumn("n", F.monotonically_increasing_id()))


def threshold_pairs(items: DataFrame, id_col: str, vector: str, threshold: float, within: str | None = None) -> DataFrame:
    """``(within, a, b, sim, a_copies, b_copies)``: pairs of different vectors whose cosine reaches the threshold, the least ids of their copies, a before b.

    1e-9 is added to norms, so zero vectors have a cosine of 0. Vectors of different lengths
    and, if given, of different ``within`` are no pair; null is a value of it like any other.
    Rows with a null vector or id are left out; ids should be unique. At a threshold of 0 or
    below all pairs are compared, block by block. :func:`distinct_vectors` tells who the
    copies are: each pair stands for all pairs of its copies.
    """
    ship(items.sparkSession)
    reps = _numbered(distinct_vectors(items.where(F.col(id_col).isNotNull()), id_col, vector, threshold, within))
    found = _pairs(_deal(reps, threshold, "float" if items.schema[vector].dataType.simpleString() == "array<float>" else "double"))
    names = lambda c: reps.select(F.col("n").alias(f"n_{c}"), F.col("rep").alias(f"id_{c}"), F.col("copies").alias(f"copies_{c}"), F.col("within").alias(f"within_{c}"))
    named = found.join(names("a"), F.col("a") == F.col("n_a")).join(names("b"), F.col("b") == F.col("n_b"))
    swap = F.col("id_a") > F.col("id_b")
    either = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    return named.select(F.col("within_a").alias("within"), either("id_b", "id_a").alias("a"), either("id_a", "id_b").alias("b"), "sim", either("copies_b", "copies_a").alias("a_copies"), either("copies_a", "copies_b").alias("b_copies"))


def compared(items: DataFrame, id_col: str, vector: str, threshold: float, within: str | None = None) -> int:
    """How many products the join forms, to be held against the number of pairs."""
    dealt = _deal(_numbered(distinct_vectors(items, id_col, vector, threshold, within)), threshold)
    return int(_pairs(dealt, True).agg(F.coalesce(F.sum("sim"), F.lit(0.0))).first()[0])
