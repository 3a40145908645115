"""Near duplicates by SimHash fingerprints and a binary trie's join with itself.

The fingerprints stand for the leaves of a binary trie of 64 levels. Two nodes of one
level are walked down together, the bits in which their paths differ are counted, and a
pair is given up as soon as the count exceeds its budget.

Two fingerprints that differ in at most k bits differ in at most ``k // 2`` bits of one
half or the other. So the trie is walked twice, the second time over fingerprints with
their halves swapped, each time with a smaller budget for the first 32 levels. That keeps
the number of node pairs at a level near the number of nodes.

Spark cuts the trie at a level where no node has more than a bounded number of leaves,
and sends each pair of nodes within the budget to a task, which walks on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm._common import written
from mosaiq.llm._components import components
from mosaiq.runtime import ship

WORDS, SEED, DISTANCE = 3, 42, 2
#: Leaves below a node of the cut at most, and rows a task should have.
CELL, TASK_ROWS = 1024, 16_384
HALF = 32
_BLOCK = 1 << 15


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if it is set in more than half of the shingles' XXH64 hashes."""
    import xxhash

    found = text.encode().lower().split()  # on bytes: A-Z only, and white space is U+0020 and U+0009 to U+000D
    n = max(1, len(found) - words + 1) if found else 0
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _BLOCK):
        part = found[at : at + _BLOCK + words - 1]
        shingles = map(join, zip(*(part[i:] for i in range(words)))) if n > 1 or len(found) == words else [join(found)]
        hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, more: dict[str, Column] | None = None) -> DataFrame:
    """``(row_id, fp)``, ``fp`` as a signed long, and ``more`` columns. A null text is an empty one; texts without words have 0."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("row_id"), fp(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"), *(c.alias(k) for k, c in (more or {}).items()))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def walk(v: np.ndarray, nodes_a: np.ndarray, nodes_b: np.ndarray, level: int, half: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of leaves within the budget, below the given pairs of nodes, all pairs walked down at once.

    ``v`` holds the leaves, sorted and distinct; a node is the first ``level`` bits of its
    leaves. ``half`` bounds the differing bits of the first 32 levels, ``most`` those of
    all. Below a node paired with itself each unordered pair of different leaves comes once.
    """
    one, empty = np.uint64(1), np.zeros(0, dtype=np.int64)
    above = np.uint64(64 - level)

    def ends(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not level:
            return np.zeros(len(nodes), dtype=np.int64), np.full(len(nodes), len(v))
        first = nodes << above
        return np.searchsorted(v, first), np.searchsorted(v, first | ((one << above) - one), side="right")

    (alo, ahi), (blo, bhi) = ends(nodes_a), ends(nodes_b)
    # A column is a pair of nodes: their ranges of leaves, and the bits in which their paths differ.
    pairs = np.stack([alo, ahi, blo, bhi, np.bitwise_count(nodes_a ^ nodes_b).astype(np.int64)])
    out_a, out_b = [empty], [empty]
    for depth in range(level, 65):
        pairs = pairs[:, (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (pairs[4] <= (half if depth <= HALF else most))]
        alo, ahi, blo, bhi, err = pairs
        single = (ahi - alo == 1) & (bhi - blo == 1)
        x, y = alo[single], blo[single]
        differ = v[x] ^ v[y]
        good = (x != y) & (np.bitwise_count(differ) <= most) & (np.bitwise_count(differ >> np.uint64(HALF)) <= half)
        out_a.append(x[good])
        out_b.append(y[good])
        pairs = pairs[:, ~single]
        if depth == 64 or not pairs.shape[1]:
            break
        alo, ahi, blo, bhi, err = pairs
        bit = np.uint64(63 - depth)
        amid = np.searchsorted(v, ((v[alo] >> bit) | one) << bit).clip(alo, ahi)
        bmid = np.searchsorted(v, ((v[blo] >> bit) | one) << bit).clip(blo, bhi)
        other = alo != blo  # below a node paired with itself, one order of its two children is enough
        children = (
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            (amid[other], ahi[other], blo[other], bmid[other], err[other] + 1),
        )
        pairs = np.concatenate([np.stack(c) for c in children], axis=1)
    return np.concatenate(out_a), np.concatenate(out_b)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` items the smallest one that the pairs connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def _cut_level(fps: DataFrame, n: int) -> int:
    """The first level, in steps of four, at which no node has more than ``CELL`` leaves; 32 if there is none."""
    least = min(HALF, max(0, int(np.ceil(np.log2(max(1, n / CELL))))))
    levels = [*range(least, HALF, 4), HALF]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), _node(k).alias("node")) for k in levels))).alias("x")
    sizes = fps.select(each).groupBy("x").count().groupBy("x.level").agg(F.max("count").alias("most"))
    # One row a level comes to the driver.
    return min([r["level"] for r in sizes.where(F.col("most") <= CELL).collect()], default=HALF)


def _node(level: int) -> Column:
    return F.shiftrightunsigned("fp", 64 - level) if level else F.lit(0).cast("long")


def _join(fps: DataFrame, n: int, half: int, most: int, all_links: bool) -> DataFrame:
    level = _cut_level(fps, n)
    flips = [0]
    for _ in range(min(half, level)):
        flips = sorted({f ^ (1 << k) for f in flips for k in range(level)} | set(flips))
    # A node with more leaves than a task takes, which only happens at level 32, is dealt out in blocks.
    nodes = written(fps.groupBy(_node(level).alias("node")).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks")))
    flipped = F.explode(F.array(*(F.col("node").bitwiseXOR(F.lit(f).cast("long")) for f in flips)))
    near = nodes.select(F.col("node").alias("na"), F.col("blocks").alias("ka"), flipped.alias("node")).where("na <= node")
    pairs = written(near.join(nodes, "node").select("na", "ka", F.col("node").alias("nb"), F.col("blocks").alias("kb")))
    # Pairs of small nodes share tasks; a pair of blocks has its own.
    tasks = max(1, n * (len(flips) + 1) // TASK_ROWS)
    mine = lambda k: F.pmod(F.xxhash64("fp"), k).cast("int")
    others = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    leaves = fps.withColumn("node", _node(level))
    left = leaves.join(pairs, leaves["node"] == pairs["na"]).select("na", "nb", "ka", "kb", mine(F.col("ka")).alias("i"), others(F.col("kb")).alias("j"), "fp")
    right = leaves.join(pairs.where("na < nb or ka > 1"), leaves["node"] == F.col("nb")).select("na", "nb", "ka", "kb", others(F.col("ka")).alias("i"), mine(F.col("kb")).alias("j"), "fp")
    sides = left.union(right).where("na < nb or i <= j")
    whole = (F.col("ka") == 1) & (F.col("kb") == 1)
    task = F.when(whole, F.pmod(F.xxhash64("na", "nb"), F.lit(tasks))).otherwise(F.xxhash64("na", "nb", "i", "j")).alias("task")
    alone = F.when(whole, 0).otherwise(1).alias("alone")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        v = np.unique(part["fp"].to_numpy().view(np.uint64))
        a, b = np.unique(part[["na", "nb"]].to_numpy(), axis=0).view(np.uint64).T
        i, j = walk(v, a, b, level, half, most)
        if all_links:
            return pd.DataFrame({"a": v[i].view(np.int64), "b": v[j].view(np.int64)})
        root = spanning(len(v), i, j)
        moved = np.flatnonzero(root != np.arange(len(v)))
        return pd.DataFrame({"a": v[root[moved]].view(np.int64), "b": v[moved].view(np.int64)})

    return sides.select(task, alone, "na", "nb", "fp").groupBy("task", "alone").applyInPandas(compare, "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, all_links: bool = True) -> DataFrame:
    """``(a, b)``: pairs of the distinct values of ``fp`` at ``distance`` or fewer differing bits, each once.

    Without ``all_links`` each task gives enough of its links to connect what all of them
    connect, so that a dense group of m fingerprints costs about m rows and not m squared.
    """
    ship(fps.sparkSession)
    distinct = written(fps.select("fp").distinct())
    n = distinct.count()
    swapped = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    half = distance // 2
    found = _join(distinct, n, half, distance, all_links)
    if distance - half - 1 >= 0:
        turned = written(distinct.select(swapped.alias("fp")))
        back = lambda c: F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32)).alias(c)
        found = found.union(_join(turned, n, distance - half - 1, distance, all_links).select(back("a"), back("b")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(rows: DataFrame, distance: int) -> DataFrame:
    """``rows`` (``row_id, fp`` and more) with ``root``, which names the group, and ``component_id``, the group's smallest id."""
    firsts = rows.groupBy("fp").agg(F.min("row_id").alias("first"))
    joined = written(firsts.join(components(links(rows, distance, False)), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root")))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(joined.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: ``id_col, fp, component_id``, the smallest id reachable by links.

    Fingerprints link at ``distance`` or fewer differing bits; equal ones always do. Copies
    meet in one fingerprint before anything is joined, whatever their number. A null text
    is an empty one and has fingerprint 0, which links like any other. Rows that repeat an
    id count each with its own text; null ids are passed over for ``component_id``, which is
    null where a group has no other. Other columns are not read. An empty table gives an
    empty result.
    """
    rows = written(fingerprints(docs, id_col, text_col, words))
    return _grouped(rows, distance).select(F.col("row_id").alias(id_col), "fp", "component_id")


def tag(text: Column) -> Column:
    """Tells the texts of rows that repeat an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``(row_id, tag, keep)``, one row per row of ``docs``: of each group the row of the smallest id stays.

    Null ids come after all others; of rows that repeat an id the one with the smallest
    :func:`tag` stays. Rows that repeat both are alike here, and all or none say ``keep``.
    """
    rows = written(fingerprints(docs, id_col, text_col, words, {"tag": tag(F.col(text_col))}))
    groups = written(_grouped(rows, distance).select("row_id", "tag", "root"))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("row_id").isNull(), "row_id", "tag")).alias("first"))
    keep = F.col("row_id").eqNullSafe(F.col("first.row_id")) & (F.col("tag") == F.col("first.tag"))
    return groups.join(first, "root").select("row_id", "tag", keep.alias("keep"))
