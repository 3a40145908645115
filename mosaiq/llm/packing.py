"""Best-fit packing of documents into sequences, after a Martello-Toth dominance reduction.

Which documents share a sequence depends on their lengths only, and a length is one of at
most ``capacity`` numbers. So the packing is planned over the lengths' counts: the plan
and what it is made from have a bounded size, whatever the corpus. Spark tokenises the
documents, counts and ranks their pieces, and looks each piece's rank up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.llm._common import written
from mosaiq.runtime import ship

CAPACITY = 4096
#: Pieces of one length are ranked in parts of about so many, at least ``PARTS`` of them.
PART_ROWS, PARTS = 1_000_000, 128

_PIECES = "row_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """``(row_id, piece, start, length, ids_crc32)``: each document's ids and ``end_id``, cut every ``capacity`` ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from mosaiq.llm.tokens import word_ids

        words, wide = word_ids(vocabulary), 4 * capacity
        for batch in batches:
            rows = []
            for row, text in zip(batch["row_id"], batch["text"]):
                ids = words.text_ids(text) + end_id.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    rows.append((row, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["row_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(F.col(id_col).alias("row_id"), text).mapInPandas(cut, _PIECES.format(id=kind))


class Plan:
    """Where the pieces of each length go: runs of ranks that fill one place of consecutive sequences."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, {n: c for n, c in counts.items() if c > 0}
        self.sizes = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)  # ranks given out, by length
        self.runs: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        self.sequences = 0
        self._reduce()
        self._best_fit()

    def _take(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], sequence, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.sizes.pop(bisect_left(self.sizes, length))

    def _fix(self, n: int, *lengths: int) -> None:
        """``n`` new sequences that hold these pieces and are not filled further."""
        at = 0
        for length in lengths:
            self._take(length, n, self.sequences, at)
            at += length
        self.sequences += n

    def _times(self, a: int, b: int) -> int:
        return self.left[a] // 2 if a == b else min(self.left[a], self.left[b])

    def _smallest(self, k: int, but: int) -> list[int]:
        """The ``k`` smallest pieces when one of length ``but`` is set aside; fewer if there are not so many."""
        got: list[int] = []
        for n in self.sizes:
            got += [n] * min(k - len(got), self.left[n] - (n == but))
            if len(got) == k:
                break
        return got

    def _reduce(self) -> None:
        """Fix sets that dominate every other set with their largest piece, until none is left.

        With j the piece and r its room: j alone if nothing fits; {j, l} with l = r; {j, l}
        with l the longest that fits, if no two others fit, or if no three do and l is as
        long as the best two that do. Any set with j could trade its other pieces for l.
        """
        again = True
        while again:
            again = False
            for j in sorted(self.left, reverse=True):
                while j in self.left:
                    room = self.capacity - j
                    low = self._smallest(3, j)
                    if not low or low[0] > room:
                        self._fix(self.left[j], j)
                        continue
                    i = bisect_right(self.sizes, room) - 1
                    i -= self.sizes[i] == j and self.left[j] < 2
                    longest = self.sizes[i]
                    alone = len(low) < 2 or low[0] + low[1] > room
                    if longest == room or alone or ((len(low) < 3 or sum(low) > room) and self._best_pair(i + 1, room, j) <= longest):
                        self._fix(self._times(j, longest), j, longest)
                        again = True
                        continue
                    break

    def _best_pair(self, n: int, room: int, j: int) -> int:
        """The largest sum of two of the ``n`` smallest lengths that fits; 0 if none does."""
        have = lambda i: self.left[self.sizes[i]] - (self.sizes[i] == j)
        best, lo, hi = 0, 0, n - 1
        while lo <= hi:
            total = self.sizes[lo] + self.sizes[hi]
            if total > room or have(hi) < 1 or (lo == hi and have(lo) < 2):
                hi -= 1
                continue
            if have(lo) >= 1:
                best = max(best, total)
            lo += 1
        return best

    def _best_fit(self) -> None:
        """Longest first, each piece into the fullest open sequence that has room, whole runs of like sequences at a time."""
        open_at: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number)
        rooms: list[int] = []

        def leave(room: int, first: int, n: int) -> None:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append((first, n))

        for length in sorted(self.left, reverse=True):
            while length in self.left:
                i = bisect_left(rooms, length)
                if i < len(rooms):
                    room = rooms[i]
                    first, n = open_at[room].pop()
                    if not open_at[room]:
                        del open_at[room]
                        rooms.pop(i)
                    n_now = min(n, self.left[length])
                    self._take(length, n_now, first, self.capacity - room)
                    leave(room - length, first, n_now)
                    if n > n_now:
                        leave(room, first + n_now, n - n_now)
                    continue
                # No open sequence has room: full ones of this length alone, then one with the rest.
                per = self.capacity // length
                n, rest = divmod(self.left[length], per)
                first = self.sequences
                self.sequences += n + (rest > 0)
                for k in range(per):
                    if n:
                        self._take(length, n, first, k * length)
                for k in range(rest):
                    self._take(length, 1, first + n, k * length)
                if n:
                    leave(self.capacity - per * length, first, n)
                if rest:
                    leave(self.capacity - rest * length, first + n, 1)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (length and rank) at which runs start, ascending; their first sequences; their offsets."""
        runs = sorted(self.runs)
        keys = np.array([(n << 48) + rank for n, rank, _, _ in runs], dtype=np.int64)
        return keys, np.array([s for *_, s, _ in runs], dtype=np.int64), np.array([o for *_, o in runs], dtype=np.int64)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from :func:`pieces`) with ``sequence_id`` and ``offset``: every piece placed, gapless, in few sequences.

    Pieces of equal length are interchangeable; their ranks follow ids within parts that a
    hash of the id makes, so that a length which many documents share is ranked by many
    tasks. Reruns give the same result. An empty table gives an empty result; rows that
    repeat an id are packed like any other.
    """
    cut = written(cut)
    parts = max(PARTS, cut.count() // PART_ROWS)
    part = F.pmod(F.xxhash64("row_id", "piece"), F.lit(parts))
    counts = written(cut.groupBy("length", part.alias("part")).agg(F.count(F.lit(1)).alias("n")))
    # At most one row a length comes to the driver.
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    keys, firsts, offsets = plan.table()
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    starts = counts.select("length", "part", before.alias("before"))
    within = F.row_number().over(W.partitionBy("length", "part").orderBy("row_id", "piece")) - 1
    ranked = cut.withColumn("part", part).withColumn("within", within).join(starts, ["length", "part"])

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy() << 48) + rank.to_numpy()
        at = np.searchsorted(keys, key, side="right") - 1
        return pd.DataFrame({"sequence_id": firsts[at] + key - keys[at], "offset": offsets[at]})

    placed = ranked.withColumn("to", look_up(F.col("length"), (F.col("before") + F.col("within")).cast("long")))
    return placed.select(*cut.columns, "to.sequence_id", "to.offset")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is an empty one, of one id (the end). Only documents of more than
    ``capacity`` ids are cut. Other columns are not read.
    """
    return pack(pieces(docs, vocabulary, id_col, text_col, capacity), capacity).withColumnRenamed("row_id", id_col)
