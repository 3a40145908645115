"""Product codes of embedding vectors: integer codebooks by Lloyd rounds with Exponion search.

Components become integers, so all distances, sums and means are exact and ties go to the
lower index: results do not depend on how rows are dealt out. A vector's parts are coded one
by one, each with the codebook of its place.

A search starts at the entry that the part had in the round before. An entry nearer than that
one lies within twice its distance of it (triangle inequality), so only so much of the start
entry's list of other entries, sorted by distance, is scanned. As that bound is exact in
integers, nothing is missed.

Each round is a scan of the vectors in which every task sums up its parts by entry and sends
one row an entry and component: vectors are neither shuffled nor stored. A task finds the
entries of the rounds before anew instead of reading them from a stored table; each is the
start of the next search, which makes all but the first cheap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm._common import written
from mosaiq.runtime import ship

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Squared distances of whole vectors, and four times these, stay below this power of two.
MOST_BITS = 60
#: Vectors a worker searches at a time.
BATCH = 4096
#: Labels up to which sums by label are looked up on the map side, and shares in which they are dealt out beyond.
MAX_LABELS, SALTS = 100_000, 32
_LARGEST = 2**63 - 1


@dataclass
class Codebooks:
    """``entries[part, entry, position]`` of each round, the first being what the search began with."""

    width: int
    entries: list[np.ndarray]
    limit: int = field(init=False)

    def __post_init__(self) -> None:
        bits = (MOST_BITS - (self.width * self.entries[0].shape[0] - 1).bit_length()) // 2 - 1 if self.width else 20
        self.limit = 1 << bits

    @property
    def last(self) -> np.ndarray:
        return self.entries[-1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.last.ravel().tolist())).encode()).hexdigest()

    def parts_of(self, vectors: list[np.ndarray]) -> np.ndarray:
        """Integers of the vectors by part; shorter ones are filled with zeros."""
        n_parts = self.last.shape[0]
        out = np.zeros((len(vectors), n_parts * self.width))
        for row, v in zip(out, vectors):
            row[: len(v)] = v
        with np.errstate(over="ignore"):
            scaled = np.floor(out * SCALE)
        return np.clip(scaled, -self.limit, self.limit).astype(np.int64).reshape(len(vectors), n_parts, self.width)

    def search(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(entries, squared distances)`` of the last round's books, by vector and part."""
        at = np.zeros(parts.shape[:2], dtype=np.int64)
        for books in self._searches():
            at, far = books.nearest(parts, at)
        return at, far

    def _searches(self) -> list[Exponion]:
        if not hasattr(self, "_made"):
            self._made = [Exponion(e) for e in self.entries]
        return self._made

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        return np.concatenate([book[i] for book, i in zip(self.last, bytes.fromhex(code))]) / SCALE


class Exponion:
    """Nearest entries of each part's codebook, given an entry to start at."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        between = ((entries[:, :, None] - entries[:, None, :]) ** 2).sum(-1)
        self.order = np.argsort(between, axis=-1, kind="stable")
        self.between = np.take_along_axis(between, self.order, -1)

    def nearest(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(entries, squared distances)``, shaped like ``start``; of equally near entries the lowest."""
        n, n_parts, width = parts.shape
        x, part, at = parts.reshape(n * n_parts, width), np.tile(np.arange(n_parts), n), start.ravel()
        far = ((x - self.entries[part, at]) ** 2).sum(1)
        found, best = at.copy(), far.copy()
        # An entry can be as near as the start only if its distance from it is at most twice the start's.
        reach, rows = 4 * far, np.arange(n * n_parts)
        for i in range(self.entries.shape[1]):
            rows = rows[self.between[part[rows], at[rows], i] <= reach[rows]]
            if not len(rows):
                break
            other = self.order[part[rows], at[rows], i]
            d = ((x[rows] - self.entries[part[rows], other]) ** 2).sum(1)
            better = (d < best[rows]) | ((d == best[rows]) & (other < found[rows]))
            found[rows[better]], best[rows[better]] = other[better], d[better]
        return found.reshape(n, n_parts), best.reshape(n, n_parts)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _usable(vectors: DataFrame, vector_col: str) -> Column:
    return finite(F.col(vector_col).cast("array<double>"))


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], list[int]]:
    """By part and entry: how many parts are nearest to it, and the sums of their components. A row a number and task is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # a bounded number of entries
    n_parts, k, width = books.last.shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_parts * k, width + 1), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                parts = shared.value.parts_of(batch["v"].iloc[at : at + BATCH].tolist())
                cell = (shared.value.search(parts)[0] + np.arange(n_parts) * k).ravel()
                total[:, 0] += np.bincount(cell, minlength=n_parts * k)
                np.add.at(total, (cell[:, None], np.arange(1, width + 1)), parts.reshape(len(cell), width))
        cells = np.flatnonzero(total[:, 0])
        at = np.repeat(cells, width + 1)
        yield pd.DataFrame({"cell": at, "i": np.tile(np.arange(width + 1), len(cells)), "n": total[cells].ravel()})

    sums = rows.mapInPandas(add, "cell long, i int, n long").groupBy("cell", "i").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
    found: dict[tuple[int, int], list[int]] = {}
    for r in sums.collect():  # entries times components
        found.setdefault(divmod(r["cell"], k), [0] * (width + 1))[r["i"]] = int(r["n"])
    return found


def fit(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", n_parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> Codebooks | None:
    """Codebooks of all usable vectors; None if there is none.

    They begin with the parts of the ``entries`` vectors of the smallest ids, null ids last,
    repeated ids by vector. Then each round moves each entry to the mean of the parts that
    are nearest to it, rounded down; an entry with none stays.
    """
    if not (0 < entries <= 256 and n_parts > 0):
        raise ValueError("a code has two hex digits a part, so there are 1 to 256 entries")
    ship(vectors.sparkSession)
    rows = vectors.where(_usable(vectors, vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = Codebooks(-(-longest // n_parts), [np.zeros((n_parts, 1, -(-longest // n_parts)), dtype=np.int64)])
    books = Codebooks(books.width, [books.parts_of([np.array(r["v"], dtype=float) for r in first]).transpose(1, 0, 2)])
    for _ in range(rounds):
        new = books.last.copy()
        for (part, entry), (n, *sums) in _sums(rows.select("v"), books).items():
            new[part, entry] = [s // n for s in sums]
        books = Codebooks(books.width, [*books.entries, new])
    return books


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", out: str = "code") -> DataFrame:
    """Usable rows of ``vectors`` with ``out``: struct of ``code``, two hex digits a part, and ``error``, the summed squared distances."""
    ship(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("code string, error long")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [shared.value.search(shared.value.parts_of(batch.iloc[at : at + BATCH].tolist())) for at in range(0, len(batch), BATCH)]
            codes = [bytes(row).hex() for at, _ in parts for row in at.astype(np.uint8)]
            yield pd.DataFrame({"code": codes, "error": [e for _, far in parts for e in far.sum(1).tolist()]})

    return vectors.where(_usable(vectors, vector_col)).withColumn(out, code(F.col(vector_col).cast("array<double>")))


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over equal labels, nulls together; stored before, as it is read twice.

    Sums are looked up on the map side for up to ``MAX_LABELS`` labels. With more, they are
    joined in ``SALTS`` shares of each label, so that one with very many rows is no task of
    its own.
    """
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("sum")))
    sums = sums.select("of", F.least("sum", F.lit(_LARGEST)).cast("long").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= MAX_LABELS:
        return coded.join(F.broadcast(sums), same).drop("of")
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("share", F.pmod(F.xxhash64("row_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(sums, same & (F.col("share") == F.col("salt"))).drop("of", "salt", "share")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **sizes: int) -> DataFrame:
    """One row per usable row: ``id_col, code, error, label_error, codebooks_sha256``.

    Vectors that are null or hold null or non-finite components are left out, rows that
    repeat an id are coded each, labels are of any type. Components become
    ``floor(256 * x)``. Vectors of different lengths are coded together: all count as
    filled up with zeros to the longest one's length and that to a multiple of the parts;
    empty vectors alone have codes of zeros. Integers are held within a power of two that
    keeps distances of whole vectors below 2^60 (2^26 for 64 components, that is components
    within 262,144), sums of errors within that of a long. An empty table gives an empty
    result. Other columns are not read.
    """
    books = fit(vectors, id_col, vector_col, **sizes)
    if books is None:
        kind = vectors.schema[id_col].dataType
        return vectors.where("false").select(F.col(id_col).cast(kind), *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    coded = encode(vectors.select(F.col(id_col).alias("row_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")), books, "v", "c")
    summed = label_errors(written(coded.select("row_id", "label", "c.code", "c.error")))
    return summed.select(F.col("row_id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
