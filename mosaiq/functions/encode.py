"""Text encoders: one that is fitted on the texts at hand, a stand-in for tests, and room for others that are plugged in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import text as T
from mosaiq.functions import vectors as V


#: Entries of sparse rows that are weighed at a time.
ENTRIES = 1 << 18


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """A deterministic stand-in: words hashed into signed buckets, then unit length. It knows nothing of meaning.

    Where all signs cancel, the words count without them, so only texts without words are zero.
    """

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            hashes = [int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") for word in text.split()]
            for h in hashes:
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
            if hashes and not out[i].any():
                for h in hashes:
                    out[i, h % self.dim] += 1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-10)


def weights(lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, rarity: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(starts, term, weight)`` of rows that each have a term at least, some ``most`` entries at a time, a whole row at least.

    ``lengths``, ``terms`` and ``counts`` are as :func:`mosaiq.functions.text.counted_terms`
    gives them; ``starts`` has each row's first entry. A term weighs its count times its
    rarity, and a row has unit length.
    """
    ends, at, begin = np.cumsum(lengths), 0, 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, begin + most, "right")))
        starts, term = ends[at:to] - lengths[at:to] - begin, terms[begin : ends[to - 1]]
        w = counts[begin : ends[to - 1]] * rarity[term]
        yield starts, term, w / np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), lengths[at:to])
        at, begin = to, int(ends[to - 1])


class Terms:
    """Texts as points in the leading subspace of their weighted terms; fitted by ``operators.lowrank.fit_terms``.

    ``rarity`` has a weight a bucket of terms, ``basis`` a row a bucket. Vectors have the
    length of that part of the unit weights that lies within the subspace; texts without
    words are zero.
    """

    def __init__(self, rarity: np.ndarray, basis: np.ndarray) -> None:
        self.rarity, self.basis = rarity, basis

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.place(*T.counted_terms(pa.array(texts, pa.string()), len(self.rarity)))

    def place(self, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The vectors of texts whose terms are counted, as :func:`mosaiq.functions.text.counted_terms` gives them."""
        out, some, at = np.zeros((len(lengths), self.basis.shape[1])), np.flatnonzero(lengths), 0
        for starts, term, weight in weights(lengths[some], terms, counts, self.rarity, ENTRIES):
            for i, column in enumerate(self.basis.T):
                out[some[at : at + len(starts)], i] = np.add.reduceat(weight * column[term], starts)
            at += len(starts)
        return out


def encoded(column: str | Column, make: Callable[[], Encoder], kind: str = "array<float>") -> Column:
    """Vectors of a text column, batch by batch; ``make`` is called once a task. A null text counts as empty."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for texts in batches:
            yield pd.Series(list(encoder.encode(texts.fillna("").tolist())))

    return run(F.col(column) if isinstance(column, str) else column)


def encoded_columns(df: DataFrame, columns: list[str], make: Callable[[], Encoder], out: str = "embedding") -> DataFrame:
    """Each text column encoded by itself, the vectors joined in the columns' order; their names go into the metadata.

    Vectors made from other columns must not be compared: see :func:`check_columns`.
    """
    joined = V.concat(*(encoded(c, make) for c in columns)).cast("array<float>")
    return df.withColumn(out, joined).withMetadata(out, {"columns": columns})


def check_columns(a: DataFrame, b: DataFrame, vector: str = "embedding") -> None:
    """Refuse two tables whose vectors were made from different columns, or in another order."""
    x, y = (d.schema[vector].metadata.get("columns") for d in (a, b))
    if x != y:
        raise ValueError(f"vectors of {x} and of {y} are not comparable")


def encoded_items(df: DataFrame, id_col: str, items: str, make: Callable[[], Encoder]) -> DataFrame:
    """``(id, embeddings)``: each item of a list encoded, in order; rows without items keep an empty list."""
    flat = df.select(id_col, F.posexplode_outer(items).alias("pos", "item"))
    vectors = flat.withColumn("v", F.when(F.col("item").isNotNull(), encoded("item", make)))
    listed = F.sort_array(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("pos", "v"))))
    return vectors.groupBy(id_col).agg(listed["v"].alias("embeddings"))
