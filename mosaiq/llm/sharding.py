"""Sharding by a permutation-filled lookup table (consistent hashing with a prime-sized table).

Every shard has its own permutation of the slots, ``(offset + j * skip) mod size``;
``size`` is a prime, so any skip visits every slot. Shards take turns, each claiming
the first slot of its permutation that nobody has yet, until the table is full. Slots
are spread evenly (counts differ by one at most) and few of them change owner when a
shard joins or leaves. A row's slot is a hash of its key modulo the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm._common import hash60

#: Slots at most: bounds the table that travels with each task (about 4 MB).
MAX_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash60(s: str) -> int:
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int) -> list[int]:
    """Slot -> index of the owning shard. Depends on the shards' names only, and on their order for turns.

    >>> sorted(lookup_table(["a", "b"], 5)).count(0)
    3
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if not is_prime(size) or not len(shards) <= size <= MAX_SLOTS:
        raise ValueError(f"size must be a prime between the number of shards and {MAX_SLOTS}")
    at = [_hash60(f"offset|{s}") % size for s in shards]
    skip = [_hash60(f"skip|{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % size
        owner[at[i]] = i
    return owner


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def place(df: DataFrame, key: str | Column, shards: Sequence[str], size: int = 65537) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (a name), placed by ``key``.

    A projection: no shuffle, so a hot key costs nothing here. The table is a constant of
    at most ``MAX_SLOTS`` small integers that goes out with the tasks; a placement is one
    hash and one array access. Equal keys share a shard. A null key counts as the empty
    string. Input columns named ``slot`` or ``shard`` are replaced. An empty table gives
    an empty result.
    """
    key = F.col(key) if isinstance(key, str) else key
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    names = F.split(F.lit("\n".join(shards)), "\n")
    slot = hash60(F.coalesce(key.cast("string"), F.lit(""))) % size
    return df.withColumn("slot", slot).withColumn(
        "shard", F.element_at(names, F.element_at(owners, F.col("slot").cast("int") + 1) + 1)
    )


def shard_counts(placed: DataFrame) -> DataFrame:
    """Rows by shard: partial counts on the map side, then one row a shard and task."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))
