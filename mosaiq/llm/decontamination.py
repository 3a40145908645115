"""Benchmark passages in documents: windows of normalised words looked up in a broadcast set.

The windows of a test set, runs of a number of words, are hashed by their words' numbers;
the sorted hashes travel to every executor. Documents are scanned where they lie: words that
no test item has end a run, runs of known words are hashed window by window and looked up,
and every hit is verified word by word against the test item. Documents are not shuffled,
so passages that very many documents share cost no task more than its share.

The test set travels in slices of a bounded size: a set larger than one slice takes a scan
of the documents for each, and the slices' hits are merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm._common import written
from mosaiq.llm._terms import LOWERED, RAW_TERM, TERM
from mosaiq.runtime import ship

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of an item that stay together: longer items are cut, pieces overlapping by a window less a word.
PIECE = 50_000
#: UTF-8 bytes of a slice of the test set, on average where it takes more than one.
SLICE_BYTES = 16_000_000
#: Bytes of documents whose words a worker holds at a time; a longer document stands alone.
CHUNK_BYTES = 4_000_000
_BETWEEN, _UNKNOWN, _END = b" \0 ", -1, -2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash modulo 2^64 of the windows that begin at ``starts``."""
    found = np.zeros(len(starts), dtype=np.uint64)
    for i in range(length):
        found = found * _FACTOR + ids[starts + i].astype(np.uint64) + np.uint64(1)
    return found


def _expand(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ranges, one after the other, and which range each belongs to."""
    of = np.repeat(np.arange(len(first)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


class Windows:
    """Different windows of one length: sorted hashes, where each stands, and the items that have it."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int) -> None:
        self.ids, self.length = ids, length
        hashes = _hashes(ids, starts, length)
        order = np.lexsort((items, hashes))
        hashes, starts, items = hashes[order], starts[order], items[order]
        same = np.zeros(len(order), dtype=bool)
        if len(order):
            same[1:] = (hashes[1:] == hashes[:-1]) & self._equal(ids, starts[1:], ids, starts[:-1])
        group = np.cumsum(~same) - 1
        heads = np.flatnonzero(~same)
        self.hashes, self.starts = hashes[heads], starts[heads]
        keep = ~same
        keep[1:] |= items[1:] != items[:-1]  # an item counts once for a window
        self.items = items[keep]
        self.first = np.searchsorted(group[keep], np.arange(len(heads) + 1))

    def _equal(self, a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
        found = np.ones(len(at), dtype=bool)
        for i in range(self.length):
            found &= a[at + i] == b[bt + i]
        return found

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(starts, groups)``: verified hits among the words of documents."""
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        starts = np.flatnonzero(known[self.length :] - known[: -self.length] == self.length) if len(ids) >= self.length else np.zeros(0, dtype=np.int64)
        if not len(starts):
            return starts, starts
        hashes = _hashes(ids, starts, self.length)
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        at, of = _expand(low, high - low)  # one candidate, more only where hashes collide
        true = self._equal(ids, starts[of], self.ids, self.starts[at])
        return starts[of][true], at[true]


class TestSet:
    """The windows of a slice of items, given as ``(item, words of its windows, words)``."""

    __test__ = False

    def __init__(self, pieces: Sequence[tuple[str, int, list[str]]]) -> None:
        self.names = sorted({name for name, _, _ in pieces})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {b"\0": _END}
        ids: list[int] = []
        begun: dict[int, list[tuple[int, int, int]]] = {}
        for name, length, words in pieces:
            begun.setdefault(length, []).append((len(ids), len(words) - length + 1, number[name]))
            ids += [self.vocabulary.setdefault(w.encode(), len(self.vocabulary)) for w in words]
        all_ids = np.array(ids, dtype=np.int32)
        self.windows = []
        for length, runs in sorted(begun.items()):
            first, size, item = (np.array(x, dtype=np.int64) for x in zip(*runs))
            starts, of = _expand(first, size)
            self.windows.append(Windows(all_ids, starts, item[of], length))

    def scan(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[list[str]]]:
        """By text: its words, words hit, runs of hit words as ``start, end, ...``, and the items found, sorted."""
        words = (_BETWEEN.join(t.translate(LOWERED) for t in texts) + _BETWEEN).split()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, _UNKNOWN) for w in words), np.int32, len(words))
        ends = np.flatnonzero(ids == _END)
        begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        pairs = [np.zeros(0, dtype=np.int64)]
        for one in self.windows:
            starts, groups = one.find(ids)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + one.length, -1)
            doc = np.searchsorted(ends, starts)
            met = np.unique(doc * len(one.starts) + groups)  # a window counts once for a document
            doc, groups = np.divmod(met, len(one.starts))
            at, of = _expand(one.first[groups], one.first[groups + 1] - one.first[groups])
            pairs.append(np.unique(doc[of] * len(self.names) + one.items[at]))
        hit = np.cumsum(edge)[:-1] > 0
        n_hit = np.add.reduceat(hit, begins, dtype=np.int64)
        turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))  # no run reaches beyond a text
        runs, items = [turns[:0]] * len(texts), [[] for _ in texts]
        where = np.searchsorted(ends, turns[::2])
        for part in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where)) + 1):
            if len(part):
                runs[where[part[0]]] = turns[2 * part[0] : 2 * part[-1] + 2] - begins[where[part[0]]]
        for i, item in zip(*np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.names)))):
            items[i].append(self.names[item])
        return ends - begins, n_hit, runs, items


def _pieces(benchmark: DataFrame, text_col: str, id_col: str, window: int) -> DataFrame:
    """``(item, length, words)``: items cut so that each window stands in one piece; those without words have none."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)).alias("all"))
    words = words.where(F.size("all") > 0).withColumn("length", F.least(F.size("all"), F.lit(window)))
    cuts = F.sequence(F.lit(0), F.size("all") - F.col("length"), F.lit(PIECE))
    return words.select("item", "length", F.explode(F.transform(cuts, lambda i: F.slice("all", i + 1, F.col("length") + PIECE - 1))).alias("words"))


def _slices(benchmark: DataFrame, text_col: str, id_col: str, window: int) -> Iterator[TestSet]:
    pieces = _pieces(benchmark, text_col, id_col, window)
    if (size := pieces.agg(F.sum(F.octet_length(F.array_join("words", " ")))).first()[0]) is None:
        return
    n = -(-size // SLICE_BYTES)
    if n > 1:
        pieces = written(pieces)
    for i in range(n):
        part = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == i) if n > 1 else pieces
        yield TestSet([(r["item"], r["length"], r["words"]) for r in part.collect()])


_HITS = "n_words long, n_hit long, items array<string>, runs array<int>"


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, out: str = "hits", item_text: str = "text") -> DataFrame:
    """``docs`` with ``out``: struct of ``n_words``, ``n_hit``, ``items`` and ``runs``.

    A word inside any occurrence of any item's window is hit. ``items`` are the ids, as
    sorted texts, of items of which a window occurs, each once; ``runs`` are the places of
    hit words as ``start, end, start, ...``, ends exclusive, joined where they touch. A null
    text has no words; a null item id counts as the empty text, and rows that repeat an item
    id as one item; items without words are never found. With an empty test set nothing is
    hit. A column named ``out`` is replaced, one named ``__slice`` taken; rows are independent of each other, so repeated
    rows and ids need no care.
    """
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c != out]
    docs, one, seen = docs.select(columns), "__slice", False
    for test_set in _slices(benchmark, item_text, item_col, window):
        docs = written(docs) if seen else docs  # else each worker would hold all slices
        hits = _scan_slice(docs.sparkSession.sparkContext.broadcast(test_set))(_data(text_col))
        docs = docs.withColumn(one, hits).withColumn(out, _merged(F.col(out), F.col(one))).drop(one) if seen else docs.withColumn(out, hits)
        seen = True
    if not seen:
        docs = docs.withColumn(out, _scan_slice(docs.sparkSession.sparkContext.broadcast(TestSet([])))(_data(text_col)))
    return docs


def _data(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def _scan_slice(test_set):
    @F.pandas_udf(_HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, texts = [], batch.tolist()
            sizes = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0)
            for chunk in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // CHUNK_BYTES)) + 1):
                if len(chunk):
                    n_words, n_hit, runs, items = test_set.value.scan([texts[i] for i in chunk])
                    parts.append(pd.DataFrame({"n_words": n_words, "n_hit": n_hit, "items": items, "runs": runs}))
            yield pd.concat(parts) if parts else pd.DataFrame({"n_words": [], "n_hit": [], "items": [], "runs": []})

    return hits


def _merged(a: Column, b: Column) -> Column:
    """The hits of two slices: items of both, runs joined where they touch."""
    places = lambda x: F.transform(F.sequence(F.lit(0), F.size(x["runs"]) - 2, F.lit(2)), lambda i: F.struct(F.get(x["runs"], i).alias("s"), F.get(x["runs"], i + 1).alias("e")))
    some = lambda x: F.when(F.size(x["runs"]) > 0, places(x)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))

    def join(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        touching = (F.size(done) > 0) & (last["e"] >= x["s"])
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(touching, wider).otherwise(F.concat(done, F.array(x)))

    joined = F.aggregate(F.array_sort(F.concat(some(a), some(b))), F.array().cast("array<struct<s:int,e:int>>"), join)
    n_hit = F.aggregate(joined, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    items = F.array_sort(F.array_union(a["items"], b["items"]))
    runs = F.flatten(F.transform(joined, lambda x: F.array(x["s"], x["e"])))
    return F.struct(b["n_words"].alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), runs.alias("runs"))


def without_documents(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0, **names: str) -> DataFrame:
    """The rows of ``docs`` of which no word is hit, or up to ``least_share`` of the words."""
    found = scan(docs, benchmark, out="__hits", **names)
    return found.where(F.col("__hits.n_hit") <= least_share * F.col("__hits.n_words")).select(docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names: str) -> DataFrame:
    """``docs`` with hit passages cut out of the texts, from a run's first word to its last; the rest stays as it is."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, list(r)) for t, r in zip(texts, runs)], dtype=object)

    found = scan(docs, benchmark, text_col, out="__hits", **names)
    text = F.when(F.size("__hits.runs") > 0, cut(F.col(text_col), F.col("__hits.runs"))).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).select(docs.columns)


def _cut(text: str | None, runs: list[int]) -> str | None:
    if text is None or not runs:
        return text
    kept, at, first = [], 0, 0
    edges = iter(runs)
    begin, end = next(edges), next(edges)
    for i, word in enumerate(RAW_TERM.finditer(text)):
        if i == begin:
            first = word.start()
        if i == end - 1:
            kept.append(text[at:first])
            at = word.end()
            begin, end = next(edges, -1), next(edges, -1)
            if begin < 0:
                break
    return "".join(kept) + text[at:]
