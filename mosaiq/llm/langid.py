"""Language identification: known words by their log frequency, unseen ones by ever shorter character n-grams.

A word of the training texts scores, per language, the log of its smoothed frequency. An
unseen word is scored by its character n-grams of the greatest length of which any is
known, times a discount for each step of backing off. A text's scores are sums over its
words; the best language wins, and the score is its share in a softmax of means.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.llm._common import columns, unused
from mosaiq.runtime import ship

#: Labelled documents the model is fitted on, and entries it keeps per language and kind. The tables have a row an entry of that
#: sample and a column a language of it, however many rows there are besides.
TRAIN_DOCS, MAX_WORDS, MAX_GRAMS = 20_000, 20_000, 5_000
#: Lengths of the character n-grams, longest first; words carry a mark at either end.
GRAMS = (5, 4, 3, 2, 1)
#: A word must have been seen so often to be known.
LEAST_COUNT = 3
#: Weight of a step of backing off.
BACKOFF = 0.5
#: Scores of unseen words that a worker holds at most, and words scored at a time.
CACHE, _PART = 400_000, 8_192
UNDECIDED = "und"
#: Values of the hash that picks the training sample.
HASHES = 1 << 60

_LETTERS = re.compile(r"[^\W\d_]+")
#: What ``\w`` takes for part of a word though it is neither a letter nor a decimal digit: fractions, superscripts, Roman numerals.
_NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case."""
    if not text.isascii():
        for c in _NUMERALS.intersection(text):
            text = text.replace(c, " ")
    return _LETTERS.findall(text.lower())


def has_letters(text: str | None) -> bool:
    m = _LETTERS.search(text or "")
    return m is not None and (m[0].isalpha() or bool(words_of(text)))


class Model:
    """Log-frequency rows by language for words and for n-grams of each length: what they are, and one table for each kind."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[int, dict[str, np.ndarray]]) -> None:
        self.langs, self.met = langs, None
        stack = lambda rows: np.array(list(rows), dtype=float).reshape(len(rows), len(langs))
        self.words, self.table = list(words), stack(words.values())
        self.grams = {n: (list(known), stack(known.values())) for n, known in grams.items()}

    def word(self, w: str) -> np.ndarray:
        """Scores of one word by language, with mean zero."""
        met = _Met(self)
        at = met[w]
        met.settle()
        return met.table[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.langs:
            return UNDECIDED, 0.0
        total = np.zeros(len(self.langs))
        for at in range(0, len(words), _PART):
            if self.met is None or self.met.free() < _PART:
                self.met = _Met(self)
            rows = list(map(self.met.__getitem__, words[at : at + _PART]))
            self.met.settle()
            total += self.met.table.take(rows, axis=0).sum(axis=0)
        mean = total / len(words)
        share = np.exp((mean - mean.max()) * min(len(words), 20))
        best = int(np.argmax(mean))
        return self.langs[best], float(share[best] / share.sum())


class _Met(dict):
    """Word -> its row in ``table``: known words, then others as a worker meets them, as far as there is room.

    A new word only notes which n-grams it is scored by; ``settle`` scores all new ones.
    """

    def __init__(self, model: Model) -> None:
        super().__init__(zip(model.words, range(len(model.words))))
        self.n = len(model.words)
        self.table = np.zeros((self.n + max(_PART, CACHE // max(1, len(model.langs))), len(model.langs)))
        self.table[: self.n] = model.table
        self.places, tables, at = [], [self.table[:0]], 0
        for k, n in enumerate(GRAMS):
            known, rows = model.grams.get(n, ([], self.table[:0]))
            self.places.append((n, BACKOFF**k, dict(zip(known, range(at, at + len(known))))))
            tables.append(rows)
            at += len(known)
        self.grams = np.concatenate(tables)
        self.new: list[tuple[int, int, float]] = []  # row, number of n-grams, weight
        self.new_grams: list[int] = []

    def free(self) -> int:
        return len(self.table) - self.n

    def __missing__(self, w: str) -> int:
        at = self.n
        self.n += 1
        if len(w) <= 40:
            self[w] = at
        marked = f"<{w}>"
        for n, weight, known in self.places:
            found = [known[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in known]
            if found:
                self.new.append((at, len(found), weight / len(found)))
                self.new_grams += found
                break
        return at

    def settle(self) -> None:
        if self.new:
            at, sizes, weights = zip(*self.new)
            starts = np.cumsum((0, *sizes[:-1]))
            self.table[list(at)] = np.add.reduceat(self.grams[self.new_grams], starts, axis=0) * np.array(weights)[:, None]
            self.new.clear()
            self.new_grams.clear()


def _rows(counts: pd.DataFrame, langs: list[str], totals: dict[str, float]) -> dict[str, np.ndarray]:
    """Centred log frequencies by item, half a count added to each."""
    at = {x: i for i, x in enumerate(langs)}
    table: dict[str, np.ndarray] = {}
    for item, lang, n in zip(counts["item"], counts["lang"], counts["n"]):
        table.setdefault(item, np.full(len(langs), 0.5))[at[lang]] += n
    size = np.array([totals[x] + 1.0 for x in langs])
    for item, row in table.items():
        logs = np.log(row / size)
        table[item] = logs - logs.mean()
    return table


def _grams(marked: Column, n: int) -> Column:
    """The ``(kind, item)`` of each run of ``n`` characters."""
    last = F.length(marked) - n + 1
    found = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.lit(n).alias("kind"), F.substring(marked, i, F.lit(n)).alias("item")))
    return F.when(last >= 1, found).otherwise(F.array().cast("array<struct<kind:int,item:string>>"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on about ``train_docs`` rows of ``labelled`` that a hash of id and text picks, or all if they are fewer.

    Rows without a language are left out; those without letters teach nothing. Null or
    repeated ids are ids like any other. Where nothing is learned, an empty table included,
    the model knows no language. Other columns are not read.

    Counting is done by Spark, each language's most frequent entries are kept, and only they
    come to the driver: ``MAX_WORDS`` and ``MAX_GRAMS`` a language and kind, whatever the number of languages.
    """
    ship(labelled.sparkSession)
    known = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(order_col).alias("id"))
    share = train_docs / max(1, known.count())
    sample = known if share >= 1 else known.where(F.pmod(F.xxhash64("id", "text"), F.lit(HASHES)) < int(share * HASHES))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                words: Counter = Counter()
                for text in part["text"]:
                    words.update(words_of(text or ""))
                if words:
                    yield pd.DataFrame({"lang": lang, "item": list(words), "n": list(words.values())})

    words = sample.select("text", "lang").mapInPandas(count, "lang string, item string, n long")
    words = words.groupBy("lang", "item").agg(F.sum("n").alias("n"))
    # N-grams come from each word once, weighted by how often it was seen.
    marked = words.withColumn("marked", F.concat(F.lit("<"), "item", F.lit(">")))
    grams = [_grams(F.col("marked"), n) for n in GRAMS]
    items = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("item"))), *grams)
    counts = marked.select("lang", "n", F.explode(items).alias("x")).select("lang", "n", "x.kind", "x.item")
    summed = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).where((F.col("kind") > 0) | (F.col("n") >= LEAST_COUNT))
    best = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    most = F.when(F.col("kind") == 0, MAX_WORDS).otherwise(MAX_GRAMS)
    kept = summed.withColumn("r", best).where(F.col("r") <= most).drop("r").toPandas()
    langs = sorted(kept["lang"].unique(), key=str)
    tables = {}
    for kind, part in kept.groupby("kind"):
        totals = part.groupby("lang")["n"].sum().to_dict()
        tables[int(kind)] = _rows(part, langs, {x: float(totals.get(x, 0)) for x in langs})
    return Model(langs, tables.pop(0, {}), tables)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1): a projection over whole texts.

    ``und`` and 0 where the text is null, empty or without letters, or nothing was learned.
    Columns of these names are replaced; ties go to the first language by code point.
    """
    (found,) = unused(docs, "__lang")
    rest = [c for c, name in zip(columns(docs), docs.columns) if name.lower() not in ("lang_pred", "score")]
    return judged(docs, model, text_col, found).select(*rest, f"{found}.lang_pred", f"{found}.score")


def judged(docs: DataFrame, model: Model, text_col: str = "text", out: str = "__lang") -> DataFrame:
    """``docs`` with ``out``: what ``predict`` gives, and ``letters``, whether the text has any, whatever was learned."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's parameters

    @F.pandas_udf("lang_pred string, score double, letters boolean")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([(*m.predict(t), has_letters(t)) for t in texts], columns=["lang_pred", "score", "letters"])

    return docs.withColumn(out, label(F.col(text_col)))
