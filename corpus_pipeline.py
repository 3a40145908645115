"""A training corpus from raw documents: identify, deduplicate twice, mix, pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it
kept. Stages are separate jobs: each result is a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import exact_dedup, langid, mixing, packing, queries, simhash
from mosaiq.llm._common import columns, one_of_each, table, unused, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is null or without letters, for which no language can be told, go; those for which none was learned stay.

    Rows are judged one by one, whatever their ids; a null id is in the held-out fold.
    """
    model = langid.fit(docs.where(~queries.held_out()))
    (found,) = unused(docs, "__lang")
    return langid.judged(docs, model, out=found).where(F.col(f"{found}.letters")).select(columns(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that of the smallest id, a null id counting as the smallest.

    A null text is an empty one. Rows that repeat an id are judged each by its own text.
    """
    groups = exact_dedup.exact_groups(docs).select(F.col("doc_id").alias("row_id"), F.col("text_sha256").alias("tag"), F.col("kept").alias("keep"))
    return one_of_each(docs, groups, "doc_id", F.sha2(exact_dedup.normalise(F.col("text")), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that fingerprints link one row stays, that of the smallest id, null ids coming last.

    Fingerprints and links are those of the contract of op5: shingles of three words, two bits.
    A null text is an empty one. Rows that repeat an id are judged each by its own text.
    """
    return one_of_each(docs, simhash.judged(docs), "doc_id", simhash.tag(F.col("text")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' weights ask for, shuffled within output shards.

    Sources are as in op6, null a source of its own; rows that repeat an id are drawn together.
    """
    # Names that the mix gives columns of its own are put aside meanwhile.
    plain = docs.toDF(*(f"{c}__" if c.lower() in ("shard", "turn") else c for c in docs.columns))
    return mixing.mix(plain).select(columns(plain)).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in training sequences; a null text has the end token alone, rows that repeat an id are packed each."""
    return packing.pack_documents(docs, queries.vocabulary())


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("packing", pack)]

#: Fingerprints and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
