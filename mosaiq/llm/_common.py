"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.runtime import scratch

#: A word of the data contracts: anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids that a filter which travels to every executor is made from at most, and its bits for each id (64 bits a broadcast row).
MAX_FILTER_IDS, BITS_PER_ID = 1 << 22, 16


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut.

    The table outlives lost executors, which a local checkpoint would not.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where ``df`` has such a column in whatever case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


def hash60(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts joined by ``|``, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Number of words, that is of maximal runs of anything but white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def one_of_each(docs: DataFrame, judged: DataFrame, id_col: str, tag: Column) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, without a shuffle of the others' texts.

    ``judged`` has ``row_id, tag, keep``, one row per row of ``docs``; ``tag`` is the same tag
    as an expression on ``docs``, which tells rows that repeat an id apart. Of rows that
    repeat both, one stays, the first by a hash of all its columns; null ids are ids.

    Few ids need care: those of which a row goes, and those that repeat. A bit filter made
    from them is looked up on the map side. Rows that it does not meet stay as they are, and
    only the rest is joined with the decisions. With more than ``MAX_FILTER_IDS`` such ids
    there is no filter and all rows are joined. Rows that repeat id and tag are aggregated
    before they are shuffled, so however many there are, a task sends one. Columns of
    ``docs`` may have any names.
    """
    by_row = judged.groupBy("row_id", "tag").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n"))
    by_id = by_row.groupBy("row_id").agg((F.min("keep") & (F.sum("n") == 1)).alias("plain"))
    ids = by_id.where(~F.col("plain")).select(F.col("row_id").alias("care_id"))
    id_, of, keep, n, word, bits_, own = unused(docs, "__id", "__of", "__keep", "__n", "__word", "__bits", "__tag")
    care = written(by_row.join(ids, F.col("row_id").eqNullSafe(F.col("care_id"))).select(F.col("row_id").alias(id_), F.col("tag").alias(of), F.col("keep").alias(keep), F.col("n").alias(n)))
    many = care.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(keep) & (F.col(n) > 1)).alias("repeats")).first()
    if not many["rows"]:
        return docs
    rest, plain = docs, None
    if many["rows"] <= MAX_FILTER_IDS:
        bits = many["rows"] * BITS_PER_ID
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
        places = care.select(slot(id_).alias("slot")).select(F.floor(F.col("slot") / 64).alias(word), F.pmod("slot", F.lit(64)).cast("int").alias("at"))
        words = places.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias(bits_))
        met = docs.join(F.broadcast(words), F.floor(slot(id_col) / 64) == F.col(word), "left")
        hit = F.coalesce(F.getbit(bits_, F.pmod(slot(id_col), F.lit(64)).cast("int")) == 1, F.lit(False))
        plain, rest = met.where(~hit).select(columns(docs)), met.where(hit).select(columns(docs))
    rest = rest.withColumn(own, tag)
    rest = rest.join(care, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(of)), "left")
    single = rest.where(F.col(keep).isNull() | (F.col(keep) & (F.col(n) == 1))).select(columns(docs))
    kept = single if plain is None else plain.union(single)
    if many["repeats"]:
        order = F.xxhash64(*(c for c, f in zip(columns(docs), docs.schema.fields) if f.dataType.typeName() != "map"))
        again = rest.where(F.col(keep) & (F.col(n) > 1)).groupBy(id_, of).agg(F.min_by(F.struct(columns(docs)), order).alias("row"))
        kept = kept.union(again.select("row.*"))
    return kept
