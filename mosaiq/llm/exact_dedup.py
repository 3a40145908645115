"""Exact deduplication by content-defined chunk recipes.

A text is normalised and cut into chunks where its content says so, so that equal
passages give equal chunks wherever they stand. Chunks get short identifiers, verified
in one dictionary over the corpus: an identifier that stands for chunks of different
SHA-256 digests is told apart. A document is then only its recipe, the ordered list of
its chunks' identifiers, and documents are equal exactly when their recipes are. No text
crosses the network; identifiers, digests and recipes do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm._common import written

#: Characters of odd code point among ASCII letters and digits: one bit of a character.
_ODD = "[acegikmoqsuwyACEGIKMOQSUWY13579]"
_EVEN = "[^acegikmoqsuwyACEGIKMOQSUWY13579]"
#: A cut follows eight characters whose bits are this word: one place in 256 or so.
CUT = "".join(_ODD if b == "1" else _EVEN for b in "01101001")
MIN_CHUNK, MAX_CHUNK = 512, 8192
#: A group is hot that holds more than the HOT-th part of all rows.
HOT = 1000


def normalise(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\v\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))  # on bytes: much cheaper than a pattern over every character
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def chunks(normalised: Column) -> Column:
    """The text's chunks in order; joined, they are the text. The empty text has none.

    A chunk has ``MIN_CHUNK`` to ``MAX_CHUNK`` characters and ends at the first cut in
    between. The last one may be shorter.
    """
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<={CUT})|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(normalised, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row_id, text_sha256, recipe, digests)`` for each row, without a shuffle."""
    return (
        docs.select(F.col(id_col).alias("row_id"), normalise(F.col(text_col)).alias("norm"))
        .select("row_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
        .select(
            "row_id",
            "text_sha256",
            F.transform("chunks", chunk_hash).alias("recipe"),
            F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
        )
    )


def colliding(staged: DataFrame) -> DataFrame:
    """``(hash, digest, ordinal)`` of all chunks whose hash a different chunk has as well; as a rule none.

    The dictionary is aggregated before the shuffle, so copies of a chunk leave each task once.
    """
    found = staged.select(F.explode(F.arrays_zip(F.col("recipe").alias("hash"), F.col("digests").alias("digest"))).alias("x"))
    entries = found.select("x.hash", "x.digest").distinct()
    # Contents of one 64-bit hash are few, whatever the corpus.
    listed = entries.groupBy("hash").agg(F.sort_array(F.collect_list("digest")).alias("all")).where(F.size("all") > 1)
    return listed.select("hash", F.posexplode("all").alias("ordinal", "digest"))


def verified(staged: DataFrame) -> DataFrame:
    """``staged`` with recipes whose identifiers stand for one content each.

    An identifier is a chunk's hash as long as the dictionary shows one content for it.
    Where it shows more, the content's rank among them is appended to the recipes that
    use the hash, so that their lists differ as their texts do.
    """
    extra = written(colliding(staged))
    if extra.isEmpty():
        return staged.select("row_id", "text_sha256", "recipe")
    used = staged.select("row_id", F.posexplode("digests").alias("pos", "digest")).join(extra, "digest")
    ranks = used.groupBy("row_id").agg(F.sort_array(F.collect_set(F.struct("pos", "ordinal"))).alias("ranks"))
    ranks = ranks.select(F.col("row_id").alias("of"), F.transform("ranks", lambda x: x["ordinal"].cast("long")).alias("ranks"))
    empty = F.array().cast("array<bigint>")
    return staged.join(ranks, F.col("row_id").eqNullSafe(F.col("of")), "left").select(
        "row_id", "text_sha256", F.concat("recipe", F.coalesce("ranks", empty)).alias("recipe")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after ``normalise``. Of equal texts the smallest id
    stays. Ids should be unique: rows that repeat an id and its text all count in
    ``group_size`` and all carry the same ``kept``. A null text is an empty one; a null
    id is the smallest of all, so its group has a null ``keep_id`` and only it stays.
    Other columns are not read, so their names cannot clash. An empty table gives an
    empty result.

    The text is read once (recipes are a small table in the shared folder). Groups are
    counted with partial aggregation. Those of more than ``1 / HOT`` of all rows, fewer than
    ``HOT`` groups, are looked up on the map side by a digest of their recipe, so that what
    is broadcast has a bounded size however long their texts are; the rest joins by recipe,
    none of them large enough to hold a task up.
    """
    staged = written(recipes(docs, id_col, text_col))
    rows = verified(staged)
    # A flag for null ids, not a struct: fixed-width buffers are aggregated by hash.
    smallest = F.when(F.max(F.col("row_id").isNull()), None).otherwise(F.min("row_id"))
    groups = written(rows.groupBy("recipe").agg(smallest.alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    large = F.col("group_size") * HOT > total
    digest = F.sha2(F.array_join(F.col("recipe").cast("array<string>"), ","), 256)
    hot = groups.where(large & (F.col("group_size") > 1)).select(digest.alias("of"), "keep_id", "group_size")
    met = rows.join(F.broadcast(hot), digest == F.col("of"), "left")
    names = ["row_id", "text_sha256", "keep_id", "group_size"]
    rest = met.where("of IS NULL").select("row_id", "text_sha256", "recipe").join(groups, "recipe")
    return met.where("of IS NOT NULL").select(names).union(rest.select(names)).select(
        F.col("row_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
