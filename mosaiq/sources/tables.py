"""Readers and writers of the tables at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

SCORED_TAGS = "uuid string, primary_tag string, secondary_tag string, coherence_score string"
CARDS = (
    "uuid string, profile struct<name:string,basic_info:string,education:string>, summary string, "
    "details struct<career_goals_and_ambitions:string,cultural_background:string,culinary_persona:string,hobbies_and_interests_list:array<string>>, "
    "labels struct<archetype:string,primary_tag:string,secondary_tag:string>"
)


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Only the named columns reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 0, exists: str = "errorifexists") -> None:
    """zstd, files rolled by row count if asked for. ``exists`` may be ``ignore``: an output that is there is kept."""
    df.write.mode(exists).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header; a byte order mark before it is no part of the first name."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def json_documents(spark: SparkSession, path: str, schema: str | S.StructType | None = None) -> DataFrame:
    """A file that holds one array of objects, or one object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def mentor_cards(spark: SparkSession, path: str) -> DataFrame:
    """Nested cards; labels and texts under short names, missing ones null."""
    cards = json_documents(spark, path, CARDS)
    return cards.select("uuid", F.col("profile.name").alias("name"), F.col("profile.basic_info").alias("basic_info"), "summary", "details.*", F.col("labels.archetype").alias("arch"), F.col("labels.primary_tag").alias("tag"))


def request_lines(df: DataFrame, body: Column, prefix: str = "req", offset: int = 0) -> DataFrame:
    """``value``: one JSON request a line, with a ``custom_id`` that counts on from ``offset`` by the column ``ord``."""
    name = F.concat(F.lit(f"{prefix}-"), (F.col("ord") + offset).cast("string"))
    return df.select(F.to_json(F.struct(name.alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def parsed_results(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """``df`` with numeric fields of a JSON text; missing or malformed ones are 0."""
    parsed = F.from_json(F.col(column), ", ".join(f"`{f}` double" for f in fields))
    return df.withColumns({f: F.coalesce(parsed[f], F.lit(0.0)) for f in fields})


def batch_sizes(n: int, per_request: int, token_cap: int, request_cap: int) -> list[int]:
    """Requests in each batch job, bounded by a cap on requests and one on tokens."""
    size = max(1, min(request_cap, token_cap // max(1, per_request)))
    return [min(size, n - at) for at in range(0, n, size)]


def admitted(active: int, queued_tokens: int, next_tokens: int, most_active: int = 3, most_tokens: int = 1_800_000) -> bool:
    """Whether another batch job may be sent."""
    return active < most_active and queued_tokens + next_tokens <= most_tokens


def write_mapping(mapping: DataFrame, path: str) -> None:
    """``key, label`` rows, a few of them such as a row a cluster, as one JSON object in order of the keys."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("key").cast("string"), "label")))
    mapping.agg(F.to_json(F.map_from_entries(pairs)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``key, label`` rows from a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "label"))


def write_chunks(df: DataFrame, path: str, chunk: Column, done: set[int], transform: Callable[[DataFrame], DataFrame]) -> None:
    """Chunks that are not ``done`` yet, each a partition of its own that a rerun overwrites."""
    rest = transform(df.withColumn("chunk", chunk).where(~F.col("chunk").isin(*done) if done else F.lit(True)))
    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def chunks_done(spark: SparkSession, path: str) -> set[int]:
    """Chunks that an earlier run has finished."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return set()
    return {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(jpath) if s.getPath().getName().startswith("chunk=")}
