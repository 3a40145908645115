"""Rows chosen and numbered by a total order, against sorting in Python."""

import random

import pytest
from pyspark.sql import functions as F

from mosaiq.operators.ordered import first_k, ordinals, top_k
from mosaiq.operators.sampling import exact_sample

BIG = 2**63


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(5)
    pool = [-BIG, BIG - 1, -1, 0, 1, 7, 7, 7]
    rows = [(r.choice([*pool, r.randrange(-BIG, BIG)]), r.choice([-BIG, -3, 0, r.randrange(-BIG, BIG)]), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "a long, b long, u long").repartition(7).cache()


@pytest.mark.parametrize("k", [-1, 0, 1, 2, 500, 1499, 2999, 3000, 5000])
def test_first_k_rows(table, k):
    rows, df = table
    found = sorted(tuple(r) for r in df.where(first_k(df, ["a", "b", "u"], k)).collect())
    assert found == sorted(rows)[: max(k, 0)]


def test_ties_with_the_kth_row_are_in_the_condition_and_not_in_top_k(table, spark):
    rows, df = table
    wanted = sorted((a for a, _, _ in rows))
    assert df.where(first_k(df, ["a"], 900)).count() == sum(a <= wanted[899] for a in wanted)
    assert [r["ord"] for r in top_k(df, ["a"], 900).orderBy("ord").collect()] == list(range(1, 901))
    same = spark.range(50).select(F.lit(4).cast("long").alias("a"))
    assert top_k(same, ["a"], 20).count() == 20


def test_ordinals_are_dense_and_in_order(table, spark):
    rows, df = table
    found = sorted((r["n"], (r["a"], r["b"], r["u"])) for r in ordinals(df.withColumn("n", F.lit("old")), ["a", "b", "u"], "n", start=0).collect())
    assert found == list(enumerate(sorted(rows)))
    assert ordinals(df.where("false"), ["a"]).columns == ["a", "b", "u", "ord"]
    assert first_k(df.where("false"), ["a"], 3) is not None


def test_no_task_holds_more_than_its_range(spark):
    df = spark.range(200_000).select(F.xxhash64("id").alias("a"), F.lit("x" * 20).alias("wide")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = ordinals(top_k(df, ["a"], 150_000).drop("ord"), ["a"])
        sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 150_000 and max(sizes) < 150_000 * 0.4


def test_exact_sample_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (None, "d"), (2, "e")], "doc_id long, __ord string")
    for n in range(7):
        assert exact_sample(df, n, "doc_id").count() == min(n, 5)
    assert exact_sample(df, 3, "doc_id").columns == df.columns
