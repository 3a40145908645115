"""Batch jobs by running sums against a loop, answers joined back, and means kept up to date by a stream."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators.batches import collected, cut
from mosaiq.operators.ordered import running_sums
from mosaiq.streaming import centroids


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 0, 1, 7, -3, 10**12])) for i in range(2000)]
    r.shuffle(rows)
    found = running_sums(spark.createDataFrame(rows, "k int, n long").repartition(7), ["k"], F.col("n")).orderBy("k").collect()
    total = 0
    for i, (k, n) in enumerate(sorted(rows)):
        assert (found[i]["ord"], found[i]["before"]) == (i + 1, total)
        total += n or 0
    assert running_sums(spark.createDataFrame([], "k int, n long"), ["k"], F.col("n")).columns == ["k", "n", "ord", "before"]


@pytest.mark.parametrize("token_cap,request_cap", [(100, 1000), (100, 3), (2, 5), (1, 1)])
def test_batches_keep_both_caps(spark, token_cap, request_cap):
    r = random.Random(token_cap)
    rows = [(i, r.choice([None, 0, 1, 5, 20, 50, 51, 99, 100, 400])) for i in range(700)]
    found = cut(spark.createDataFrame(rows, "k int, n int").repartition(5), ["k"], F.col("n"), token_cap, request_cap).orderBy("k").collect()
    assert [f["tokens"] for f in found] == [max(1, n or 1) for _, n in rows]
    held = defaultdict(list)
    for f in found:
        held[f["batch"]].append((f["place"], f["tokens"], f["k"]))
    for members in held.values():
        assert [p for p, _, _ in sorted(members)] == list(range(len(members))) and sorted(members) == sorted(members, key=lambda m: m[2])
        assert len(members) <= request_cap and (sum(t for _, t, _ in members) <= token_cap or len(members) == 1)
    before, half = 0, token_cap // 2
    groups = defaultdict(list)
    for i, f in enumerate(found):
        small = f["tokens"] <= half
        groups[f"s{before // (token_cap - half + 1)}" if small else f"l{i + 1}"].append(f)
        before += f["tokens"] if small else 0
    assert {f["k"]: f["batch"] for f in found} == {f["k"]: f"{name}-{j // request_cap}" for name, g in groups.items() for j, f in enumerate(g)}


def test_the_first_answer_of_jobs_that_did_not_fail_counts(spark):
    answers = spark.createDataFrame(
        [("a", "x", 2, "late", None), ("a", "y", 1, "lost", None), ("b", "x", 1, "bad", "refused"), ("b", "z", 5, "good", None), ("c", "y", 1, "lost", None), ("d", "w", 1, "unknown job", None), (None, "x", 9, "no key", None), ("a", "x", 1, "first", None)],
        "key string, batch string, line int, answer string, error string",
    )
    jobs = spark.createDataFrame([("x", "completed"), ("y", "failed"), ("z", "completed"), ("z", "completed"), ("v", "completed")], "batch string, status string")
    found = {r["key"]: r["answer"] for r in collected(answers, jobs, "key", ["batch", "line"]).collect()}
    assert found == {"a": "first", "b": "good", None: "no key"}


def test_means_by_stream_in_several_runs(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(int(i % 4) if i % 11 else None, r.normal(size=3).tolist() if i % 13 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    for run in range(3):
        spark.createDataFrame(rows[run * 100 : run * 100 + 100], df.schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        centroids.sum_new_files(spark, f"{tmp_path}/in", df.schema, "label", "v", f"{tmp_path}/sums", f"{tmp_path}/log", 1).awaitTermination()

    def read():
        return {m["cluster"]: (m["n"], np.round(m["centroid"], 9).tolist()) for m in centroids.merged(spark, f"{tmp_path}/sums").collect()}

    wanted = {c: [np.array(v) for label, v in rows if label == c and v is not None] for c in range(4)}
    assert read() == {c: (len(v), np.round(np.mean(v, axis=0), 9).tolist()) for c, v in wanted.items()}
    # A batch that is run again replaces what it left.
    before, last = read(), spark.createDataFrame(rows[:50], df.schema)
    centroids.add_batch(last, 99, "label", "v", f"{tmp_path}/sums")
    once = read()
    centroids.add_batch(last, 99, "label", "v", f"{tmp_path}/sums")
    assert read() == once != before
