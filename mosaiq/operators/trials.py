"""Trials of a panel and its answers: a table of results, their rates and statistics, and results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import text as T
from mosaiq.operators import diversity, stats

TYPES_WANTED = 3


def trial_table(answers: DataFrame, times: DataFrame | None = None, method: str = "self_bleu", threshold: float = diversity.THRESHOLD) -> DataFrame:
    """One row a trial: ``scenario, repeat, diversity, method, passed, n_valid, types, n_distinct_types`` and the columns of ``times``.

    ``answers`` has ``scenario, repeat, ordinal, type, text``; texts are cleaned, and only
    valid ones are compared. The method is what the caller configured, never a silent
    fallback. ``times`` has ``scenario, repeat`` and seconds.
    """
    keys = ["scenario", "repeat"]
    rows = answers.select(F.struct(*keys).alias("trial"), "ordinal", "type", T.postprocess(F.col("text")).alias("p"))
    valid = rows.where("p.is_valid").select("trial", "ordinal", F.col("p.text").alias("text"))
    scored = diversity.report(rows, diversity.lexical(valid, "trial", "ordinal", "text"), "trial", threshold)
    kinds = rows.groupBy("trial").agg(F.sort_array(F.collect_list("type")).alias("types"), F.count_distinct("type").alias("n_distinct_types"), F.count_if("p.is_valid").alias("n_valid"))
    found = scored.join(kinds, "trial").select("trial.*", F.col("mean_score").alias("diversity"), F.lit(method).alias("method"), "passed", "n_valid", "types", "n_distinct_types")
    return found if times is None else found.join(times, keys, "left")


def trial_report(trials: DataFrame, measures: list[str], overall: str = "ALL") -> DataFrame:
    """``(scenario, measure, n_trials, pass_rate, distinct_type_rate, mean, p50, p95, min, max)`` by scenario and over all trials."""
    each = [F.struct(F.lit(m).alias("measure"), *stats.bundle(m)).alias(f"__{m}") for m in measures]
    rolled = trials.rollup("scenario").agg(
        F.count(F.lit(1)).alias("n_trials"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg((F.col("n_distinct_types") == TYPES_WANTED).cast("double")).alias("distinct_type_rate"),
        F.grouping("scenario").alias("g"), *each,
    )
    name = F.when(F.col("g") == 1, overall).otherwise(F.col("scenario").cast("string")).alias("scenario")
    rows = rolled.select(name, "n_trials", "pass_rate", "distinct_type_rate", F.explode(F.array(*(f"__{m}" for m in measures))).alias("m"))
    return rows.select("scenario", "m.measure", "n_trials", "pass_rate", "distinct_type_rate", *(f"m.{c}" for c in ("mean", "p50", "p95", "min", "max")))


def results_json(answers: DataFrame, scored: DataFrame, request: str, request_fields: list[str], slot_fields: list[str], threshold: float = diversity.THRESHOLD) -> DataFrame:
    """``(request, json)``: the request's fields, its diversity and its slots in order, as one JSON object.

    ``answers`` has ``ordinal`` and the named fields; ``scored`` has ``mean_score`` and ``passed`` by request.
    """
    slots = answers.groupBy(request).agg(
        F.first(F.struct(*request_fields)).alias("scenario"), F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*slot_fields).alias("s"))))["s"].alias("mentors")
    )
    joined = slots.join(scored.select(request, "mean_score", "passed"), request)
    scores = F.struct(F.round("mean_score", 4).alias("mean_score"), "passed", F.lit(threshold).alias("threshold"))
    return joined.select(request, F.to_json(F.struct("scenario", scores.alias("diversity"), "mentors")).alias("json"))
