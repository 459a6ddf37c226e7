"""A whole rating run: from every version of the inputs to results, errors and history.

All inputs of all periods are rated in one plan. Scored criteria and totals are staged; groups, errors, downgrades,
ranks and history read them. An input that cannot be rated is a row of ``errors`` and no row of ``results``.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from prudens.operators import rating
from prudens.operators.rating import KEY, Criterion
from prudens.plans.staging import stage
from prudens.sources.sinks import upsert_table


@dataclass(frozen=True)
class RatingRun:
    criteria: DataFrame   # every applicable criterion of the rated inputs
    groups: DataFrame     # group scores of the rated inputs
    results: DataFrame    # one row per rated input: total, grades, downgrade, rank, change
    status: DataFrame     # one row per asked input: its error, null where it was rated
    errors: DataFrame     # the rows of ``status`` with an error
    summary: DataFrame    # one row: inputs, rated, failed


def run_rating(inputs: DataFrame, objects: DataFrame, criteria: list[Criterion], weights: list[tuple], violations: DataFrame | None = None,
               losses: DataFrame | None = None, period: str | None = None, ladder=None) -> RatingRun:
    """Rate the latest approved version of each object and period.

    ``inputs``: ``(object_id, period, version, status, is_active, type_code, attributes, data)``; ``objects``:
    ``(object_id, type_code, attributes)``, an object that is not there leaves the input's own; ``weights``:
    ``(group, criterion weight, quantitative weight)``; ``losses``: ``(object_id, period, retained, capital)``.

    Active inputs without an approved version are NO_APPROVED_INPUT, approved ones no criterion applies to
    NO_CRITERION; other errors are the first failing criterion's status in order of codes. Rows without object or
    period are left out. ``period`` rates one period; windows over capital ratios and history then still reach back.
    """
    spark = inputs.sparkSession
    known = inputs.where("object_id is not null and period is not null and is_active = 1")
    approved = stage(rating.merge_attributes(rating.approved_inputs(known), objects), "approved")
    wanted = approved if period is None else approved.where(F.col("period") == period)
    asked = (known if period is None else known.where(F.col("period") == period)).select(*KEY).distinct()
    scored = stage(rating.score_criteria(wanted, criteria, violations), "scored")
    checked = stage(_checked(asked, wanted, scored), "checked")
    good = checked.where("error is null").select(*KEY)
    kept = scored.join(good, KEY, "left_semi")
    groups = rating.group_scores(kept, rating.group_weights(spark, weights))
    if losses is None:
        losses = spark.createDataFrame([], "object_id string, period string, retained double, capital double")
    down = rating.forced_downgrade(rating.totals(groups, ladder), losses, rating.car_window(approved), kept)
    ranked = rating.score_history(rating.rank_objects(stage(down, "rated"), "total_score"))
    results = ranked.join(wanted.select(*KEY, "type_code", "version"), KEY)
    summary = checked.agg(F.count(F.lit(1)).alias("n_inputs"), F.count_if(F.col("error").isNull()).alias("n_rated"),
                          F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    return RatingRun(kept, groups, results, checked, checked.where("error is not null"), summary)


def _checked(asked: DataFrame, wanted: DataFrame, scored: DataFrame) -> DataFrame:
    """Per asked input its error or null, the criterion it comes from, and the variables missing anywhere in it."""
    bad = F.col("status").isin("VARIANT_CONFLICT", "MISSING_INPUT", "NO_BAND", "OVERLAPPING_BANDS")
    # bounded by the configured criteria
    found = scored.groupBy(*KEY).agg(F.min(F.when(bad, F.struct("code", "status"))).alias("_first"), F.count_if(bad).alias("_n"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(bad, F.col("missing")))))).alias("_missing"))
    rows = asked.join(wanted.select(*KEY, F.lit(True).alias("_approved")), KEY, "left").join(found, KEY, "left")
    error = (F.when(F.col("_approved").isNull(), "NO_APPROVED_INPUT").when(F.col("_n").isNull(), "NO_CRITERION").otherwise(F.col("_first.status")))
    return rows.select(*KEY, error.alias("error"), F.col("_first.code").alias("code"), F.coalesce("_n", F.lit(0)).alias("n_errors"),
                       F.array_join("_missing", ",").alias("missing"))


def store_rating(run: RatingRun, root: str) -> None:
    """Put a run's tables into the versioned tables under ``root``; a rated input replaces its earlier result.

    Criteria and groups are replaced input by input, so a criterion that no longer applies goes. An input that
    fails now keeps its last result; its status says so.
    """
    spark, root = run.results.sparkSession, root.rstrip("/")
    for name, rows in (("criteria", run.criteria), ("groups", run.groups), ("results", run.results), ("status", run.status)):
        upsert_table(spark, rows, f"{root}/{name}", KEY)
