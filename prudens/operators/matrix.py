"""Model matrix: column choice, winsorising, median imputation, scaling.

Per-column parameters are a handful of numbers, computed by distributed aggregates and brought
to the driver; the matrix itself is an expression over the wide table.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from prudens import config
from prudens.functions.reshape import to_long
from prudens.functions.ranks import group_quantiles
from prudens.operators.ratios import base_metrics
from prudens.plans.staging import stage


@dataclass(frozen=True)
class ColumnParams:
    name: str
    lo: float | None
    hi: float | None
    median: float
    center: float
    scale: float

    def imputed(self) -> str:
        clipped = self.name if self.lo is None else f"least(greatest({self.name}, {self.lo!r}D), {self.hi!r}D)"
        return f"(case when {self.name} is null then {self.median!r}D else {clipped} end)"

    def scaled(self) -> str:
        return f"(({self.imputed()} - {self.center!r}D) / {self.scale!r}D)"


def fit_matrix(features: DataFrame, candidates: list[str], winsorize=None, scaler: str = "standard",
               min_ratio: float | None = None) -> list[ColumnParams]:
    """Usable columns with their clip bounds, median, centre and scale; a constant column scales by 1."""
    cols = base_metrics(features, [c for c in candidates if c in features.columns], min_ratio)
    if not cols:
        return []
    probs = {"q2": 0.5}
    if winsorize:
        probs |= {"lo": winsorize[0], "hi": winsorize[1]}
    long = to_long(features, [], cols, keep_null=False)
    q = {r["metric"]: r for r in group_quantiles(long, ["metric"], "value", probs).collect()}
    cols = [c for c in cols if c in q]
    raw = [ColumnParams(c, q[c]["lo"] if winsorize else None, q[c]["hi"] if winsorize else None, q[c]["q2"], 0.0, 1.0) for c in cols]
    if scaler == "robust":
        filled = to_long(features.selectExpr(*[f"{p.imputed()} as {p.name}" for p in raw]), [], cols)
        s = {r["metric"]: r for r in group_quantiles(filled, ["metric"], "value", {"a": 0.25, "m": 0.5, "b": 0.75}).collect()}
        return [ColumnParams(p.name, p.lo, p.hi, p.median, s[p.name]["m"], (s[p.name]["b"] - s[p.name]["a"]) or 1.0) for p in raw]
    row = features.selectExpr(*[f"{p.imputed()} as {p.name}" for p in raw]).agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return [ColumnParams(p.name, p.lo, p.hi, p.median, row[f"m_{p.name}"], row[f"s_{p.name}"] or 1.0) for p in raw]


def scaled_matrix(features: DataFrame, params: list[ColumnParams], keep=None) -> DataFrame:
    return features.selectExpr(*(keep or config.ID_COLS), *[f"{p.scaled()} as {p.name}" for p in params])


def grouped_matrix(features: DataFrame, group: str, candidates: list[str], model: dict) -> DataFrame:
    """``(ids, group, x)``: rows winsorised, imputed and scaled by the parameters of their own group.

    ``x`` holds the columns that the group fills well enough, in order. All parameters of all groups are one staged
    table of a row per group; cells meet it on (group, metric) only in aggregates. ``features`` should be staged.
    """
    if model["scaler"] == "robust":
        raise ValueError("groups are scaled by mean and deviation only")
    cols = [c for c in candidates if c in features.columns]
    long = to_long(features, [group], cols)
    lo, hi = model["winsorize"] or (0.0, 1.0)
    cuts = group_quantiles(long, [group, "metric"], "value", {"lo": lo, "hi": hi, "med": 0.5})
    shape = long.groupBy(group, "metric").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("share"))
    kept = stage(cuts.join(shape.where(F.col("share") >= model["min_non_null_ratio"]), [group, "metric"]), "peer_cuts")
    filled = F.when(F.col("value").isNull(), F.col("med")).otherwise(F.least(F.greatest("value", "lo"), "hi"))
    moments = long.join(kept, [group, "metric"]).select(group, "metric", filled.alias("v")).groupBy(group, "metric").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    params = kept.join(moments, [group, "metric"]).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("lo", "hi", "med", "mu", F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0)).alias("sd"))))).alias("p"))
    # by column number, so that a cell finds its parameters at once; the staged table's size lets Spark broadcast it
    params = stage(params.select(group, F.array(*[F.try_element_at("p", F.lit(c)) for c in cols]).alias("p")), "peer_params")
    cell = ", ".join(f"cast(`{c}` as double)" for c in cols)
    value = "case when q is not null then ((case when v is null then q.med else least(greatest(v, q.lo), q.hi) end) - q.mu) / q.sd end"
    return features.join(params, group).selectExpr(*config.ID_COLS, group, f"filter(zip_with(array({cell}), p, (v, q) -> {value}), z -> z is not null) as x")
