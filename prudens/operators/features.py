"""The feature table: every base metric with its seven trends and three cross-section features.

A bank's history is one sorted array of structs, and all trends of all metrics are one ``transform`` over it, so
the plan has no window per metric and doesn't grow with their number. Ranks and medians across banks come from
range partitions (``crosssection``) and travel to the bank in the same rows. A history is bounded by the calendar.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prudens import config
from prudens.functions.reshape import to_long
from prudens.operators import crosssection, ratios
from prudens.plans.staging import stage

TRENDS = ["roll_mean", "roll_std", "roll_z", "qoq", "yoy", "accel", "drawdown"]
CROSS = ["pct_rank", "dev_sys_median", "z_cross"]


def _trends(metrics: int, window: int, yoy_periods: int) -> list[list[str]]:
    """Successive selects from ``hist`` to ``t``: an array over metrics of arrays over periods of the trends."""
    run = "named_struct('f', coalesce(v, a.f), 'p', greatest(a.p, v)"
    carried = (f"aggregate(s, named_struct('f', cast(null as double), 'p', cast(null as double), 'o', cast(array() as array<struct<f: double, p: double>>)),"
               f" (a, v) -> {run}, 'o', concat(a.o, array({run})))), a -> a.o)")
    known = f"filter(slice(s, greatest(i - {window - 2}, 1), least(i + 1, {window})), x -> x is not null)"
    mean = "(case when size(w) >= 2 then aggregate(w, 0D, (t, x) -> t + x) / size(w) end)"
    # the window's values and mean are used twice: bound by a transform over a one-element array
    rolled = (f"transform(s, (v, i) -> transform(transform(array({known}), w -> struct(w, {mean} as m)),"
              " b -> struct(b.m as m, case when b.m is not null then sqrt(aggregate(b.w, 0D, (t, x) -> t + (x - b.m) * (x - b.m)) / (size(b.w) - 1)) end as sd))[0])")
    change = "(x.r[i].f / nullif(get(x.r, i - {0}).f, 0D) - 1) * 100"
    return [
        ["bank_id", "hist", f"transform(sequence(0, {metrics - 1}), k -> transform(hist, h -> h.cells[k].value)) as series"],
        ["bank_id", "hist", f"transform(series, s -> struct(s, {carried} as r, {rolled} as a)) as m"],
        ["bank_id", "hist", f"transform(m, x -> transform(x.s, (v, i) -> struct(v, x.r[i].p as p, x.a[i].m as roll_mean, x.a[i].sd as roll_std, {change.format(1)} as qoq, {change.format(yoy_periods)} as yoy))) as m"],
        ["bank_id", "hist", "transform(m, x -> transform(x, (e, i) -> struct(e.roll_mean, e.roll_std, (e.v - e.roll_mean) / nullif(e.roll_std, 0D) as roll_z, e.qoq, e.yoy,"
                            " e.qoq - get(x, i - 1).qoq as accel, (e.v - e.p) / nullif(e.p, 0D) * 100 as drawdown))) as t"],
    ]


def trends_and_cross(features: DataFrame, metrics: list[str], window: int | None = None, yoy_periods: int = 4) -> DataFrame:
    """ids, each metric ``m`` and its ``m__suffix`` columns."""
    long = to_long(features, config.ID_COLS, metrics)
    place = F.array_position(F.lit(metrics), F.col("metric"))
    cell = F.struct(place.alias("k"), F.col("value").cast("double").alias("value"), *CROSS)
    by_period = crosssection.systemic_features(long).select(*config.ID_COLS, cell.alias("c")).repartition("bank_id").groupBy(*config.ID_COLS).agg(F.sort_array(F.collect_list("c")).alias("cells"))
    rest = [c for c in config.ID_COLS if c not in ("bank_id", "period_ts")]
    at = by_period.groupBy("bank_id").agg(F.sort_array(F.collect_list(F.struct("period_ts", *rest, "cells"))).alias("hist"))
    for step in _trends(len(metrics), window or config.MODEL["rolling_window"], yoy_periods):
        at = at.selectExpr(*step)
    # each period takes its own cells and trends along, nothing of the others
    rows = at.selectExpr("bank_id", "inline(transform(hist, (h, i) -> struct(h.period_ts, " + ", ".join(f"h.{c}" for c in rest) + ", h.cells, transform(t, x -> x[i]) as t)))")
    wide = [x for k, m in enumerate(metrics) for x in (f"cells[{k}].value as {m}", *[f"t[{k}].{s} as {m}__{s}" for s in TRENDS], *[f"cells[{k}].{s} as {m}__{s}" for s in CROSS])]
    return rows.selectExpr(*config.ID_COLS, *wide)


def build_features(wide: DataFrame, model: dict | None = None) -> tuple[DataFrame, list[str]]:
    """The feature table of one frequency and its base metrics.

    Ratios are derived; metrics filled in enough rows are the base and get all suffixes, other columns stay as they
    are; each row has its period's systemic stress and high-risk flag. An empty table gives no base and no rows.
    """
    m = model or config.MODEL
    features = stage(ratios.derive_ratios(wide), "features")
    numeric = [f.name for f in features.schema if f.name not in config.ID_COLS and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    base = ratios.base_metrics(features, numeric, m["min_non_null_ratio"])
    if not base:
        return features, []
    out = trends_and_cross(features, base, m["rolling_window"])
    others = [c for c in features.columns if c not in base and c not in config.ID_COLS]
    if others:
        out = out.join(features.select("bank_id", "period", *others), ["bank_id", "period"])
    stress = to_long(features, config.ID_COLS, [c for c in config.STRESS_INDEX_METRICS if c in features.columns])
    flags = crosssection.high_risk_flag(crosssection.systemic_stress(stress)).select("period", "systemic_stress_index", "systemic_stress_pct", "high_risk_period_flag")
    return out.join(flags, "period", "left"), base
