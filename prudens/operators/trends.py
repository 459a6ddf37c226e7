"""Row-based trend features per bank and metric.

All windows share one partitioning and ordering, so Spark shuffles and sorts once; a partition
holds one bank's reporting history of one metric and is bounded by the calendar.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prudens import config

PARTITION = ["bank_id", "metric"]


def _pct(now: Column, then: Column) -> Column:
    return F.when(then != 0, (now / then - 1) * 100)


def trend_features(long: DataFrame, window: int | None = None, yoy_periods: int = 4, order: str = "period_ts",
                   partition=None) -> DataFrame:
    """Adds roll_mean, roll_std, roll_z, qoq, yoy, accel, drawdown to ``(…, metric, value)``.

    ``yoy`` compares with the value ``yoy_periods`` rows back whatever the frequency; changes
    from zero are null.
    """
    n = window or config.MODEL["rolling_window"]
    g = Window.partitionBy(*(partition or PARTITION)).orderBy(order)
    recent, upto = g.rowsBetween(-(n - 1), 0), g.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value")
    enough = F.count(v).over(recent) >= 2
    step1 = long.select(
        "*", F.when(enough, F.avg(v).over(recent)).alias("roll_mean"),
        F.when(enough, F.stddev_samp(v).over(recent)).alias("roll_std"),
        F.last(v, ignorenulls=True).over(upto).alias("_f"), F.max(v).over(upto).alias("_peak"))
    step2 = step1.select("*", F.lag("_f", 1).over(g).alias("_f1"), F.lag("_f", yoy_periods).over(g).alias("_fy"))
    step3 = step2.select("*", _pct(F.col("_f"), F.col("_f1")).alias("qoq"), _pct(F.col("_f"), F.col("_fy")).alias("yoy"))
    out = step3.select("*", (F.col("qoq") - F.lag("qoq", 1).over(g)).alias("accel"))
    return out.select(
        *long.columns, "roll_mean", "roll_std",
        F.when(F.col("roll_std") != 0, (v - F.col("roll_mean")) / F.col("roll_std")).alias("roll_z"),
        "qoq", "yoy", "accel",
        F.when(v.isNotNull() & (F.col("_peak") != 0), (v - F.col("_peak")) / F.col("_peak") * 100).alias("drawdown"))


def wide_trends(wide: DataFrame, roll_z=(), qoq=(), window: int | None = None) -> DataFrame:
    """Only the named ``m__roll_z`` and ``m__qoq`` columns, on the wide table: one window per bank
    for all of them, no unpivot and no join back."""
    n = (window or config.MODEL["rolling_window"]) - 1
    over = "over (partition by bank_id order by period_ts rows between {} and current row)"
    recent, upto = over.format(f"{n} preceding"), over.format("unbounded preceding")
    back = "over (partition by bank_id order by period_ts)"
    roll_z, qoq = [m for m in roll_z if m in wide.columns], [m for m in qoq if m in wide.columns]
    step = wide.selectExpr("*", *[f"case when count({m}) {recent} >= 2 then avg({m}) {recent} end as _mean_{m}" for m in roll_z],
                           *[f"case when count({m}) {recent} >= 2 then stddev_samp({m}) {recent} end as _std_{m}" for m in roll_z],
                           *[f"last({m}, true) {upto} as _f_{m}" for m in qoq])
    step = step.selectExpr("*", *[f"lag(_f_{m}) {back} as _p_{m}" for m in qoq])
    return step.selectExpr(
        *wide.columns, *[f"({m} - _mean_{m}) / nullif(_std_{m}, 0D) as {m}__roll_z" for m in roll_z],
        *[f"(_f_{m} / nullif(_p_{m}, 0D) - 1) * 100 as {m}__qoq" for m in qoq])


def metric_series(long: DataFrame, bank_id: str, metric: str, window: int = 4) -> DataFrame:
    """One bank's series with rolling statistics; the filter reaches the scan."""
    one = long.where((F.col("bank_id") == bank_id) & (F.col("metric") == metric))
    return trend_features(one, window).select("period", "period_ts", "metric", "value", "roll_mean", "roll_std",
                                              "roll_z", "drawdown").orderBy("period_ts")
