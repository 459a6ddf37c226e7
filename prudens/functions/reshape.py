"""Wide <-> long. ``explode`` keeps the partitioning of its input (an Expand would not), so a
table already hashed by bank is not shuffled again by the windows that follow."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def to_long(wide: DataFrame, ids: list[str], metrics: list[str], metric: str = "metric", value: str = "value",
            keep_null: bool = True, cluster_by: list[str] | None = None) -> DataFrame:
    """One row per cell. ``cluster_by`` hashes the compact wide rows first, so that windows by those
    keys (and more) over the long rows need no shuffle of their own."""
    if cluster_by:
        wide = wide.repartition(*cluster_by)
    cells = ", ".join(f"struct('{m}' as {metric}, cast(`{m}` as double) as {value})" for m in metrics)
    # without any metric the result is empty but keeps its columns
    array = f"array({cells})" if metrics else f"cast(array() as array<struct<{metric}: string, {value}: double>>)"
    out = wide.selectExpr(*ids, f"explode({array}) as _c").select(*ids, f"_c.{metric}", f"_c.{value}")
    return out if keep_null else out.where(F.col(value).isNotNull())


def to_wide(long: DataFrame, ids: list[str], metrics: list[str], metric: str = "metric", value: str = "value",
            suffix: str = "") -> DataFrame:
    """Pivot over a given metric list: conditional aggregates, no extra job to find the columns."""
    aggs = [F.expr(f"max(case when {metric} = '{m}' then {value} end) as {m}{suffix}") for m in metrics]
    return long.where(F.col(metric).isin(metrics)).groupBy(*ids).agg(*aggs)


def ensure_columns(df: DataFrame, cols, dtype: str = "double") -> DataFrame:
    """Add absent metric columns as typed nulls."""
    missing = [c for c in dict.fromkeys(cols) if c not in df.columns]
    return df.selectExpr("*", *[f"cast(null as {dtype}) as {c}" for c in missing]) if missing else df
