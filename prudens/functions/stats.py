"""Shares of columns."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def null_share(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Non-null share of each column: one aggregate, one row to the driver."""
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols]).first()
    return {c: (row[c] or 0.0) for c in cols}
