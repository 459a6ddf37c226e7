"""Null-aware numeric expressions shared by the operators."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from prudens.functions import sqltext


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c, digits: int) -> Column:
    """Round half up on the scaled value; plain double arithmetic, so it stays in codegen.
    Magnitudes from 1e11 on have no decimals worth rounding and pass through."""
    if isinstance(c, str):
        return F.expr(sqltext.half_up(c, digits))
    scale, c = float(10 ** digits), c.cast("double")
    return F.when(F.abs(c) < 1e11, F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).otherwise(c)


def clip(c, lo: float, hi: float) -> Column:
    """Clamp, keeping null (``greatest``/``least`` alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def positive(c) -> Column:
    """A value that can serve as a divisor: strictly positive, else null."""
    c = col(c)
    return F.when(c > 0, c)


def null_sum(*cols) -> Column:
    """Sum that skips nulls but is null when every term is."""
    cs = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    return F.when(F.coalesce(*cs).isNotNull(), total)


def count_present(cols) -> Column:
    return reduce(lambda a, b: a + b, [F.when(col(c).isNotNull(), 1).otherwise(0) for c in cols])


def null_mean(cols) -> Column:
    """Mean of the present values, null when there is none."""
    cs = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    n = count_present(cs)
    return F.when(n > 0, total / n)


def fixed2(c) -> Column:
    """Two-decimal text of a double, rounded half up on the scaled magnitude."""
    c = col(c)
    cents = F.floor(F.abs(c) * F.lit(100.0) + F.lit(0.5))
    sign = F.when((c < 0) & (cents > 0), "-").otherwise("")
    whole = F.floor(cents / 100).cast("string")
    return F.concat(sign, whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def fixed1(c) -> Column:
    c = col(c)
    tenths = F.floor(F.abs(c) * F.lit(10.0) + F.lit(0.5))
    sign = F.when((c < 0) & (tenths > 0), "-").otherwise("")
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
