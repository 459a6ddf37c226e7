"""Rows meet the group they belong to, whatever share of the rows one group holds.

A plain join sends all rows of a group to one task. Here groups come with the number of their rows, counted
before; those that hold more than one row in HOT_SHARE can't be more than HOT_SHARE, so they are broadcast,
and their rows are dealt out by another column. All others go through an ordinary shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot from total / HOT_SHARE rows on: there are fewer than HOT_SHARE hot groups in any table.
HOT_SHARE = 1000
#: Groups that are broadcast whole, without a shuffle of the rows; their number is counted first.
BROADCAST_ROWS = 200_000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, spread: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the other columns of ``groups`` (one row for each value of ``keys``), null where there is none.

    ``count`` is the column of ``groups`` that says how many rows each has, ``total`` the number of all rows.
    Rows with a null key have no group; they and the rows of hot groups are dealt out by ``spread``.
    """
    values = [c for c in groups.columns if c not in keys]
    if groups.count() <= broadcast_rows:
        return rows.join(F.broadcast(groups), keys, "left")
    hot = groups.where(F.col(count) * HOT_SHARE > total).select(*keys, F.struct(*values).alias("_hot"))
    lost = F.col(keys[0]).isNull()
    for k in keys[1:]:
        lost = lost | F.col(k).isNull()
    met = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull() | lost, F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long")))
    cold = groups.where(F.col(count) * HOT_SHARE <= total).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_cold"))
    found = met.join(cold, [*keys, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return found.select(*rows.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
