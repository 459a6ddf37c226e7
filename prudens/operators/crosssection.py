"""Features of a bank against the whole system, and the system's own stress."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prudens import config
from prudens.functions.ranks import Positions, average_rank_pct
from prudens.functions.tables import literal_table


def systemic_features(long: DataFrame) -> DataFrame:
    """Adds pct_rank, dev_sys_median and z_cross to ``(…, period, metric, value)``.

    Ranks and medians are exact and come from range partitions (``prudens.functions.ranks``): a period's banks
    are never sorted in one task, and no row is joined back on its value.
    """
    keys = ["period", "metric"]
    pos = Positions(long, keys, "value", ["bank_id"])
    spread = pos.source.groupBy(*keys).agg(F.stddev_samp("value").alias("_std"))
    off = F.col("value") - F.col("median")
    found = pos.rows_with(pos.quantiles({"median": 0.5}).join(spread, keys)).select(
        *long.columns, average_rank_pct().alias("pct_rank"), off.alias("dev_sys_median"), F.when(F.col("_std") != 0, off / F.col("_std")).alias("z_cross"))
    return found.union(pos.nulls.select(*long.columns, *[F.lit(None).cast("double")] * 3))


def pct_ranks(long: DataFrame) -> DataFrame:
    """Only the percentile rank within period and metric."""
    pos = Positions(long, ["period", "metric"], "value", ["bank_id"])
    return pos.rows.select(*long.columns, average_rank_pct().alias("pct_rank")).union(pos.nulls.select(*long.columns, F.lit(None).cast("double")))


def small_pct_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average-tie percentile rank of a table with one row per period (bounded by the calendar)."""
    everything = Window.partitionBy(F.lit(0)).orderBy(value)
    same, total = Window.partitionBy(value), Window.partitionBy(F.lit(0))
    rank = F.rank().over(everything.orderBy(F.col(value).asc_nulls_last()))
    return df.select("*", F.when(F.col(value).isNotNull(),
                                 (rank + (F.count(value).over(same) - 1) / 2) / F.count(value).over(total) * 100).alias(out))


def systemic_stress(long: DataFrame, signs: dict[str, int] | None = None, baseline: str = "pooled",
                    min_values: int = 3) -> DataFrame:
    """Per period: mean over metrics of the signed mean z-score, and its percentile among periods.

    With ``baseline="pooled"`` (default) a metric is standardised on its mean and deviation over
    all periods. ``baseline="period"`` standardises within the period itself; that index is zero
    up to rounding by construction and exists for reference.

    One aggregation over ``period x metric`` feeds everything that follows, so all later steps
    run on rows bounded by the calendar.
    """
    signs = signs or config.STRESS_INDEX_METRICS
    sign = literal_table(long.sparkSession, "metric string, sign double", [(m, float(s)) for m, s in signs.items()])
    cells = (long.where(F.col("metric").isin(list(signs))).groupBy("period", "period_ts", "metric")
             .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")))
    if baseline == "period":
        scored = cells.select("*", F.when(F.sqrt("var") != 0, F.lit(0.0)).alias("z"))
    else:
        m = Window.partitionBy("metric")
        n = F.sum("n").over(m)
        mu = F.sum(F.col("n") * F.col("mean")).over(m) / n
        pooled = cells.select("*", mu.alias("mu"), n.alias("big_n"))
        var = F.sum(F.col("n") * (F.col("var") + (F.col("mean") - F.col("mu")) * (F.col("mean") - F.col("mu")))).over(m) / F.col("big_n")
        scored = pooled.select("*", F.sqrt(var).alias("sd")).select(
            "*", F.when(F.col("sd") != 0, (F.col("mean") - F.col("mu")) / F.col("sd")).alias("z"))
    index = (scored.where(F.col("n") >= min_values).join(F.broadcast(sign), "metric")
             .groupBy("period", "period_ts").agg(F.avg(F.col("sign") * F.col("z")).alias("systemic_stress_index")))
    banks = long.select("period", "period_ts", "bank_id").distinct().groupBy("period", "period_ts").agg(
        F.count(F.lit(1)).alias("n_banks"))
    return small_pct_rank(banks.join(index, ["period", "period_ts"], "left"), "systemic_stress_index",
                          "systemic_stress_pct")


def high_risk_flag(stress: DataFrame, threshold: float | None = None) -> DataFrame:
    pct = (config.MODEL["high_risk"]["systemic_stress_pct"] * 100) if threshold is None else threshold
    return stress.select("*", F.coalesce((F.col("systemic_stress_pct") >= pct).cast("int"), F.lit(0)).alias("high_risk_period_flag"))


def period_breadth(wide: DataFrame, signs: dict[str, int] | None = None) -> DataFrame:
    """Per period: mean over banks of the share of watched metrics that worsened since the last row."""
    signs = {m: s for m, s in (signs or config.WATCH_METRICS).items() if m in wide.columns}
    w = Window.partitionBy("bank_id").orderBy("period_ts")
    moves = wide.select("bank_id", "period", "period_ts",
                        *[((F.col(m) - F.lag(m).over(w)) * s).alias(m) for m, s in signs.items()])
    zero: Column = F.lit(0)
    worse = sum((F.when(F.col(m) > 0, 1).otherwise(0) for m in signs), zero)
    known = sum((F.when(F.col(m).isNotNull(), 1).otherwise(0) for m in signs), zero)
    share = F.when(known > 0, worse / known).otherwise(0.0)
    per_bank = moves.select("bank_id", "period", "period_ts", share.alias("s"))
    return per_bank.groupBy("period", "period_ts").agg(F.avg("s").alias("mean_worsen_share"),
                                                       F.countDistinct("bank_id").alias("n_banks"))
