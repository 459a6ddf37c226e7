"""Early-warning signals per bank-period.

Signals of a metric look only at its valid history: values present and plausible. Valid rows are
numbered in a window of their own, their last signals are carried to periods without a new
value, and everything runs on one shuffle by bank.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prudens import config
from prudens.functions.numeric import fixed2, half_up
from prudens.functions.reshape import to_long
from prudens.functions.tables import literal_table
from prudens.operators.cluster import latest_snapshot

RANKS = ["NORMAL", "WATCH", "WARNING", "ALARM"]
SIGNALS = ["proximity", "trend", "acceleration", "volatility", "breach_streak"]


def metric_table(spark, metrics=None) -> DataFrame:
    ddl = ("metric string, label string, direction string, lim double, buffer double, domain string, weight double, "
           "lo double, hi double, ord int")
    rows = [(*m, i) for i, m in enumerate(config.EWS_METRICS if metrics is None else metrics)]
    return literal_table(spark, ddl, rows)


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _slope_weights(back: int, size: int, look: int) -> list[float]:
    """What each of the last ``look`` values, newest first, gives to the slope of ``size`` values that end ``back`` before the newest."""
    at = {back + k: (size - 1) / 2 - k for k in range(size)}
    return [12.0 * at.get(k, 0.0) / (size * (size * size - 1)) for k in range(look)]


def _dot(tables: list[list[float]], n: Column, values: list[Column]) -> Column:
    """Sum of values by the weights of window size ``n``."""
    w = F.get(F.array(*[F.array(*[F.lit(x) for x in t]) for t in tables]), n - 1)
    return sum((F.get(w, F.lit(k)) * v for k, v in enumerate(values)), F.lit(0.0))


def metric_signals(features: DataFrame, metrics=None, params: dict | None = None) -> DataFrame:
    """Long ``(ids, metric, signals…)`` of every period, from the metric's valid history so far."""
    p = {**config.EWS, **(params or {})}
    spec = config.EWS_METRICS if metrics is None else metrics
    look, horizon = p["lookback"], p["horizon"]
    present = [m[0] for m in spec if m[0] in features.columns]
    long = to_long(features, config.ID_COLS, present, cluster_by=["bank_id"])
    v, c = F.col("value"), F.col
    df = long.join(F.broadcast(metric_table(features.sparkSession, spec)), "metric")
    df = df.select("*", F.coalesce((v >= c("lo")) & (v <= c("hi")), F.lit(False)).alias("valid"))
    g = Window.partitionBy("bank_id", "metric", "valid").orderBy("period_ts")
    upto = g.rowsBetween(Window.unboundedPreceding, 0)
    # a window's values are read once, as differences to the current one: sums over them are exactly 0 if all are equal
    df = df.select("*", F.row_number().over(g).alias("rn"), F.stddev_pop(v).over(upto).alias("_sd_all"), *[F.coalesce(F.lag(v, k).over(g) - v, F.lit(0.0)).alias(f"_d{k}") for k in range(1, look)])
    n, off, none = F.least(c("rn"), F.lit(look)), [c(f"_d{k}") for k in range(1, look)], [0.0] * look
    sizes = range(1, look + 1)
    slopes = [_slope_weights(0, k, look) if k > 1 else none for k in sizes]
    # slope of the values from n//2 on less that of the first n//2 + 1
    bends = [[b - a for a, b in zip(_slope_weights(k - 1 - k // 2, k // 2 + 1, look), _slope_weights(0, k - k // 2, look), strict=True)] if k >= 4 else none for k in sizes]
    mean = sum(off, F.lit(0.0)) / n
    spread = sum((d * d for d in off), F.lit(0.0)) / n - mean * mean
    df = df.select(*df.columns[:-len(off)], n.alias("n"), F.when(n > 1, _dot([t[1:] for t in slopes], n, off)).alias("_slope"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("_sd"),
                   F.when(n >= 4, _dot([t[1:] for t in bends], n, off)).alias("_bend"))
    safe_high = c("direction") == "higher_safer"
    adverse = F.when(safe_high, -c("_slope")).otherwise(c("_slope"))
    swing = F.when(safe_high, -c("_bend")).otherwise(c("_bend"))
    inside = F.when(safe_high, v <= c("lim") + c("buffer")).otherwise(v >= c("lim") - c("buffer"))
    df = df.select("*", adverse.alias("_adv"), swing.alias("_swing"), inside.alias("_in"),
                   F.greatest(c("buffer"), F.when(c("_sd") != 0, c("_sd")).otherwise(c("buffer")), F.lit(1e-9)).alias("_scale"),
                   F.when(safe_high, v < c("lim")).otherwise(v > c("lim")).alias("_breached"),
                   F.when(safe_high, v - c("lim")).otherwise(c("lim") - v).alias("_dist"))
    last_out = F.last(F.when(~c("_in"), c("rn")), ignorenulls=True).over(upto)
    enough = c("n") >= p["min_points"]
    proximity = F.when(safe_high, (c("lim") + c("buffer") - v) / c("buffer")).otherwise((v - (c("lim") - c("buffer"))) / c("buffer"))
    projected = F.when(enough & ~c("_breached") & (c("_adv") > 1e-9) & (c("_dist") > 0),
                       F.least(F.lit(horizon + 1.0), c("_dist") / c("_adv")))
    signals = F.struct(
        v.alias("value"), _unit(proximity).alias("proximity"),
        F.when(enough, _unit(c("_adv") * c("n") / c("_scale"))).otherwise(0.0).alias("trend"),
        F.when(enough & c("_swing").isNotNull(), _unit(c("_swing") * c("n") / c("_scale"))).otherwise(0.0).alias("acceleration"),
        F.when(enough & (c("rn") >= 4), _unit(c("_sd") / F.when(c("_sd_all") != 0, c("_sd_all")).otherwise(1e-9) - 1.0)).otherwise(0.0).alias("volatility"),
        (F.least(c("rn") - F.coalesce(last_out, F.lit(0)), F.lit(look)) / F.lit(float(look))).alias("breach_streak"),
        c("_breached").alias("breached"), projected.alias("projected"))
    df = df.select(*config.ID_COLS, "metric", "label", "domain", "weight", "ord", "valid", F.when(c("valid"), signals).alias("_s"))
    carry = Window.partitionBy("bank_id", "metric").orderBy("period_ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*config.ID_COLS, "metric", "label", "domain", "weight", "ord", "valid",
                     F.last("_s", ignorenulls=True).over(carry).alias("_s")).select(
        *config.ID_COLS, "metric", "label", "domain", "weight", "ord", "valid", "_s.*")


def anomaly_persistence(features: DataFrame, labels: DataFrame, lookback: int | None = None) -> DataFrame:
    """Share of a bank's last rows that were labelled anomalous; a missing label counts as 0."""
    look = lookback or config.EWS["lookback"]
    w = Window.partitionBy("bank_id").orderBy("period_ts").rowsBetween(-(look - 1), 0)
    rows = features.select("bank_id", "period", "period_ts").join(labels.select("bank_id", "period", "anomaly_label"), ["bank_id", "period"], "left")
    return rows.select("bank_id", "period", F.avg(F.coalesce("anomaly_label", F.lit(0)).cast("double")).over(w).alias("anomaly_persistence"))


def _level_rank(score: Column, levels) -> Column:
    out = None
    for limit, name in levels:
        rank = F.lit(RANKS.index(name))
        if limit is None:
            return out.otherwise(rank)
        out = F.when(score <= limit, rank) if out is None else out.when(score <= limit, rank)
    return out


def label_text(level: Column, labels: dict | None = None) -> Column:
    out = level
    for k, text in (labels or config.EWS["labels"]).items():
        out = F.when(level == k, text).otherwise(out)
    return out


def ews_table(features: DataFrame, labels: DataFrame | None = None, metrics=None, params: dict | None = None) -> DataFrame:
    """Score, level, signals, drivers and projection of every bank-period with any valid metric."""
    p = {**config.EWS, **(params or {})}
    c = F.col
    sig = metric_signals(features, metrics, p)
    known = c("value").isNotNull()
    wsum = F.sum(F.when(known, c("weight")))
    strength = F.greatest("proximity", "trend", "breach_streak")
    agg = sig.groupBy(*config.ID_COLS).agg(
        *[(F.sum(c(s) * c("weight")) / wsum).alias(f"_{s}") for s in SIGNALS], F.max("proximity").alias("_prox_max"),
        F.count_if(known & (c("proximity") > 0)).alias("n_in_buffer"), F.count_if(c("breached")).alias("n_breached"),
        F.count_if(~known).alias("n_data_gap"), F.count_if(known).alias("_n"),
        F.min("projected").alias("_proj"), F.min_by("label", F.when(c("projected").isNotNull(), F.struct("projected", "ord"))).alias("_proj_label"),
        F.array_sort(F.collect_set(F.when((c("proximity") > 0.3) | (c("trend") > 0.3), c("domain")))).alias("_domains"),
        # bounded by the configured metrics
        F.array_sort(F.collect_list(F.when(known, F.struct((-strength).alias("s"), "ord", "label", "value", "proximity", "trend")))).alias("_d"))
    agg = agg.where("_n > 0")
    if labels is None:
        agg = agg.withColumn("_persist", F.lit(0.0))
    else:
        pers = anomaly_persistence(features, labels, p["lookback"]).withColumnRenamed("anomaly_persistence", "_persist")
        agg = agg.join(pers, ["bank_id", "period"], "left").withColumn("_persist", F.coalesce("_persist", F.lit(0.0)))
    w = p["signal_weights"]
    prox = 0.6 * c("_prox_max") + 0.4 * c("_proximity")
    score = F.lit(100.0) * (w["proximity"] * prox + w["trend"] * c("_trend") + w["acceleration"] * c("_acceleration")
                            + w["volatility"] * c("_volatility") + w["breach_streak"] * c("_breach_streak")
                            + w["anomaly_persistence"] * c("_persist"))
    df = agg.select("*", prox.alias("_prox"), F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)).alias("_score"))
    breached = c("n_breached") > 0
    rank = F.greatest(
        _level_rank(c("_score"), p["levels"]), F.when(c("n_in_buffer") > 0, p["near_rank"]).otherwise(0),
        F.when(breached, p["breached_rank"]).otherwise(0),
        F.when(breached & (c("_trend") >= p["adverse_trend"]), p["breached_worsening_rank"]).otherwise(0),
        F.when(c("_proj") <= p["projected_periods"], p["projected_rank"]).otherwise(0))
    text = lambda d: F.concat(d["label"], F.lit("="), fixed2(d["value"]), F.lit(" (prox "), fixed2(d["proximity"]), F.lit(", trend "), fixed2(d["trend"]), F.lit(")"))
    pct = lambda x, name: half_up(x * 100, 1).alias(name)
    df = df.select("*", rank.alias("level_rank")).select(
        *config.ID_COLS, half_up("_score", 1).alias("ews_score"), F.get(F.array(*[F.lit(r) for r in RANKS]), c("level_rank")).alias("ews_level"),
        "level_rank", pct(c("_prox"), "sig_proximity"), pct(c("_trend"), "sig_trend"), pct(c("_acceleration"), "sig_acceleration"),
        pct(c("_volatility"), "sig_volatility"), pct(c("_breach_streak"), "sig_breach_streak"), pct(c("_persist"), "sig_anomaly_persistence"),
        c("_proj_label").alias("projected_breach_metric"), F.when(c("_proj") <= p["horizon"], half_up("_proj", 1)).alias("projected_periods_to_breach"),
        F.array_join("_domains", ", ").alias("risk_domains"), F.array_join(F.transform(F.slice("_d", 1, 3), text), "; ").alias("drivers"),
        "n_in_buffer", "n_breached", "n_data_gap")
    back = Window.partitionBy("bank_id").orderBy("period_ts")
    df = df.select("*", label_text(c("ews_level"), p["labels"]).alias("ews_label"), F.lag("ews_score").over(back).alias("prev_score"),
                   F.lag("level_rank").over(back).alias("prev_level_rank"))
    return df.select("*", half_up(c("ews_score") - c("prev_score"), 1).alias("score_delta"),
                     F.coalesce(c("level_rank") > c("prev_level_rank"), F.lit(False)).alias("escalating"))


def latest(table: DataFrame) -> DataFrame:
    return latest_snapshot(table)


def system_timeline(table: DataFrame, params: dict | None = None) -> DataFrame:
    """Per period: mean score, counts by level, system level, change of the mean.

    Scores have one decimal, so their tenths are summed as integers: exact in any order.
    """
    p = {**config.EWS, **(params or {})}
    agg = table.groupBy("period", "period_ts").agg(
        (F.sum(F.floor(F.col("ews_score") * 10 + 0.5)) / F.count(F.lit(1)) / 10.0).alias("_mean"), F.count(F.lit(1)).alias("n_banks"), F.count_if(F.col("ews_level") == "ALARM").alias("n_alarm"),
        F.count_if(F.col("ews_level") == "WARNING").alias("n_warning"), F.count_if(F.col("level_rank") >= 2).alias("n_warning_plus"))
    share = F.col("n_warning_plus") / F.col("n_banks")
    level = (F.when(share >= p["warn_share_alarm"], "ALARM").when(share >= p["warn_share_warning"], "WARNING")
             .when(F.col("_mean") >= p["watch_mean"], "WATCH").otherwise("NORMAL"))
    out = agg.select("period", "period_ts", half_up("_mean", 1).alias("mean_ews"), "n_banks", "n_alarm", "n_warning", "n_warning_plus",
                     half_up(share * 100, 1).alias("share_warning_plus"), level.alias("system_level"))
    calendar = Window.partitionBy(F.lit(0)).orderBy("period_ts")  # one row per period
    return out.select("*", label_text(F.col("system_level"), p["labels"]).alias("system_label"),
                      half_up(F.col("mean_ews") - F.lag("mean_ews").over(calendar), 1).alias("mean_ews_mom"))


def emerging(latest_rows: DataFrame, params: dict | None = None) -> DataFrame:
    p = {**config.EWS, **(params or {})}
    hit = (F.coalesce("score_delta", F.lit(0.0)) >= p["score_jump"]) | F.col("escalating")
    return latest_rows.where(hit).orderBy(F.desc_nulls_last("score_delta"), "bank_id")


def trajectory(table: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """Bank by period score. Given periods become columns; otherwise one sorted array per bank."""
    if periods:
        return table.groupBy("bank_id").agg(*[F.max(F.when(F.col("period") == x, F.col("ews_score"))).alias(x) for x in periods])
    series = F.array_sort(F.collect_list(F.struct("period_ts", "period", "ews_score")))
    return table.groupBy("bank_id").agg(series.alias("s")).select(
        "bank_id", F.transform("s", lambda x: x["period"]).alias("periods"), F.transform("s", lambda x: x["ews_score"]).alias("scores"))
