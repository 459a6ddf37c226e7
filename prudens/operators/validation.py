"""Data-quality findings ``(category, severity, bank_id, period, metric, message)``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prudens import config
from prudens.functions import sqltext
from prudens.functions.numeric import fixed2
from prudens.functions.reshape import to_long
from prudens.functions.tables import literal_table
from prudens.operators.redflags import red_flags
from prudens.sources import settings

FINDING = ["category", "severity", "bank_id", "period", "metric", "message"]


def _finding(df: DataFrame, category: str, severity, message: Column, bank=True, period=True, metric=True) -> DataFrame:
    pick = lambda name, on: F.col(name) if on else F.lit(None).cast("string")
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(category).alias("category"), severity.alias("severity"), pick("bank_id", bank).alias("bank_id"),
                     pick("period", period).alias("period"), pick("metric", metric).alias("metric"), message.alias("message"))


def duplicates(panel: DataFrame) -> DataFrame:
    many = (panel.groupBy("bank_id", "frequency", "period", F.col("metric_name").alias("metric"))
            .agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return _finding(many, "DUPLICATE", "MEDIUM", F.concat(F.lit("duplicate record ("), "frequency", F.lit(")")))


def _series(panel: DataFrame) -> DataFrame:
    return panel.select("bank_id", "frequency", "period", "period_ts").where("period_ts is not null").distinct()


def short_history(panel: DataFrame, min_periods: int = 3) -> DataFrame:
    n = (panel.select("bank_id", "frequency", "period", "period_ts").distinct().groupBy("bank_id", "frequency")
         .agg(F.countDistinct(F.when(F.col("period_ts").isNotNull(), F.col("period"))).alias("n")))
    return _finding(n.where(F.col("n") < min_periods), "SHORT_HISTORY", "HIGH",
                    F.concat(F.lit("short history: "), F.col("n").cast("string"), F.lit(" periods, "), "frequency"),
                    period=False, metric=False)


def missing_periods(panel: DataFrame, min_periods: int = 3, listed: int | None = None) -> DataFrame:
    """Calendar steps between a series' first and last period that have no record.

    All gaps are findings; a report that shows only the first of each series passes ``listed``.
    """
    step = F.when(F.col("frequency") == "monthly", 1).when(F.col("frequency") == "quarterly", 3).when(F.col("frequency") == "yearly", 12)
    month = lambda c: F.year(c) * 12 + F.month(c) - 1
    seen = _series(panel).withColumn("step", step).where("step is not null").select(
        "bank_id", "frequency", "step", "period", month(F.col("period_ts")).alias("m"))
    span = seen.groupBy("bank_id", "frequency", "step").agg(
        F.min("m").alias("lo"), F.max("m").alias("hi"), F.countDistinct("period").alias("n")).where(F.col("n") >= min_periods)
    # a series' expected steps are bounded by its calendar span
    expected = span.select("bank_id", "frequency", "step", F.explode(F.expr("sequence(lo, hi, step)")).alias("m"))
    yearly = F.col("frequency") == "yearly"
    slot = lambda c: F.when(yearly, F.floor(c / 12)).otherwise(c).cast("int")
    gaps = expected.withColumn("slot", slot(F.col("m"))).join(
        seen.select("bank_id", "frequency", slot(F.col("m")).alias("slot")).distinct(), ["bank_id", "frequency", "slot"], "left_anti")
    name = F.when(yearly, F.floor(F.col("m") / 12).cast("string")).otherwise(
        F.concat(F.floor(F.col("m") / 12).cast("string"), F.lit("-"), F.lpad((F.col("m") % 12 + 1).cast("string"), 2, "0")))
    out = gaps.select("bank_id", "frequency", "m", name.alias("period"))
    if listed is not None:
        order = Window.partitionBy("bank_id", "frequency").orderBy("m")
        out = out.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= listed)
    return _finding(out, "MISSING_PERIOD", "MEDIUM", F.concat(F.lit("no report ("), "frequency", F.lit(") around "), "period"), metric=False)


def _checked(features: DataFrame, metrics) -> DataFrame:
    return to_long(features, ["bank_id", "period"], [m for m in metrics if m in features.columns], keep_null=False)


def negatives(features: DataFrame, metrics=None) -> DataFrame:
    bad = _checked(features, metrics or config.NON_NEGATIVE).where("value < 0")
    return _finding(bad, "NEGATIVE", "HIGH", F.concat("metric", F.lit(" negative: "), fixed2("value")))


def out_of_range(features: DataFrame, ranges=None) -> DataFrame:
    ranges = ranges or config.PLAUSIBLE_RANGES
    table = literal_table(features.sparkSession, "metric string, lo double, hi double",
                          [(m, float(lo), float(hi)) for m, (lo, hi) in ranges.items()])
    bad = _checked(features, ranges).join(F.broadcast(table), "metric").where("value < lo or value > hi")
    return _finding(bad, "OUT_OF_RANGE", "MEDIUM", F.concat("metric", F.lit("="), fixed2("value"), F.lit(" outside its plausible range")))


def legal_scope(spark, flat=None, tiered=None, tiers=None) -> DataFrame:
    """Metric of a CRITICAL rule to the institution types it binds; null types bind everyone."""
    flat = settings.flat_rules(spark, flat).where("severity = 'CRITICAL'").select("metric", F.lit(None).cast("string").alias("type"))
    by_type = (settings.tiered_rules(spark, tiered).where("severity = 'CRITICAL'").select("rule_id", "metric")
               .join(settings.rule_tiers(spark, tiers), "rule_id").select("metric", "type"))
    every = flat.unionByName(by_type).groupBy("metric").agg(
        F.count_if(F.col("type").isNull()).alias("n_flat"), F.array_sort(F.collect_set("type")).alias("types"))
    return every.select("metric", F.when(F.col("n_flat") == 0, F.col("types")).alias("types"))


def missing_legal_metrics(features: DataFrame, scope: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Legally required metrics no column (or no row of a panel's ``reported`` metrics) carries."""
    absent = (scope.where(~F.col("metric").isin(list(features.columns))) if reported is None
              else scope.join(reported, "metric", "left_anti"))
    return _finding(absent, "MISSING_LEGAL_METRIC", "HIGH", F.concat(F.lit("legal metric absent: "), "metric"), bank=False, period=False)


def legal_data_gaps(features: DataFrame, scope: DataFrame, inst: DataFrame, metrics: list[str]) -> DataFrame:
    """Banks missing a legally required metric in at least half (HIGH) or 80 % (CRITICAL) of periods,
    if the requirement covers their institution type."""
    long = to_long(features, ["bank_id"], [m for m in metrics if m in features.columns])
    share = long.groupBy("bank_id", "metric").agg(F.avg(F.col("value").isNull().cast("double")).alias("share")).where("share >= 0.5")
    bound = share.join(F.broadcast(scope), "metric").join(inst.select("bank_id", "type"), "bank_id", "left").where(
        F.col("types").isNull() | F.array_contains("types", F.col("type")))
    return _finding(bound, "DATA_GAP_LEGAL", F.when(F.col("share") >= 0.8, "CRITICAL").otherwise("HIGH"),
                    F.concat(F.lit("missing in "), F.floor(F.col("share") * 100 + 0.5).cast("string"), F.lit("% of periods: "), "metric"), period=False)


def ratios_not_evaluated(gaps: DataFrame) -> DataFrame:
    """Dropped ratios per bank and metric with all their periods, which the calendar bounds."""
    per = gaps.groupBy("bank_id", "metric", "period").agg(F.count(F.lit(1)).alias("k"))
    grouped = per.groupBy("bank_id", "metric").agg(
        F.sum("k").alias("n"), F.array_join(F.array_sort(F.collect_list("period")), ", ").alias("shown"))
    text = F.concat(F.lit("not evaluated in "), F.col("n").cast("string"), F.lit(" periods ("), "shown", F.lit(")"))
    return _finding(grouped, "RATIO_NOT_EVALUATED", "INFO", text, period=False)


def high_missing_periods(features: DataFrame, cols: list[str], threshold: float = 0.6) -> DataFrame:
    rows = features.selectExpr("bank_id", "period", f"{sqltext.share_null(cols)} as share").where(F.col("share") >= threshold)
    return _finding(rows, "HIGH_MISSING_PERIOD", "MEDIUM",
                    F.concat(F.lit("missing "), F.floor(F.col("share") * 100 + 0.5).cast("string"), F.lit("% of metrics")), metric=False)


def validate_panel(panel: DataFrame) -> DataFrame:
    return duplicates(panel).unionByName(short_history(panel)).unionByName(missing_periods(panel))


def run_all(panel: DataFrame, features: DataFrame, inst: DataFrame, gaps: DataFrame, metrics: list[str]) -> DataFrame:
    """Every layer as one table of findings."""
    spark = features.sparkSession
    scope = legal_scope(spark)
    legal = [r[5] for r in [*config.FLAT_RULES, *config.TIERED_RULES]]
    parts = [validate_panel(panel), negatives(features), out_of_range(features), missing_legal_metrics(features, scope),
             legal_data_gaps(features, scope, inst, sorted(set(legal))), ratios_not_evaluated(gaps),
             high_missing_periods(features, metrics), red_flags(features)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
