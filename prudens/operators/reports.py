"""Report and dashboard queries over the result tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prudens.functions.numeric import half_up
from prudens.functions.reshape import to_long
from prudens.operators.ews import latest as ews_latest_rows
from prudens.operators.scoring import KEY
from prudens.operators.stress import at_snapshot

DOMAINS = {"credit": "credit_risk_score", "liquidity": "liquidity_risk_score", "fraud": "fraud_risk_proxy_score", "failure": "failure_risk_proxy_score"}
# Display order of severities.
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "DATA_GAP": 4}


def severity_rank(c: Column) -> Column:
    out = F.lit(9)
    for s, i in SEVERITY_RANK.items():
        out = F.when(c == s, i).otherwise(out)
    return out


def executive_summary(scores: DataFrame, findings: DataFrame, anomalies: DataFrame, periods: DataFrame, ews_table: DataFrame,
                      ews_system: DataFrame, stress_summary: DataFrame) -> DataFrame:
    """One row of headline figures; every part is a one-row aggregate."""
    parts = [
        scores.agg(F.countDistinct("bank_id").alias("n_banks"), F.countDistinct("period").alias("n_periods"),
                   F.countDistinct(F.when(F.col("risk_level") == "CRITICAL", F.col("bank_id"))).alias("n_critical_banks")),
        findings.agg(F.count_if(F.col("finding_type") == "VIOLATION").alias("n_violations")),
        anomalies.agg(F.sum("anomaly_label").alias("n_anomalies")),
        periods.agg(F.count_if(F.col("is_high_risk")).alias("n_high_risk_periods")),
        ews_latest_rows(ews_table).agg(F.count_if(F.col("ews_level") == "ALARM").alias("ews_alarm"), F.count_if(F.col("ews_level") == "WARNING").alias("ews_warning")),
        ews_system.agg(F.max_by("system_level", "period_ts").alias("ews_system_level")),
        stress_summary.where("scenario_id = 'severe'").agg(F.max("n_fail_capital").alias("severe_n_fail_capital"),
                                                          F.max("total_capital_shortfall").alias("severe_shortfall"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def top_risk_banks(ranking: DataFrame, n: int = 10) -> DataFrame:
    cols = ["bank_id", "bank_name", "period", "final_risk_score", "risk_level", *DOMAINS.values(), "cluster_risk_label", "worst_rule_severity"]
    return ranking.select(*[c for c in cols if c in ranking.columns]).orderBy(F.desc("final_risk_score"), "bank_id").limit(n)


def critical_breaches(findings: DataFrame) -> DataFrame:
    return findings.where("severity = 'CRITICAL' and finding_type = 'VIOLATION'").orderBy("bank_id", "period", "rule_id")


def top_anomalies(anomalies: DataFrame, n: int = 20) -> DataFrame:
    return anomalies.orderBy(F.desc_nulls_last("anomaly_score"), *KEY).limit(n)


def high_risk_list(periods: DataFrame) -> DataFrame:
    return periods.where("is_high_risk").select("period", "period_risk_score", "risk_domains", "reason", "recommended_audit_focus")


def domain_top(ranking: DataFrame, domain: str, n: int = 10) -> DataFrame:
    col = DOMAINS[domain]
    return ranking.select("bank_id", "period", col).orderBy(F.desc_nulls_last(col), "bank_id").limit(n)


def critical_banks(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """CRITICAL bank-periods with their breaches in rule order, else the model anomaly, else the score."""
    value = F.coalesce(half_up("metric_value", 2).cast("string"), F.lit(""))
    text = F.concat("rule_id", F.lit(" ("), "metric", F.lit("="), value, F.lit(")"))
    hits = findings.where("severity = 'CRITICAL' and finding_type = 'VIOLATION'").groupBy(*KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", text.alias("t")))), lambda x: x["t"]), "; ").alias("_t"))
    crit = scores.where("risk_level = 'CRITICAL'").join(hits, KEY, "left")
    model = F.when(F.col("anomaly_label") == 1, F.concat(F.lit("model anomaly (score "), half_up("anomaly_score_norm", 2).cast("string"), F.lit(")")))
    return crit.select("bank_id", "period", "final_risk_score", F.coalesce("_t", model, F.lit("high composite score")).alias("reason"))


def stress_capital(results: DataFrame, features: DataFrame, scenario: str = "severe", n: int = 30) -> DataFrame:
    snap = at_snapshot(results.where((F.col("scenario_id") == scenario) & (F.col("capital_status") == "OK")), features)
    return snap.select("bank_id", "scenario_name", "baseline_car", "stressed_car", "car_delta", "capital_shortfall", "passes_capital").orderBy("stressed_car", "bank_id").limit(n)


def stress_breaking(points: DataFrame, features: DataFrame, n: int = 30) -> DataFrame:
    return at_snapshot(points, features).where("breaking_npl_pp is not null").orderBy("breaking_npl_pp", "bank_id").limit(n)


def heatmap(scores: DataFrame, periods: list[str]) -> DataFrame:
    return scores.groupBy("bank_id").agg(*[F.expr(f"max(case when period = '{p}' then final_risk_score end) as `{p}`") for p in periods])


def domain_means(ranking: DataFrame) -> DataFrame:
    """Mean of each domain over the banks assessed in it; scores have two decimals, summed as cents."""
    mean = lambda c: half_up(F.sum(F.floor(F.col(c) * 100 + 0.5)) / F.count(c) / 100.0, 2)
    return ranking.agg(*[mean(c).alias(d) for d, c in DOMAINS.items()])


def counts_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def findings_newest_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc_nulls_last("period"), severity_rank(F.col("severity")), "bank_id", "rule_id")


def bank_series(features: DataFrame, metrics: list[str]) -> DataFrame:
    """Per bank: periods in order and one array per metric; a bank's history is bounded by the calendar."""
    keep = [m for m in metrics if m in features.columns]
    rows = F.array_sort(F.collect_list(F.struct("period_ts", "period", *keep)))
    s = features.groupBy("bank_id").agg(rows.alias("s"))
    pick = lambda name: F.transform("s", lambda x: x[name]).alias(name if name != "period" else "periods")
    return s.select("bank_id", pick("period"), *[pick(m) for m in keep])


def period_picker(df: DataFrame) -> DataFrame:
    """Distinct periods with kind, year and sub-period."""
    p = F.col("period")
    kind = (F.when(p.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(p.rlike(r"^\d{4}-\d{2}$"), "month")
            .when(p.rlike(r"^\d{4}Q[1-4]$"), "quarter").otherwise("year"))
    out = df.select("period").where("period is not null").distinct().withColumn("kind", kind)
    sub = F.when(F.col("kind") == "month", F.substring("period", 6, 2).cast("int")).when(F.col("kind") == "quarter", F.substring("period", 6, 1).cast("int"))
    return out.select("period", "kind", F.regexp_extract("period", r"(\d{4})", 1).try_cast("int").alias("year"), sub.alias("sub")).orderBy("period")


def filter_findings(findings: DataFrame, bank_id=None, period=None, rule_name=None, metric=None, severity=None, finding_type=None,
                    legal_source=None, min_value=None, max_value=None) -> DataFrame:
    """Any combination of filters: lists for bank and severity, case-insensitive contains for texts, a value range."""
    as_list = lambda x: [v.strip() for v in x.split(",") if v.strip()] if isinstance(x, str) else list(x)
    df = findings
    if bank_id:
        df = df.where(F.col("bank_id").isin(as_list(bank_id)))
    if severity:
        df = df.where(F.col("severity").isin([s.upper() for s in as_list(severity)]))
    for col, v in (("period", period), ("metric", metric), ("finding_type", finding_type)):
        if v:
            df = df.where(F.col(col) == v)
    for col, v in (("rule_name", rule_name), ("legal_source", legal_source)):
        if v:
            df = df.where(F.lower(col).contains(v.lower()))
    if min_value is not None:
        df = df.where(F.col("metric_value") >= float(min_value))
    if max_value is not None:
        df = df.where(F.col("metric_value") <= float(max_value))
    return df


def filter_options(findings: DataFrame, cols=("bank_id", "period", "rule_id", "metric", "severity", "finding_type")) -> DataFrame:
    """Distinct values per column as rows: one pass, and no set is gathered in one place."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("option")) for c in cols])
    return findings.select(F.explode(cells).alias("c")).select("c.*").where("option is not null and option <> ''").distinct()


def panel_query(panel: DataFrame, bank_id=None, period=None, frequency=None, limit: int | None = None) -> DataFrame:
    df = panel
    for col, v in (("bank_id", bank_id), ("period", period), ("frequency", frequency)):
        if v:
            df = df.where(F.col(col) == v)
    return df.limit(limit) if limit else df


def equivalent_periods(period: str) -> list[str]:
    """A period with its coarser or finer equivalents, best first."""
    if len(period) == 7 and period[4] == "-":
        return [period, f"{period[:4]}Q{(int(period[5:]) + 2) // 3}", period[:4]]
    if "Q" in period:
        year, q = period.split("Q")
        return [period, f"{year}-{int(q) * 3:02d}", year]
    return [period, f"{period}-12", f"{period}Q4"] if period.isdigit() and len(period) == 4 else [period]


def value_at_period(long: DataFrame, metric: str, period: str) -> DataFrame:
    """Per bank: the metric at a period, at an equivalent period, else the last value of the same year."""
    order = equivalent_periods(period)
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(order))):
        rank = F.when(F.col("period") == p, i).otherwise(rank)
    same_year = F.col("period").startswith(period[:4])
    rows = long.where((F.col("metric") == metric) & F.col("value").isNotNull() & (F.col("period").isin(order) | same_year))
    rows = rows.withColumn("_o", F.struct(F.coalesce(rank, F.lit(len(order))).alias("r"), (-F.datediff("period_ts", F.lit("1970-01-01"))).alias("d")))
    return rows.groupBy("bank_id").agg(F.min_by("value", "_o").alias("value"), F.min_by("period", "_o").alias("found_period"))


def not_evaluated(long: DataFrame, metric: str, period: str) -> DataFrame:
    """Banks without any usable value of the metric for the period."""
    return long.select("bank_id").distinct().join(value_at_period(long, metric, period).select("bank_id"), "bank_id", "left_anti")


def above_limits(values: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """How many banks are beyond each metric's limit: ``{metric: (">" or "<", limit)}`` over wide rows."""
    cond = lambda m, op, v: F.count_if(F.col(m) > v if op == ">" else F.col(m) < v)
    row = values.agg(*[cond(m, op, v).alias(m) for m, (op, v) in limits.items()])
    return to_long(row, [], list(limits)).select("metric", F.col("value").cast("bigint").alias("n_beyond"))


def missing_by_metric(panel: DataFrame) -> DataFrame:
    """Cells missing per metric against the full bank x period grid of its frequency, by real counts."""
    grid = panel.groupBy("frequency").agg(F.countDistinct("bank_id").alias("b"), F.countDistinct("period").alias("p")).select(
        "frequency", (F.col("b") * F.col("p")).alias("n_total"))
    seen = panel.select("frequency", "metric_name", "bank_id", "period").distinct().groupBy("frequency", "metric_name").agg(F.count(F.lit(1)).alias("n"))
    out = seen.join(F.broadcast(grid), "frequency")
    missing = F.greatest(F.col("n_total") - F.col("n"), F.lit(0))
    return out.where(F.col("n_total") > F.col("n")).select("frequency", F.col("metric_name").alias("metric"), missing.alias("n_missing"), "n_total",
                                                           half_up(missing / F.col("n_total") * 100, 2).alias("missing_pct"))
