"""Composite risk score of every bank-period and its parts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prudens import config
from prudens.functions import sqltext
from prudens.functions.numeric import clip, half_up
from prudens.functions.reshape import ensure_columns, to_long, to_wide
from prudens.functions.ranks import Positions
from prudens.functions.tables import literal_table
from prudens.operators.cluster import latest_snapshot
from prudens.operators.crosssection import pct_ranks
from prudens.operators.rules import worst_severity
from prudens.operators.trends import wide_trends
from prudens.plans.staging import stage

KEY = ["bank_id", "period"]
RANKED = ["mlt_loan_ratio", "provision_to_loans", "credit_cost_ratio", "risky_sector_ratio", "real_estate_loan_ratio",
          "unsecured_loan_ratio", "large_borrower_ratio", "largest_customer_group_ratio", "accrued_interest_to_loans",
          "offbalance_to_assets", "casa", "wholesale_funding_share", "liquid_assets_to_deposits"]
LEVEL_INPUTS = ["npl_ratio", "group2_ratio", "llr_coverage", "credit_growth_yoy", "bad_offbalance_ratio", "car_solo",
                "equity_to_assets", "ldr", "st_funding_for_mlt_loans", "liquidity_reserve_ratio", "avg_liquid_asset_ratio",
                "solvency_30d_vnd", "rate_sensitive_gap_ratio", "fx_position_ratio", "solvency_30d_fx",
                "accrued_interest_days", "roa"]
COMPONENTS = ["rule_violation_score", "anomaly_score_norm", "trend_risk_score", "cluster_risk_score",
              "data_quality_risk_score", "systemic_period_risk_score"]


def points(severity: Column, table: dict[str, float], default: float = 0.0) -> Column:
    out = F.lit(float(default))
    for s, p in table.items():
        out = F.when(severity == s, F.lit(float(p))).otherwise(out)
    return out


def mandatory_rules(flat=None, tiered=None) -> list[str]:
    """Rules that force CRITICAL when violated: CRITICAL and ACTIVE."""
    flat = config.FLAT_RULES if flat is None else flat
    tiered = config.TIERED_RULES if tiered is None else tiered
    return [r[0] for r in flat if r[9] == "CRITICAL" and r[10] == "ACTIVE"] + [r[0] for r in tiered if r[7] == "CRITICAL" and r[8] == "ACTIVE"]


def rule_violation_score(findings: DataFrame, mandatory: list[str] | None = None, model: dict | None = None) -> DataFrame:
    """Per bank-period: severest points overall and by domain, worst severity, mandatory breach, counts."""
    m = model or config.MODEL
    s, pts = F.col("severity"), points(F.col("severity"), m["severity_points"])
    domain = lambda d: F.coalesce(F.max(F.when(F.col("risk_domain") == d, pts)), F.lit(0.0))
    must = mandatory_rules() if mandatory is None else mandatory
    return findings.where("bank_id is not null and period is not null").groupBy(*KEY).agg(
        F.max(pts).alias("rule_violation_score"), worst_severity(s).alias("worst_rule_severity"),
        F.bool_or((F.col("finding_type") == "VIOLATION") & F.col("rule_id").isin(must)).alias("has_mandatory_critical"),
        F.count_if(s == "CRITICAL").alias("n_critical"), F.count_if(s == "HIGH").alias("n_high"),
        F.count_if(s == "DATA_GAP").alias("n_data_gap"), domain("credit").alias("credit_rule_pts"),
        domain("liquidity").alias("liquidity_rule_pts"), domain("capital").alias("capital_rule_pts"))


def trend_score_expr(signs: dict[str, int] | None = None) -> Column:
    """Mean adverse rolling z, clipped to 0..3 and scaled to 0..100; 0 without any z."""
    adverse = [f"(case when {m}__roll_z is not null then greatest(0D, {m}__roll_z * {s}) end)"
               for m, s in (signs or config.TREND_SCORE_METRICS).items()]
    return F.expr(sqltext.half_up(f"coalesce({sqltext.clip(sqltext.mean(adverse), 0, 3)}, 0D) / 3 * 100", 2))


def flag_clusters(findings: DataFrame) -> DataFrame:
    """Per bank-period: clusters of red flags hit per area, and the fraud-related categories."""
    table = literal_table(findings.sparkSession, "area string, cluster string, category string", config.FLAG_CLUSTERS)
    # one row per bank-period and category first, so repeated findings do not travel
    cats = findings.where("bank_id is not null and period is not null").select(*KEY, "category").distinct()
    hit = cats.join(F.broadcast(table), "category", "left")
    n = lambda area: F.countDistinct(F.when(F.col("area") == area, F.col("cluster")))
    return hit.groupBy(*KEY).agg(
        n("credit").alias("credit_flag_clusters"), n("liquidity").alias("liq_flag_clusters"), n("fraud").alias("fraud_flag_clusters"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("area") == "fraud", F.col("category")))), ", ").alias("fraud_flags"),
        F.lit(True).alias("has_findings"))


def score_inputs(features: DataFrame) -> DataFrame:
    """Wide features with the rolling z-scores, changes and percentile ranks the scores read."""
    base = ensure_columns(features, [*LEVEL_INPUTS, *RANKED, *config.TREND_SCORE_METRICS, "profit_before_tax", "toi", "deposits"])
    trended = wide_trends(base, config.TREND_SCORE_METRICS, ["profit_before_tax", "toi", "deposits"])
    ranked = pct_ranks(to_long(base, KEY, RANKED, keep_null=False))
    wide = to_wide(ranked.withColumnRenamed("value", "_v").withColumnRenamed("pct_rank", "value"), KEY, RANKED, suffix="__pct_rank")
    return trended.join(wide, KEY, "left")


def domain_scores(inputs: DataFrame, rule_scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """Credit, liquidity, fraud and failure proxies with their group scores.

    A domain without data is null, never 0: 0 means assessed and safe. Capital and market groups
    only support a domain that has signals of its own.
    """
    df = (inputs.join(rule_scores.select(*KEY, "credit_rule_pts", "liquidity_rule_pts"), KEY, "left")
          .join(clusters, KEY, "left"))
    mean, rank = sqltext.mean, (lambda m: f"{m}__pct_rank")
    inverse = lambda m: f"(100 - {m}__pct_rank)"
    ramp = lambda e: sqltext.clip(f"({e}) * 100", 0, 100)
    hits = lambda col, step: f"(case when coalesce({col}, 0) > 0 then least({col} * {float(step)}D, 100D) end)"
    groups = {
        "credit_structure_score": rank("mlt_loan_ratio"),
        "credit_provision_score": mean([inverse("provision_to_loans"), rank("credit_cost_ratio")]),
        "credit_concentration_score": mean([rank(m) for m in ("risky_sector_ratio", "real_estate_loan_ratio", "unsecured_loan_ratio",
                                                              "large_borrower_ratio", "largest_customer_group_ratio")]),
        "credit_offbalance_score": mean([rank("accrued_interest_to_loans"), rank("offbalance_to_assets"), ramp("bad_offbalance_ratio / 5")]),
        "credit_capital_score": mean([ramp("(11 - car_solo) / 3"), ramp("(8 - equity_to_assets) / 8")]),
        "liq_deposit_score": mean([inverse("casa"), f"(case when deposits__qoq < 0 then {sqltext.clip('-deposits__qoq * 5', 0, 100)} end)"]),
        "liq_wholesale_score": rank("wholesale_funding_share"), "liq_secondary_score": inverse("liquid_assets_to_deposits"),
        "liq_market_score": mean([ramp("abs(rate_sensitive_gap_ratio) / 50"), ramp("abs(fx_position_ratio) / 20"), ramp("(10 - solvency_30d_fx) / 10")])}
    df = df.selectExpr("*", *[f"{e} as {n}" for n, e in groups.items()])
    credit_core = [ramp("npl_ratio / 5"), ramp("group2_ratio / 5"), ramp("(100 - llr_coverage) / 100"), ramp("credit_growth_yoy / 40"),
                   *list(groups)[:4]]
    liquid_core = [ramp("(ldr - 70) / 30"), ramp("st_funding_for_mlt_loans / 34"), ramp("(20 - liquidity_reserve_ratio) / 20"),
                   ramp("(15 - avg_liquid_asset_ratio) / 15"), ramp("(50 - solvency_30d_vnd) / 50"), *list(groups)[5:8]]
    supported = lambda core, support: f"(case when coalesce({', '.join(core)}) is not null then {support} end)"
    fraud = mean(["(case when npl_ratio__roll_z < -0.5D and group2_ratio__roll_z > 0.5D then 80D end)",
                  "(case when profit_before_tax__qoq > 20 and toi__qoq < 0 then 70D end)", ramp("(accrued_interest_days - 60) / 120"),
                  hits("fraud_flag_clusters", 30)])
    inputs_seen = "coalesce(npl_ratio__roll_z, group2_ratio__roll_z, profit_before_tax__qoq, toi__qoq, accrued_interest_days) is not null"
    df = df.selectExpr("*", f"{mean([*credit_core, supported(credit_core, 'credit_capital_score'), hits('credit_flag_clusters', 25)])} as _cs",
                       f"{mean([*liquid_core, supported(liquid_core, 'liq_market_score'), hits('liq_flag_clusters', 25)])} as _ls",
                       f"case when {inputs_seen} or coalesce(has_findings, false) then coalesce({fraud}, 0D) end as fraud_risk_proxy_score")
    # a rule alone makes a domain assessed: it only fires on a value
    blend = lambda signal, pts: f"case when {signal} is not null then greatest({signal}, coalesce({pts}, 0D)) when {pts} > 0 then {pts} end"
    df = df.selectExpr("*", f"{blend('_cs', 'credit_rule_pts')} as credit_risk_score", f"{blend('_ls', 'liquidity_rule_pts')} as liquidity_risk_score")
    failure = mean([ramp("(10 - car_solo) / 10"), ramp("(8 - equity_to_assets) / 8"), ramp("(0.5D - roa) / 1.0D"),
                    "(credit_risk_score * 0.5D)", "(liquidity_risk_score * 0.5D)"])
    df = df.selectExpr("*", f"{failure} as failure_risk_proxy_score")
    shown = ["credit_risk_score", "liquidity_risk_score", "fraud_risk_proxy_score", "failure_risk_proxy_score", *groups]
    return df.select(*config.ID_COLS, *[half_up(n, 2).alias(n) for n in shown],
                     *[F.expr(f"coalesce({n}, 0L) as {n}") for n in ("credit_flag_clusters", "liq_flag_clusters", "fraud_flag_clusters")],
                     F.expr("coalesce(fraud_flags, '') as fraud_flags"), trend_score_expr().alias("trend_risk_score"))


def data_quality_score(keys: DataFrame, validation: DataFrame | None, rule_scores: DataFrame | None = None,
                       model: dict | None = None) -> DataFrame:
    """Severest finding on the bank-period, or 0.6 of the severest bank-wide one; without
    validation findings, the count of rule data gaps out of 5."""
    if validation is None:
        gaps = rule_scores.select(*KEY, "n_data_gap")
        return keys.select(*KEY).join(gaps, KEY, "left").select(
            *KEY, (clip(F.coalesce("n_data_gap", F.lit(0)).cast("double"), 0, 5) / 5 * 100).alias("data_quality_risk_score"))
    pts = points(F.col("severity"), (model or config.MODEL)["quality_points"], 25.0)
    seen = validation.where("bank_id is not null")
    own = seen.where("period is not null").groupBy(*KEY).agg(F.max(pts).alias("_own"))
    wide = seen.where("period is null").groupBy("bank_id").agg((F.max(pts) * 0.6).alias("_wide"))
    return keys.select(*KEY).join(own, KEY, "left").join(wide, "bank_id", "left").select(
        *KEY, F.coalesce(F.greatest("_own", "_wide"), F.lit(0.0)).alias("data_quality_risk_score"))


def level_of(score: Column, levels=None) -> Column:
    out = F.when(score.isNull(), "LOW")
    for limit, name in levels or config.MODEL["levels"]:
        if limit is None:
            return out.otherwise(name)
        out = out.when(score <= limit, name)
    return out


def composite(domains: DataFrame, rule_scores: DataFrame, quality: DataFrame, anomalies: DataFrame | None = None,
              clusters: DataFrame | None = None, stress: DataFrame | None = None, model: dict | None = None) -> DataFrame:
    """Weighted blend, never below the floor of the worst rule severity; a mandatory breach is CRITICAL."""
    m = model or config.MODEL
    df = domains.join(rule_scores.drop("credit_rule_pts", "liquidity_rule_pts", "capital_rule_pts"), KEY, "left").join(quality, KEY, "left")
    if anomalies is not None:
        top = [c for c in ("top_features",) if c in anomalies.columns]
        df = df.join(anomalies.select(*KEY, F.col("anomaly_score").alias("anomaly_score_norm"), "anomaly_label", *top), KEY, "left")
    df = ensure_columns(ensure_columns(df, ["anomaly_score_norm"]), ["anomaly_label"], "int")
    if clusters is not None:
        df = df.join(clusters.select("bank_id", "cluster_id", "cluster_risk_label", "cluster_risk_score"), "bank_id", "left")
    df = ensure_columns(ensure_columns(ensure_columns(df, ["cluster_risk_score"]), ["cluster_id"], "int"), ["cluster_risk_label"], "string")
    if stress is not None:
        # one row per period, bounded by the calendar
        df = df.join(F.broadcast(stress.select("period", F.col("systemic_stress_pct").alias("systemic_period_risk_score"))), "period", "left")
    df = ensure_columns(df, ["systemic_period_risk_score"])
    filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in COMPONENTS]
    df = df.select(*[c for c in df.columns if c not in COMPONENTS], *filled)
    blend = sum((F.lit(m["weights"].get(c, 0.0)) * F.col(c) for c in COMPONENTS[1:]), F.lit(m["weights"].get(COMPONENTS[0], 0.0)) * F.col(COMPONENTS[0]))
    floor = points(F.col("worst_rule_severity"), m["floors"])
    must = F.coalesce("has_mandatory_critical", F.lit(False))
    df = df.select(*[c for c in df.columns if c != "has_mandatory_critical"], must.alias("has_mandatory_critical"),
                   clip(blend, 0, 100).alias("weighted_score"), F.coalesce(floor, F.lit(0.0)).alias("rule_based_floor"))
    df = df.select("*", half_up(F.greatest("weighted_score", "rule_based_floor"), 2).alias("_s"))
    forced = F.col("has_mandatory_critical")
    return df.select("*", F.when(forced, F.greatest("_s", F.lit(90.0))).otherwise(F.col("_s")).alias("final_risk_score"),
                     F.when(forced, "CRITICAL").otherwise(level_of(F.col("_s"), m["levels"])).alias("risk_level")).drop("_s")


def with_rank(scores: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Minimum rank, highest score first, over all bank-periods (or ``within`` a period).

    Scores have two decimals, so many banks share one; ranks come from range partitions and nothing meets on a score.
    """
    pos = Positions(scores, within or [], "final_risk_score", ["bank_id", "period"])
    ranked = pos.rows.select(*scores.columns, (F.col("n_total") - F.col("n_below") - F.col("n_eq") + 1).alias("risk_rank"))
    return ranked.union(pos.nulls.select(*scores.columns, F.lit(None).cast("long")))


def bank_ranking(scores: DataFrame) -> DataFrame:
    """Latest period of each bank, riskiest first."""
    return latest_snapshot(scores).orderBy(F.desc("final_risk_score"), "bank_id")


def risk_scores(features: DataFrame, findings: DataFrame, validation: DataFrame | None, anomalies: DataFrame | None = None,
                clusters: DataFrame | None = None, stress: DataFrame | None = None, model: dict | None = None) -> DataFrame:
    """The master table: every component, the composite, level and rank of each bank-period."""
    rs = rule_violation_score(findings, model=model)
    flags = flag_clusters(validation) if validation is not None else flag_clusters(
        features.select("bank_id", "period", F.lit(None).cast("string").alias("category")).where(F.lit(False)))
    domains = domain_scores(score_inputs(features), rs, flags)
    quality = data_quality_score(features, validation, rs, model)
    # staged: ranging them samples them first, which would score all rows twice
    return with_rank(stage(composite(domains, rs, quality, anomalies, clusters, stress, model), "composite"))
