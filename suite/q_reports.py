"""Report and dashboard queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from prudens.functions.numeric import half_up
from prudens.functions.reshape import to_long
from prudens.operators import ews, reports, scoring, stress
from prudens.plans.staging import stage
from suite.oracle import fragment, r, unpivot
from suite.q_findings import findings_frame
from suite.q_models import _prof
from suite.q_scores import domains_frame, ews_frame, labels_frame, periods_frame, scores_frame, stress_results
from suite.registry import query

from prudens import config
from prudens.operators import cluster


def _scored(fx):
    return stage(scores_frame(fx.staged), "scores")


@query("report_executive_summary", "P01", """
select n_banks, n_periods, n_critical_banks, n_violations, n_anomalies, n_high_risk_periods, ews_alarm, ews_warning, ews_system_level, n_fail_capital as severe_n_fail_capital, total_capital_shortfall as severe_shortfall
from (select count(distinct bank_id) as n_banks, count(distinct period) as n_periods, count(distinct bank_id) filter (risk_level = 'CRITICAL') as n_critical_banks from scored), (select count(*) filter (finding_type = 'VIOLATION') as n_violations from finding),
  (select cast(sum(anomaly_label) as bigint) as n_anomalies from std_label), (select count(*) filter (is_high_risk) as n_high_risk_periods from hrp), (select count(*) filter (ews_level = 'ALARM') as ews_alarm, count(*) filter (ews_level = 'WARNING') as ews_warning from ews_last),
  (select arg_max(system_level, period_ts) as ews_system_level from ews_sys), (select n_fail_capital, total_capital_shortfall from ssum where scenario_id = 'severe')""")
def _exec(fx):
    fx = fx.staged
    table = ews_frame(fx)
    return reports.executive_summary(scores_frame(fx), findings_frame(fx), labels_frame(fx), periods_frame(fx), table, ews.system_timeline(table),
                                     stress.system_summary(stress.at_snapshot(stress_results(fx), fx.features)))


@query("report_top_risk_banks", "P02", "select bank_id, period, final_risk_score, risk_level, credit_risk_score from ranking order by final_risk_score desc, bank_id limit 10")
def _toprisk(fx):
    return reports.top_risk_banks(scoring.bank_ranking(scores_frame(fx.staged))).select("bank_id", "period", "final_risk_score", "risk_level", "credit_risk_score")


@query("report_critical_breaches", "P03", f"select bank_id, period, rule_id, metric, {r('metric_value')} as metric_value from finding where severity = 'CRITICAL' and finding_type = 'VIOLATION'")
def _crit(fx):
    return reports.critical_breaches(findings_frame(fx)).select("bank_id", "period", "rule_id", "metric", half_up("metric_value", 4).alias("metric_value"))


@query("report_top_anomalies", "P04", f"select bank_id, period, {r('anomaly_score')} as anomaly_score from std_label order by anomaly_score desc nulls last, bank_id, period limit 20")
def _topan(fx):
    return reports.top_anomalies(labels_frame(fx)).select("bank_id", "period", half_up("anomaly_score", 4).alias("anomaly_score"))


@query("report_cluster_table", "P05", "select cluster_id, n_banks, cluster_risk_score from prof join prof_risk using (cluster_id)")
def _ctab(fx):
    return cluster.composite_risk(_prof(fx)).select("cluster_id", "n_banks", "cluster_risk_score")


@query("report_high_risk_list", "P05", "select period, period_risk_score, risk_domains from hrp where is_high_risk")
def _hrl(fx):
    return reports.high_risk_list(periods_frame(fx)).select("period", "period_risk_score", "risk_domains")


@query("report_domain_top", "P06", " union all ".join(f"select * from (select '{d}' as domain, bank_id, period, {c} as score from dom where (bank_id, period_ts) in (select bank_id, max(period_ts) from wide_m group by bank_id) order by {c} desc nulls last, bank_id limit 10)" for d, c in reports.DOMAINS.items()))
def _dtop(fx):
    latest = stage(scoring.latest_snapshot(domains_frame(fx)), "domains")
    out = None
    for d, c in reports.DOMAINS.items():
        part = reports.domain_top(latest, d).select(F.lit(d).alias("domain"), "bank_id", "period", F.col(c).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("report_critical_banks", "P07", """
select s.bank_id, s.period, s.final_risk_score, cast(coalesce(n, 0) as bigint) as n_breaches, coalesce(rules, '') as rules from scored s left join
(select bank_id, period, count(*) as n, string_agg(rule_id, ',' order by rule_id) as rules from finding where severity = 'CRITICAL' and finding_type = 'VIOLATION' group by bank_id, period) using (bank_id, period) where risk_level = 'CRITICAL'""")
def _critb(fx):
    fx = fx.staged
    out = reports.critical_banks(scores_frame(fx), findings_frame(fx))
    names = F.regexp_extract_all("reason", F.lit(r"([A-Z0-9_]+) \("), 1)
    return out.select("bank_id", "period", "final_risk_score", F.size(names).cast("bigint").alias("n_breaches"), F.array_join(names, ",").alias("rules"))


@query("report_ews_latest", "P08", "select bank_id, period, ews_score, ews_level from ews_last order by ews_score desc, bank_id limit 25")
def _ewsl(fx):
    return ews.latest(ews_frame(fx)).orderBy(F.desc("ews_score"), "bank_id").limit(25).select("bank_id", "period", "ews_score", "ews_level")


@query("report_stress_capital", "P09", "select bank_id, stressed_car, capital_shortfall, passes_capital from sr where period = (select period from snap) and scenario_id = 'severe' and capital_status = 'OK' order by stressed_car, bank_id limit 30")
def _scap(fx):
    return reports.stress_capital(stress_results(fx), fx.features).select("bank_id", "stressed_car", "capital_shortfall", "passes_capital")


@query("report_stress_breaking", "P09", "select bank_id, baseline_car, breaking_npl_pp from brk where period = (select period from snap) and breaking_npl_pp is not null order by breaking_npl_pp, bank_id limit 30")
def _sbrk(fx):
    return reports.stress_breaking(stress.breaking_points(stress.stress_inputs(fx.features)), fx.features).select("bank_id", "baseline_car", "breaking_npl_pp")


_HP = [f"{y}-{m:02d}" for y in range(1992, 1999) for m in range(1, 13)]  # every month of the data


@query("report_heatmap", "P10", "select bank_id, " + ", ".join(f"max(final_risk_score) filter (period = '{p}') as \"{p}\"" for p in _HP) + " from scored group by bank_id")
def _heat(fx):
    return reports.heatmap(scores_frame(fx), _HP)


@query("report_domain_means", "P11", "select " + ", ".join(f"{r(f'sum(cast(floor({c} * 100 + 0.5) as bigint))::double / count({c}) / 100.0::double', 2)} as {d}" for d, c in reports.DOMAINS.items()) + " from dom where (bank_id, period_ts) in (select bank_id, max(period_ts) from wide_m group by bank_id)")
def _dmean(fx):
    return reports.domain_means(scoring.latest_snapshot(domains_frame(fx)))


@query("report_severity_counts", "P12", "select severity, count(*) as n from finding group by severity")
def _sevc(fx):
    return reports.counts_by(findings_frame(fx), "severity")


@query("report_level_counts", "P12", "select risk_level, count(*) as n from ranking group by risk_level")
def _levc(fx):
    return reports.counts_by(scoring.bank_ranking(scores_frame(fx)), "risk_level")


@query("report_findings_ordered", "P13", "select bank_id, period, rule_id, severity, finding_type from finding")
def _ordered(fx):
    return reports.findings_newest_first(findings_frame(fx)).select("bank_id", "period", "rule_id", "severity", "finding_type")


_J = lambda m: f"string_agg(coalesce(cast(cast(floor({m} * 100 + 0.5) as bigint) as varchar), ''), ',' order by period_ts) as {m}"


@query("report_bank_series", "P14", f"select bank_id, string_agg(period, ',' order by period_ts) as periods, {_J('npl_ratio')}, {_J('ldr')} from feat group by bank_id")
def _series(fx):
    s = reports.bank_series(fx.features, ["npl_ratio", "ldr"])
    join = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(F.floor(x * 100 + 0.5).cast("string"), F.lit(""))), ",").alias(c)
    return s.select("bank_id", F.array_join("periods", ",").alias("periods"), join("npl_ratio"), join("ldr"))


@query("report_period_picker", "P15", "select distinct period, case when regexp_full_match(period, '\\d{4}-\\d{2}') then 'month' when regexp_full_match(period, '\\d{4}Q[1-4]') then 'quarter' else 'year' end as kind, cast(substr(period, 1, 4) as int) as year, case when regexp_full_match(period, '\\d{4}-\\d{2}') then cast(substr(period, 6, 2) as int) when regexp_full_match(period, '\\d{4}Q[1-4]') then cast(substr(period, 6, 1) as int) end as sub from fx_panel")
def _picker(fx):
    return reports.period_picker(fx.view("fx_panel"))


@query("report_filter_findings", "P16", f"select bank_id, period, rule_id, {r('metric_value')} as metric_value from finding where bank_id in ('B000003', 'B000007') and severity in ('CRITICAL', 'HIGH') and contains(lower(rule_name), 'thanh khoản') and metric_value >= 0 and metric_value <= 9")
def _filter(fx):
    f = reports.filter_findings(findings_frame(fx), "B000003, B000007", severity="critical,high", rule_name="Thanh KHOẢN", min_value=0, max_value=9)
    return f.select("bank_id", "period", "rule_id", half_up("metric_value", 4).alias("metric_value"))


@query("report_filter_options", "P16", " union ".join(f"select '{c}' as field, {c} as option from finding where {c} is not null" for c in ["bank_id", "period", "rule_id", "metric", "severity", "finding_type"]))
def _options(fx):
    return reports.filter_options(findings_frame(fx))


@query("report_panel_query", "P17", f"select period, metric_name, load_order, {r('metric_value')} as metric_value from fx_panel where bank_id = 'B000011' and frequency = 'monthly'")
def _panel(fx):
    return reports.panel_query(fx.view("fx_panel"), "B000011", frequency="monthly").select("period", "metric_name", "load_order", half_up("metric_value", 4).alias("metric_value"))


fragment("vp_long", "select bank_id, period, period_ts, metric_name as metric, metric_value as value from fx_panel where load_order = 1")
fragment("vp", """select bank_id, value, period from (select *, row_number() over (partition by bank_id order by case period when '1996Q3' then 0 when '1996-09' then 1 when '1996' then 2 else 3 end, period_ts desc) as k
  from vp_long where metric = 'group2_ratio' and value is not null and period like '1996%') where k = 1""")


def _vp(fx):
    return fx.view("fx_panel").where("load_order = 1").selectExpr("bank_id", "period", "period_ts", "metric_name as metric", "metric_value as value")


@query("report_value_at_period", "P18", f"select bank_id, {r('value')} as value, period as found_period from vp")
def _vap(fx):
    return reports.value_at_period(_vp(fx), "group2_ratio", "1996Q3").withColumn("value", half_up("value", 4))


@query("report_not_evaluated", "P18", "select distinct bank_id from vp_long where bank_id not in (select bank_id from vp_long where metric = 'group2_ratio' and value > 2 and period like '1996-09%' or metric = 'group2_ratio' and value > 2 and period like '1996%')")
def _ne(fx):
    return reports.not_evaluated(_vp(fx).where("metric <> 'group2_ratio' or value > 2"), "group2_ratio", "1996-09")


_LIM = {"npl_ratio": (">", 3.0), "ldr": (">", 85.0), "car_solo": ("<", 8.0)}


@query("report_above_limits", "P19", " union all ".join(f"select '{m}' as metric, count(*) filter ({m} {o} {v}) as n_beyond from feat_last" for m, (o, v) in _LIM.items()))
def _lim(fx):
    return reports.above_limits(cluster.latest_snapshot(fx.features), _LIM)


@query("report_missing_by_metric", "P20", f"""
select frequency, metric, n_total - n as n_missing, n_total, {r('(n_total - n) / n_total::double * 100', 2)} as missing_pct from (select frequency, metric_name as metric, count(*) as n from (select distinct frequency, metric_name, bank_id, period from fx_panel) group by frequency, metric_name)
join (select frequency, count(distinct bank_id) * count(distinct period) as n_total from fx_panel group by frequency) using (frequency) where n_total > n""")
def _mbm(fx):
    return reports.missing_by_metric(fx.view("fx_panel"))
