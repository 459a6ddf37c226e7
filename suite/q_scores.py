"""Stress, early warning, scoring and high-risk periods."""
from __future__ import annotations

from pyspark.sql import functions as F

from prudens import config
from prudens.functions.numeric import half_up
from prudens.operators import crosssection, ews, highrisk, scoring, stress
from prudens.plans.staging import stage
from suite.oracle import clip, fragment, null_mean, r, unpivot, values
from suite.q_features import stress_frame
from suite.q_findings import findings_frame, validation_frame
from suite.registry import query

# ---------------------------------------------------------------- stress test
fragment("scen", values(config.SCENARIOS, "scenario_id, scenario_name, npl_shock_pp, rwa_shock, lgd, deposit_runoff, wholesale_runoff, hqla_haircut"))
_PLAUS = lambda e: f"case when {e} between 1.0::double and 50.0::double then {e} end"
fragment("sx0", f"""
select bank_id, period, period_ts, customer_loans as loans, nullif(deposits, 0) as dep, npl_ratio, {_PLAUS('coalesce(car_solo, car_consolidated)')} as car,
  case when coalesce(nullif(own_capital_solo, 0), nullif(tier1_capital, 0), equity) > 0 then coalesce(nullif(own_capital_solo, 0), nullif(tier1_capital, 0), equity) end as own,
  case when coalesce(nullif(rwa, 0), rwa_credit) > 0 then coalesce(nullif(rwa, 0), rwa_credit) end as rwa, hqla, interbank_funding as wholesale,
  coalesce(nullif(total_assets, 0), customer_loans) as total_assets from feat""")
fragment("sx1", "select * replace (coalesce(car, own / rwa2 * 100.0::double) as car), case when rwa2 is not null then rwa2 end as rwa3 from (select *, coalesce(rwa, own / (car / 100.0::double)) as rwa2 from sx0)")
fragment("sx", f"""
select bank_id, period, period_ts, loans, npl_ratio, hqla, wholesale, total_assets, case when ok then car end as car, case when ok then own2 end as own, case when ok then rwa3 end as rwa,
  case when loans <> 0 and dep > 0 and loans / dep * 100 between 1 and 400 then dep end as deposits,
  concat_ws(',', case when coalesce(ok, false) = false then 'capital' end, case when not coalesce(loans <> 0 and dep > 0 and loans / dep * 100 between 1 and 400, false) then 'liquidity' end) as data_gaps
from (select *, coalesce(car between 1.0 and 50.0 and own2 <> 0 and rwa3 <> 0, false) as ok from (select *, coalesce(own, car / 100.0::double * rwa3) as own2 from sx1))""")
fragment("sr", f"""
select bank_id, period, period_ts, scenario_id, scenario_name, total_assets, data_gaps, case when cap then 'OK' else 'DATA_GAP' end as capital_status,
  case when cap then {r('own / rwa * 100.0::double', 2)} end as baseline_car, case when cap then {r('car1', 2)} end as stressed_car,
  case when cap then {r('car1 - own / rwa * 100.0::double', 2)} end as car_delta, case when cap then {r('loss', 1)} end as credit_loss,
  case when cap then {r('greatest(0.0::double, 8.0::double / 100.0::double * rwa1 - own1)', 1)} end as capital_shortfall,
  case when cap then car1 >= 8 end as passes_capital, case when liq then 'OK' else 'DATA_GAP' end as liquidity_status,
  case when lcr_ok then 'LCR' when liq then 'STRESSED_LDR' end as liq_method, case when lcr_ok then {r('avail / outf * 100.0::double', 1)} end as stressed_lcr,
  case when liq and not lcr_ok then {r('loans / deposits * 100.0::double', 1)} end as baseline_ldr, case when liq and not lcr_ok then {r('loans / dep1 * 100.0::double', 1)} end as stressed_ldr,
  case when lcr_ok then {r('greatest(0.0::double, outf - avail)', 1)} when liq then {r('greatest(0.0::double, loans - dep1)', 1)} end as liquidity_gap,
  case when lcr_ok then {r('outf', 1)} when liq then {r('deposits * deposit_runoff', 1)} end as deposit_outflow,
  case when lcr_ok then avail / outf * 100.0::double >= 100 when liq then loans / dep1 * 100.0::double <= 100 end as passes_liquidity
from (select *, own1 / rwa1 * 100.0::double as car1, liq and hqla is not null and outf > 0 as lcr_ok from (
  select *, data_gaps not like '%capital%' and loans is not null and npl_ratio is not null as cap, data_gaps not like '%liquidity%' as liq,
    loans * npl_shock_pp / 100.0::double * lgd as loss, own - loans * npl_shock_pp / 100.0::double * lgd as own1, rwa * (1.0::double + rwa_shock) as rwa1,
    deposits * deposit_runoff + coalesce(wholesale, 0) * wholesale_runoff as outf, hqla * (1.0::double - hqla_haircut) as avail, deposits * (1.0::double - deposit_runoff) as dep1
  from sx cross join scen))""")
fragment("snap", "select period from (select arg_max(period, period_ts) as period from wide_m group by bank_id) group by period order by count(*) desc, period limit 1")


def stress_results(fx):
    return stress.run_scenarios(stress.stress_inputs(fx.features), stress.scenario_table(fx.spark))


@query("stress_inputs", "Y01", f"select bank_id, period, {r('loans')} as loans, {r('deposits')} as deposits, {r('car')} as car, {r('own')} as own_funds, {r('rwa')} as rwa, {r('wholesale')} as wholesale, data_gaps from sx")
def _inputs(fx):
    return stress.stress_inputs(fx.features).select("bank_id", "period", *[half_up(c, 4).alias(c) for c in
                                                    ["loans", "deposits", "car", "own_funds", "rwa", "wholesale"]], "data_gaps")


@query("stress_capital", "Y02", "select bank_id, period, scenario_id, capital_status, baseline_car, stressed_car, car_delta, credit_loss, capital_shortfall, passes_capital from sr")
def _cap(fx):
    return stress_results(fx).select("bank_id", "period", "scenario_id", "capital_status", "baseline_car", "stressed_car", "car_delta",
                                     "credit_loss", "capital_shortfall", "passes_capital")


@query("stress_liquidity_lcr", "Y03", "select bank_id, period, scenario_id, stressed_lcr, liquidity_gap, deposit_outflow, passes_liquidity from sr where liq_method = 'LCR'")
def _lcr(fx):
    return stress_results(fx).where("liq_method = 'LCR'").select("bank_id", "period", "scenario_id", "stressed_lcr", "liquidity_gap", "deposit_outflow", "passes_liquidity")


@query("stress_liquidity_ldr", "Y04", "select bank_id, period, scenario_id, baseline_ldr, stressed_ldr, liquidity_gap, deposit_outflow, passes_liquidity from sr where liq_method = 'STRESSED_LDR'")
def _ldr(fx):
    return stress_results(fx).where("liq_method = 'STRESSED_LDR'").select("bank_id", "period", "scenario_id", "baseline_ldr", "stressed_ldr",
                                                                          "liquidity_gap", "deposit_outflow", "passes_liquidity")


fragment("brk", f"""
select bank_id, period, {r('car', 2)} as baseline_car, case when own is not null and loans <> 0 then case when own - 8.0::double / 100.0::double * rwa <= 0 then 0.0
  else {r('(own - 8.0::double / 100.0::double * rwa) / (loans * 0.55::double) * 100.0::double', 2)} end end as breaking_npl_pp,
  case when own is not null and loans <> 0 then own - 8.0::double / 100.0::double * rwa <= 0 end as already_below_min from sx""")


@query("stress_breaking_point", "Y05", "select * from brk")
def _brk(fx):
    return stress.breaking_points(stress.stress_inputs(fx.features)).drop("bank_name", "period_ts")


@query("stress_snapshot", "Y06", "select bank_id, period, scenario_id, stressed_car, liq_method, passes_capital, passes_liquidity from sr where period = (select period from snap)")
def _snap(fx):
    return stress.at_snapshot(stress_results(fx), fx.features).select("bank_id", "period", "scenario_id", "stressed_car", "liq_method",
                                                                      "passes_capital", "passes_liquidity")


fragment("ssum", f"""
select scenario_id, scenario_name, count(*) filter (capital_status = 'OK') as n_assessed_capital, count(*) filter (capital_status = 'OK' and not passes_capital) as n_fail_capital,
  {r("coalesce(sum(capital_shortfall) filter (capital_status = 'OK' and not passes_capital), 0)", 1)} as total_capital_shortfall,
  {r("min(stressed_car)", 2)} as min_stressed_car, {r("avg(stressed_car)", 2)} as avg_stressed_car,
  {r("coalesce(sum(total_assets) filter (capital_status = 'OK' and not passes_capital), 0) / sum(total_assets) filter (capital_status = 'OK') * 100", 1)} as assets_share_failing,
  count(*) filter (liquidity_status = 'OK') as n_assessed_liquidity, count(*) filter (liquidity_status = 'OK' and not passes_liquidity) as n_fail_liquidity,
  {r("coalesce(sum(liquidity_gap) filter (liquidity_status = 'OK' and not passes_liquidity), 0)", 1)} as total_liquidity_gap
from sr where period = (select period from snap) group by scenario_id, scenario_name""")


@query("stress_system_summary", "Y07", "select * from ssum")
def _ssum(fx):
    return stress.system_summary(stress.at_snapshot(stress_results(fx), fx.features))


# ---------------------------------------------------------------- early warning
fragment("ews_metric", values([(*m, i) for i, m in enumerate(config.EWS_METRICS)], "metric, label, direction, lim, buffer, domain, weight, lo, hi, ord"))
fragment("ews_long", unpivot("feat", "bank_id, period, period_ts", [m[0] for m in config.EWS_METRICS]))
_EW = "over (partition by bank_id, metric order by period_ts rows between {a} preceding and {b} preceding)"
_SL = lambda a, b: "regr_slope(value, rn) " + _EW.format(a=a, b=b)
fragment("ews_valid", """
select *, row_number() over (partition by bank_id, metric order by period_ts) as rn from ews_long join ews_metric using (metric) where value >= lo and value <= hi""")
fragment("ews_win", f"""
select *, least(rn, 6) as n, {_SL(5, 0)} as slope, stddev_pop(value) {_EW.format(a=5, b=0)} as sd,
  stddev_pop(value) over (partition by bank_id, metric order by period_ts rows between unbounded preceding and current row) as sd_all,
  case when least(rn, 6) = 6 then {_SL(2, 0)} - {_SL(5, 2)} when rn = 5 then {_SL(2, 0)} - {_SL(4, 2)} when rn = 4 then {_SL(1, 0)} - {_SL(3, 1)} end as swing,
  case when direction = 'higher_safer' then value <= lim + buffer else value >= lim - buffer end as inb,
  case when direction = 'higher_safer' then value < lim else value > lim end as breached,
  case when direction = 'higher_safer' then -1 else 1 end as sgn from ews_valid""")
_UNIT = lambda e: f"least(greatest({e}, 0.0::double), 1.0::double)"
fragment("ews_sig", f"""
select bank_id, period, period_ts, metric, value, n, {_UNIT("case when direction = 'higher_safer' then (lim + buffer - value) / buffer else (value - (lim - buffer)) / buffer end")} as proximity,
  case when n >= 3 then {_UNIT("sgn * slope * n / scale")} else 0 end as trend,
  case when n >= 3 and swing is not null then {_UNIT("sgn * swing * n / scale")} else 0 end as acceleration,
  case when n >= 3 and rn >= 4 then {_UNIT("sd / coalesce(nullif(sd_all, 0), 1e-9) - 1.0::double")} else 0 end as volatility,
  least(rn - coalesce(last_value(case when not inb then rn end ignore nulls) over (partition by bank_id, metric order by period_ts rows between unbounded preceding and current row), 0), 6) / 6.0::double as breach_streak,
  breached, case when n >= 3 and not breached and sgn * slope > 1e-9 and -sgn * (value - lim) > 0 then least(13.0::double, -sgn * (value - lim) / (sgn * slope)) end as projected
from (select *, greatest(buffer, coalesce(nullif(sd, 0), buffer), 1e-9) as scale from ews_win)""")
_CARRIED = ["value", "proximity", "trend", "acceleration", "volatility", "breach_streak", "breached"]
fragment("ews_all", """
select l.bank_id, l.period, l.period_ts, m.label, m.domain, m.weight, m.ord, l.metric, """
         + ", ".join(f"s.{c}" for c in _CARRIED) + """, s.projected
from ews_long l join ews_metric m using (metric) asof left join ews_sig s on l.bank_id = s.bank_id and l.metric = s.metric and l.period_ts >= s.period_ts""")
fragment("std_label", """
select bank_id, period, period_ts, cast(ldr > 130 as int) as anomaly_label, case when ldr is not null then least(greatest(ldr / 2.0::double, 0), 100) end as anomaly_score from feat""")
fragment("ews_pers", "select bank_id, period, avg(cast(coalesce(anomaly_label, 0) as double)) over (partition by bank_id order by period_ts rows between 5 preceding and current row) as persist from std_label")
_STR = "greatest(proximity, trend, breach_streak)"
_T2 = lambda e: f"(case when {e} < 0 and floor(abs({e}) * 100 + 0.5) > 0 then '-' else '' end || cast(cast(floor(floor(abs({e}) * 100 + 0.5) / 100) as bigint) as varchar) || '.' || lpad(cast(cast(floor(abs({e}) * 100 + 0.5) as bigint) % 100 as varchar), 2, '0'))"
fragment("ews_drv", f"""
select bank_id, period, string_agg(label || '=' || {_T2('value')} || ' (prox ' || {_T2('proximity')} || ', trend ' || {_T2('trend')} || ')', '; ' order by k) as drivers
from (select *, row_number() over (partition by bank_id, period order by {_STR} desc, ord) as k from ews_all where value is not null) where k <= 3 group by bank_id, period""")
fragment("ews_agg", """
select bank_id, period, period_ts, """ + ", ".join(f"sum({s} * weight) / sum(weight) filter (value is not null) as a_{s}" for s in ews.SIGNALS) + """,
  max(proximity) as prox_max, count(*) filter (proximity > 0) as n_in_buffer, count(*) filter (breached) as n_breached, count(*) filter (value is null) as n_data_gap,
  min(projected) as proj, arg_min(label, projected * 100 + ord * 1e-7) filter (projected is not null) as proj_label,
  coalesce(string_agg(distinct domain, ', ' order by domain) filter (proximity > 0.3 or trend > 0.3), '') as risk_domains
from ews_all group by bank_id, period, period_ts having count(value) > 0""")
_W = config.EWS["signal_weights"]
fragment("ews_score", f"""
select *, least(greatest(100.0::double * ({_W['proximity']}::double * prox + {_W['trend']}::double * a_trend + {_W['acceleration']}::double * a_acceleration + {_W['volatility']}::double * a_volatility
   + {_W['breach_streak']}::double * a_breach_streak + {_W['anomaly_persistence']}::double * persist), 0), 100) as raw
from (select *, 0.6::double * prox_max + 0.4::double * a_proximity as prox from ews_agg) join ews_pers using (bank_id, period)""")
fragment("ews_tab", f"""
select *, case level_rank when 0 then 'NORMAL' when 1 then 'WATCH' when 2 then 'WARNING' else 'ALARM' end as ews_level, {r('ews_score - prev_score', 1)} as score_delta,
  coalesce(level_rank > prev_rank, false) as escalating
from (select *, lag(ews_score) over (partition by bank_id order by period_ts) as prev_score, lag(level_rank) over (partition by bank_id order by period_ts) as prev_rank from (
  select bank_id, period, period_ts, {r('raw', 1)} as ews_score, greatest(case when raw <= 25 then 0 when raw <= 50 then 1 when raw <= 75 then 2 else 3 end,
      case when n_in_buffer > 0 then 1 else 0 end, case when n_breached > 0 then 2 else 0 end, case when n_breached > 0 and a_trend >= 0.3 then 3 else 0 end,
      case when proj <= 3 then 2 else 0 end) as level_rank,
    {r('prox * 100', 1)} as sig_proximity, {r('a_trend * 100', 1)} as sig_trend, {r('a_acceleration * 100', 1)} as sig_acceleration, {r('a_volatility * 100', 1)} as sig_volatility,
    {r('a_breach_streak * 100', 1)} as sig_breach_streak, {r('persist * 100', 1)} as sig_anomaly_persistence, proj_label as projected_breach_metric,
    case when proj <= 12 then {r('proj', 1)} end as projected_periods_to_breach, risk_domains, drivers, n_in_buffer, n_breached, n_data_gap
  from ews_score join ews_drv using (bank_id, period)))""")


def labels_frame(fx):
    """Stand-in model output: the oracle cannot train a forest."""
    f = fx.features
    return f.select("bank_id", "period", "period_ts", (F.col("ldr") > 130).cast("int").alias("anomaly_label"),
                    F.when(F.col("ldr").isNotNull(), F.least(F.greatest(F.col("ldr") / 2.0, F.lit(0.0)), F.lit(100.0))).alias("anomaly_score"))


def ews_frame(fx):
    fx = fx.staged  # signals and labels read the features each
    return ews.ews_table(fx.features, labels_frame(fx))


def _signals(fx):
    return ews.metric_signals(fx.features).where("valid")


for _c, _row in [("proximity", "E01 E02"), ("trend", "E03"), ("acceleration", "E04"), ("volatility", "E05"), ("projected", "E06"), ("breach_streak", "E07")]:
    def _mk(c=_c, row=_row):
        @query(f"ews_signal_{c}", row, f"select bank_id, period, metric, {r(c)} as {c} from ews_sig")
        def _run(fx):
            return _signals(fx).select("bank_id", "period", "metric", half_up(c, 4).alias(c))
    _mk()


@query("ews_signals_carried", "E08", f"select bank_id, period, metric, {r('value')} as value, {r('proximity')} as proximity, {r('trend')} as trend from ews_all")
def _carried(fx):
    return ews.metric_signals(fx.features).select("bank_id", "period", "metric", *[half_up(c, 4).alias(c) for c in ["value", "proximity", "trend"]])


@query("ews_anomaly_persistence", "E09", f"select bank_id, period, {r('persist')} as anomaly_persistence from ews_pers")
def _pers(fx):
    return ews.anomaly_persistence(fx.features, labels_frame(fx)).withColumn("anomaly_persistence", half_up("anomaly_persistence", 4))


@query("ews_score", "E10", "select bank_id, period, ews_score, sig_proximity, sig_trend, sig_acceleration, sig_volatility, sig_breach_streak, sig_anomaly_persistence from ews_tab")
def _score(fx):
    return ews_frame(fx).select("bank_id", "period", "ews_score", "sig_proximity", "sig_trend", "sig_acceleration", "sig_volatility",
                                "sig_breach_streak", "sig_anomaly_persistence")


@query("ews_level", "E11", "select bank_id, period, ews_level, level_rank, n_in_buffer, n_breached, n_data_gap from ews_tab")
def _level(fx):
    return ews_frame(fx).select("bank_id", "period", "ews_level", "level_rank", "n_in_buffer", "n_breached", "n_data_gap")


@query("ews_drivers", "E12", "select bank_id, period, projected_breach_metric, projected_periods_to_breach, risk_domains, drivers from ews_tab")
def _drivers(fx):
    return ews_frame(fx).select("bank_id", "period", "projected_breach_metric", "projected_periods_to_breach", "risk_domains", "drivers")


@query("ews_score_delta", "E13", "select bank_id, period, prev_score, score_delta, escalating from ews_tab")
def _delta(fx):
    return ews_frame(fx).select("bank_id", "period", "prev_score", "score_delta", "escalating")


fragment("ews_last", "select * from ews_tab where (bank_id, period_ts) in (select bank_id, max(period_ts) from ews_tab group by bank_id)")


@query("ews_latest", "E14", "select bank_id, period, ews_score, ews_level, score_delta, n_breached from ews_last")
def _latest(fx):
    return ews.latest(ews_frame(fx)).select("bank_id", "period", "ews_score", "ews_level", "score_delta", "n_breached")


_MEAN10 = "sum(cast(floor(ews_score * 10 + 0.5) as bigint))::double / count(*) / 10.0::double"
fragment("ews_sys", f"""
select *, {r('mean_ews - lag(mean_ews) over (order by period_ts)', 1)} as mean_ews_mom from (
  select period, period_ts, {r(_MEAN10, 1)} as mean_ews, count(*) as n_banks, count(*) filter (ews_level = 'ALARM') as n_alarm, count(*) filter (ews_level = 'WARNING') as n_warning,
    count(*) filter (level_rank >= 2) as n_warning_plus, {r('count(*) filter (level_rank >= 2) / count(*)::double * 100', 1)} as share_warning_plus,
    case when count(*) filter (level_rank >= 2) / count(*)::double >= 0.3 then 'ALARM' when count(*) filter (level_rank >= 2) / count(*)::double >= 0.2 then 'WARNING'
      when {_MEAN10} >= 40 then 'WATCH' else 'NORMAL' end as system_level from ews_tab group by period, period_ts)""")


@query("ews_system_timeline", "E15", "select * from ews_sys")
def _sys(fx):
    return ews.system_timeline(ews_frame(fx)).drop("system_label")


@query("ews_emerging", "E16", "select bank_id, period, ews_score, score_delta, escalating from ews_last where coalesce(score_delta, 0) >= 12 or escalating")
def _emerging(fx):
    return ews.emerging(ews.latest(ews_frame(fx))).select("bank_id", "period", "ews_score", "score_delta", "escalating")


@query("ews_trajectory", "E17", "select bank_id, string_agg(period, ',' order by period_ts) as periods, string_agg(cast(cast(floor(ews_score * 10 + 0.5) as bigint) as varchar), ',' order by period_ts) as tenths from ews_tab group by bank_id")
def _traj(fx):
    t = ews.trajectory(ews_frame(fx))
    return t.select("bank_id", F.array_join("periods", ",").alias("periods"),
                    F.array_join(F.transform("scores", lambda s: F.floor(s * 10 + 0.5).cast("string")), ",").alias("tenths"))


# ---------------------------------------------------------------- scoring
_PTS = "case severity when 'INFO' then 10.0 when 'LOW' then 25.0 when 'MEDIUM' then 50.0 when 'HIGH' then 75.0 when 'CRITICAL' then 100.0 when 'DATA_GAP' then 70.0 else 0.0 end"
_MUST = ", ".join(f"'{x}'" for x in scoring.mandatory_rules())
fragment("rule_score", f"""
select bank_id, period, cast(max(pts) as double) as rule_violation_score, bool_or(finding_type = 'VIOLATION' and rule_id in ({_MUST})) as has_mandatory_critical,
  cast(coalesce(max(pts) filter (risk_domain = 'credit'), 0) as double) as credit_rule_pts, cast(coalesce(max(pts) filter (risk_domain = 'liquidity'), 0) as double) as liquidity_rule_pts,
  cast(coalesce(max(pts) filter (risk_domain = 'capital'), 0) as double) as capital_rule_pts
from (select *, {_PTS} as pts from finding) where bank_id is not null group by bank_id, period""")


@query("rule_violation_score", "Q01", "select s.*, worst_severity as worst_rule_severity, n_critical, n_high, n_data_gap from (select * exclude (has_mandatory_critical) from rule_score) s join rule_sum using (bank_id, period)")
def _rvs(fx):
    return scoring.rule_violation_score(findings_frame(fx)).drop("has_mandatory_critical")


@query("mandatory_critical_flag", "Q02", "select bank_id, period, has_mandatory_critical from rule_score")
def _must(fx):
    return scoring.rule_violation_score(findings_frame(fx)).select("bank_id", "period", "has_mandatory_critical")


_TS = config.TREND_SCORE_METRICS
fragment("trend_wide", "select bank_id, period, " + ", ".join(f"max(roll_z) filter (metric = '{m}') as z_{m}" for m in _TS)
         + ", " + ", ".join(f"max(qoq) filter (metric = '{m}') as q_{m}" for m in ["profit_before_tax", "toi", "deposits"]) + " from trend group by bank_id, period")
_ADV = [f"(case when z_{m} is not null then greatest(0.0::double, z_{m} * {s}) end)" for m, s in _TS.items()]
_TREND_SCORE = r(f"coalesce({clip('tm', 0, 3)}, 0.0::double) / 3 * 100", 2)
fragment("trend_score", f"select bank_id, period, {_TREND_SCORE} as trend_risk_score from (select *, {null_mean(_ADV)} as tm from trend_wide)")


@query("trend_risk_score", "Q03", "select * from trend_score")
def _trend(fx):
    from prudens.operators.trends import wide_trends
    return wide_trends(fx.features, _TS).select("bank_id", "period", scoring.trend_score_expr().alias("trend_risk_score"))


fragment("flag_map", values(config.FLAG_CLUSTERS, "area, cluster, category"))
fragment("flag_cluster", """
select bank_id, period, count(distinct cluster) filter (area = 'credit') as credit_flag_clusters, count(distinct cluster) filter (area = 'liquidity') as liq_flag_clusters,
  count(distinct cluster) filter (area = 'fraud') as fraud_flag_clusters, coalesce(string_agg(distinct category, ', ' order by category) filter (area = 'fraud'), '') as fraud_flags
from validation left join flag_map using (category) where bank_id is not null and period is not null group by bank_id, period""")


@query("red_flag_clusters", "Q04", "select * from flag_cluster")
def _clusters(fx):
    return scoring.flag_clusters(validation_frame(fx.staged)).drop("has_findings")


fragment("rank_wide", "select bank_id, period, " + ", ".join(f"max(pct_rank) filter (metric = '{m}') as r_{m}" for m in scoring.RANKED) + " from ranked group by bank_id, period")
_C = lambda e: clip(e, 0, 100)
_HIT = lambda col, step: f"(case when coalesce({col}, 0) > 0 then least({col} * {float(step)}::double, 100) end)"
fragment("dom0", f"""
select *, r_mlt_loan_ratio as g_structure, {null_mean(['(100 - r_provision_to_loans)', 'r_credit_cost_ratio'])} as g_provision,
  {null_mean(['r_risky_sector_ratio', 'r_real_estate_loan_ratio', 'r_unsecured_loan_ratio', 'r_large_borrower_ratio', 'r_largest_customer_group_ratio'])} as g_concentration,
  {null_mean(['r_accrued_interest_to_loans', 'r_offbalance_to_assets', _C('bad_offbalance_ratio / 5 * 100')])} as g_offbalance,
  {null_mean([_C('(11 - car_solo) / 3 * 100'), _C('(8 - equity_to_assets) / 8 * 100')])} as g_capital,
  {null_mean(['(100 - r_casa)', '(case when q_deposits < 0 then ' + _C('-q_deposits * 5') + ' end)'])} as g_deposit,
  r_wholesale_funding_share as g_wholesale, 100 - r_liquid_assets_to_deposits as g_secondary,
  {null_mean([_C('abs(rate_sensitive_gap_ratio) / 50 * 100'), _C('abs(fx_position_ratio) / 20 * 100'), _C('(10 - solvency_30d_fx) / 10 * 100')])} as g_market
from feat left join trend_wide using (bank_id, period) left join rank_wide using (bank_id, period) left join rule_score using (bank_id, period) left join flag_cluster using (bank_id, period)""")
_CC = [_C("npl_ratio / 5 * 100"), _C("group2_ratio / 5 * 100"), _C("(100 - llr_coverage) / 100 * 100"), _C("credit_growth_yoy / 40 * 100"), "g_structure", "g_provision", "g_concentration", "g_offbalance"]
_LC = [_C("(ldr - 70) / 30 * 100"), _C("st_funding_for_mlt_loans / 34 * 100"), _C("(20 - liquidity_reserve_ratio) / 20 * 100"), _C("(15 - avg_liquid_asset_ratio) / 15 * 100"), _C("(50 - solvency_30d_vnd) / 50 * 100"), "g_deposit", "g_wholesale", "g_secondary"]
_SUP = lambda core, s: f"(case when coalesce({', '.join(core)}) is not null then {s} end)"
_FR = ["(case when z_npl_ratio < -0.5 and z_group2_ratio > 0.5 then 80.0::double end)", "(case when q_profit_before_tax > 20 and q_toi < 0 then 70.0::double end)",
       _C("(accrued_interest_days - 60) / 120 * 100"), _HIT("fraud_flag_clusters", 30)]
fragment("dom1", f"""
select *, {null_mean(_CC + [_SUP(_CC, 'g_capital'), _HIT('credit_flag_clusters', 25)])} as cs, {null_mean(_LC + [_SUP(_LC, 'g_market'), _HIT('liq_flag_clusters', 25)])} as ls,
  case when coalesce(z_npl_ratio, z_group2_ratio, q_profit_before_tax, q_toi, accrued_interest_days) is not null or fraud_flags is not null then coalesce({null_mean(_FR)}, 0) end as fraud from dom0""")
_BL = lambda s, p: f"(case when {s} is not null then greatest({s}, coalesce({p}, 0)) when coalesce({p}, 0) > 0 then {p} end)"
fragment("dom2", f"select *, {_BL('cs', 'credit_rule_pts')} as credit, {_BL('ls', 'liquidity_rule_pts')} as liquidity from dom1")
_GROUPS = {"credit_structure_score": "g_structure", "credit_provision_score": "g_provision", "credit_concentration_score": "g_concentration", "credit_offbalance_score": "g_offbalance",
           "credit_capital_score": "g_capital", "liq_deposit_score": "g_deposit", "liq_wholesale_score": "g_wholesale", "liq_secondary_score": "g_secondary", "liq_market_score": "g_market"}
_FAIL = null_mean([_C("(10 - car_solo) / 10 * 100"), _C("(8 - equity_to_assets) / 8 * 100"), _C("(0.5 - roa) / 1.0 * 100"), "(credit * 0.5::double)", "(liquidity * 0.5::double)"])
fragment("dom", f"select bank_id, bank_name, period, period_ts, {r('credit', 2)} as credit_risk_score, {r('liquidity', 2)} as liquidity_risk_score, {r('fraud', 2)} as fraud_risk_proxy_score, {r('fail', 2)} as failure_risk_proxy_score, "
         + ", ".join(f"{r(e, 2)} as {n}" for n, e in _GROUPS.items())
         + f", coalesce(credit_flag_clusters, 0) as credit_flag_clusters, coalesce(liq_flag_clusters, 0) as liq_flag_clusters, coalesce(fraud_flag_clusters, 0) as fraud_flag_clusters, coalesce(fraud_flags, '') as fraud_flags from (select *, {_FAIL} as fail from dom2)")


def domains_frame(fx):
    fx = fx.staged
    rs = scoring.rule_violation_score(findings_frame(fx))
    return scoring.domain_scores(scoring.score_inputs(fx.features), rs, scoring.flag_clusters(validation_frame(fx)))


for _name, _row, _cols in [
    ("credit_risk_score", "Q05", ["credit_risk_score", "credit_flag_clusters"]),
    ("credit_sub_scores", "Q06", ["credit_structure_score", "credit_provision_score", "credit_concentration_score", "credit_offbalance_score", "credit_capital_score"]),
    ("liquidity_risk_score", "Q07", ["liquidity_risk_score", "liq_flag_clusters"]),
    ("liquidity_sub_scores", "Q08", ["liq_deposit_score", "liq_wholesale_score", "liq_secondary_score", "liq_market_score"]),
    ("fraud_risk_proxy", "Q09", ["fraud_risk_proxy_score", "fraud_flag_clusters", "fraud_flags"]),
    ("failure_risk_proxy", "Q10", ["failure_risk_proxy_score"]),
]:
    def _mk2(name=_name, row=_row, cols=_cols):
        @query(name, row, f"select bank_id, period, {', '.join(cols)} from dom")
        def _run(fx):
            return domains_frame(fx).select("bank_id", "period", *cols)
    _mk2()

fragment("dq", f"""
select bank_id, period, cast(coalesce(greatest(own, wide), 0) as double) as data_quality_risk_score from wide_m
left join (select bank_id, period, cast(max({_PTS}) as double) as own from validation where period is not null group by bank_id, period) using (bank_id, period)
left join (select bank_id, cast(max({_PTS}) as double) * 0.6::double as wide from validation where period is null and bank_id is not null group by bank_id) using (bank_id)""")


@query("data_quality_score", "Q11", "select * from dq")
def _dq(fx):
    return scoring.data_quality_score(fx.features, validation_frame(fx.staged))


fragment("std_cluster", "select bank_id, peer as cluster_id, 'peer ' || cast(peer as varchar) as cluster_risk_label, 20.0::double * (peer + 1) as cluster_risk_score from fx_inst")
_WT = config.MODEL["weights"]
fragment("comp0", """
select d.*, coalesce(rs.rule_violation_score, 0) as rule_violation_score, coalesce(l.anomaly_score, 0) as anomaly_score_norm, l.anomaly_label, coalesce(t.trend_risk_score, 0) as trend_risk_score,
  c.cluster_id, c.cluster_risk_label, coalesce(c.cluster_risk_score, 0) as cluster_risk_score, coalesce(q.data_quality_risk_score, 0) as data_quality_risk_score,
  coalesce(s.systemic_stress_pct, 0) as systemic_period_risk_score, u.worst_severity as worst_rule_severity, coalesce(rs.has_mandatory_critical, false) as has_mandatory_critical,
  u.n_critical, u.n_high, u.n_data_gap
from dom d left join rule_score rs using (bank_id, period) left join rule_sum u using (bank_id, period) left join std_label l using (bank_id, period)
  left join trend_score t using (bank_id, period) left join std_cluster c using (bank_id) left join dq q using (bank_id, period) left join sys_stress s using (period)""")
fragment("comp1", "select *, " + clip(" + ".join(f"{_WT[c]}::double * {c}" for c in scoring.COMPONENTS), 0, 100)
         + " as weighted_score, case worst_rule_severity when 'CRITICAL' then 90.0 when 'HIGH' then 75.0 when 'MEDIUM' then 50.0 when 'LOW' then 25.0 when 'DATA_GAP' then 70.0 else 0.0 end::double as rule_based_floor from comp0")
fragment("scored", f"""
select *, case when has_mandatory_critical then greatest(s, 90) else s end as final_risk_score,
  case when has_mandatory_critical then 'CRITICAL' when s <= 25 then 'LOW' when s <= 50 then 'MEDIUM' when s <= 75 then 'HIGH' else 'CRITICAL' end as risk_level
from (select *, {r('greatest(weighted_score, rule_based_floor)', 2)} as s from comp1)""")


def clusters_frame(fx):
    """Stand-in clusters: the oracle cannot run K-means."""
    p = F.col("peer")
    return fx.inst.select("bank_id", p.alias("cluster_id"), F.concat(F.lit("peer "), p.cast("string")).alias("cluster_risk_label"),
                          (20.0 * (p + 1)).alias("cluster_risk_score"))


def scores_frame(fx, ranked=False):
    fx = fx.staged
    findings, val = findings_frame(fx), stage(validation_frame(fx), "validation")
    rs = scoring.rule_violation_score(findings)
    dom = scoring.domain_scores(scoring.score_inputs(fx.features), rs, scoring.flag_clusters(val))
    out = scoring.composite(dom, rs, scoring.data_quality_score(fx.features, val), labels_frame(fx), clusters_frame(fx), stress_frame(fx))
    return scoring.with_rank(out) if ranked else out


@query("composite_score", "Q12", f"select bank_id, period, {r('weighted_score')} as weighted_score, rule_based_floor, final_risk_score, {r('systemic_period_risk_score')} as systemic_period_risk_score, data_quality_risk_score, trend_risk_score from scored")
def _comp(fx):
    return scores_frame(fx).select("bank_id", "period", half_up("weighted_score", 4).alias("weighted_score"), "rule_based_floor", "final_risk_score",
                                   half_up("systemic_period_risk_score", 4).alias("systemic_period_risk_score"), "data_quality_risk_score", "trend_risk_score")


@query("risk_level", "Q13", "select bank_id, period, risk_level, has_mandatory_critical, worst_rule_severity from scored")
def _rl(fx):
    return scores_frame(fx).select("bank_id", "period", "risk_level", "has_mandatory_critical", "worst_rule_severity")


@query("risk_rank", "Q14", "select bank_id, period, final_risk_score, rank() over (order by final_risk_score desc) as risk_rank, rank() over (partition by period order by final_risk_score desc) as period_rank from scored")
def _rr(fx):
    scores = stage(scores_frame(fx).select("bank_id", "period", "final_risk_score"), "ranked")
    out = scoring.with_rank(scores)
    within = scoring.with_rank(scores, ["period"]).select("bank_id", "period", F.col("risk_rank").alias("period_rank"))
    return out.join(within, ["bank_id", "period"])


fragment("ranking", "select * from scored where (bank_id, period_ts) in (select bank_id, max(period_ts) from wide_m group by bank_id)")


@query("bank_ranking", "Q15", "select bank_id, period, final_risk_score, risk_level from ranking")
def _br(fx):
    return scoring.bank_ranking(scores_frame(fx)).select("bank_id", "period", "final_risk_score", "risk_level")


# ---------------------------------------------------------------- high-risk periods
fragment("hrp", f"""
select period, period_ts, cast(least(score, 100) as double) as period_risk_score, score >= 35 or (sp >= 75 and rate >= 0.2) as is_high_risk, nc as n_critical_banks, nh as n_high_banks,
  {r('rate * 100', 1)} as anomaly_rate, {r('sp', 1)} as systemic_stress_pct, {r('bw * 100', 1)} as worsen_share, n_banks, domains as risk_domains,
  concat_ws('; ', case when nc > 0 then nc || ' banks with CRITICAL breaches' end, case when nh > 0 then nh || ' banks with HIGH warnings' end,
    case when rate >= 0.2 then 'anomaly rate ' || cast(floor(rate * 100 + 0.5) as bigint) || '%' end, case when sp >= 75 then 'system stress at percentile ' || cast(floor(sp + 0.5) as bigint) end,
    case when bw >= 0.5 then cast(floor(bw * 100 + 0.5) as bigint) || '% worse than the period before' end) as reason
from (select *, case when nc >= 2 then 35 when nc > 0 then 20 else 0 end + case when nh > 0 then least(15, nh * 3) else 0 end + case when rate >= 0.2 then 20 else 0 end
    + case when sp >= 75 then 20 else 0 end + case when bw >= 0.5 then 15 else 0 end as score
  from (select b.period, b.period_ts, b.n_banks, b.mean_worsen_share as bw, coalesce(f.nc, 0) as nc, coalesce(f.nh, 0) as nh, coalesce(f.domains, '') as domains, a.rate, s.systemic_stress_pct as sp
    from breadth b left join (select period, count(distinct bank_id) filter (severity = 'CRITICAL') as nc, count(distinct bank_id) filter (severity = 'HIGH') as nh,
        string_agg(distinct risk_domain, ', ' order by risk_domain) filter (severity in ('CRITICAL', 'HIGH')) as domains from finding where period is not null group by period) f using (period)
      left join (select period, avg(cast(anomaly_label as double)) as rate from std_label group by period) a using (period) left join sys_stress s using (period)))""")
_FOCUS = "concat_ws('; ', " + ", ".join(f"case when list_contains(string_split(risk_domains, ', '), '{d}') then '{t}' end" for d, t in highrisk.AUDIT_FOCUS) + ")"


def periods_frame(fx):
    return highrisk.system_periods(crosssection.period_breadth(fx.features), findings_frame(fx), labels_frame(fx), stress_frame(fx))


@query("high_risk_periods", "H01", "select * exclude (reason) from hrp")
def _hrp(fx):
    return periods_frame(fx).drop("reason", "recommended_audit_focus")


@query("high_risk_reasons", "H02", f"select period, case when reason = '' then '{highrisk.NO_REASON}' else reason end as reason, case when {_FOCUS} = '' then '{highrisk.FALLBACK_FOCUS}' else {_FOCUS} end as recommended_audit_focus from hrp")
def _reasons(fx):
    return periods_frame(fx).select("period", "reason", "recommended_audit_focus")


@query("high_risk_bank_periods", "H03", f"""
select bank_id, period, coalesce(n_critical, 0) as n_critical, coalesce(n_high, 0) as n_high, coalesce(anomaly_label, 0) as is_anomaly, {r('anomaly_score', 1)} as anomaly_score, coalesce(domains, '') as risk_domains
from wide_m left join (select bank_id, period, count(*) filter (severity = 'CRITICAL') as n_critical, count(*) filter (severity = 'HIGH') as n_high,
    string_agg(distinct risk_domain, ', ' order by risk_domain) filter (severity in ('CRITICAL', 'HIGH')) as domains from finding where bank_id is not null group by bank_id, period) using (bank_id, period)
  left join std_label using (bank_id, period) where n_critical > 0 or n_high > 1 or anomaly_label = 1""")
def _hb(fx):
    return highrisk.bank_periods(fx.features, findings_frame(fx), labels_frame(fx))
