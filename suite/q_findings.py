"""As-of merge, rules, validation, red flags."""
from __future__ import annotations

from pyspark.sql import functions as F

from prudens import config
from prudens.functions.numeric import half_up
from prudens.operators import asof, redflags, rules, validation
from prudens.operators.ratios import DERIVED, ratio_gaps
from prudens.sources import settings
from suite.fixtures import wide_metrics
from suite.oracle import fragment, r, unpivot, values
from suite.registry import query
import suite.q_features  # noqa: F401  (fragments)

IDS = config.ID_COLS
ALL_METRICS = [c for c in wide_metrics() if c != "ldr"] + DERIVED

# ---------------------------------------------------------------- as-of merge
fragment("asof_q", """
select m.bank_id, m.period, m.period_ts, q.period_ts as matched_ts, q.npl_amount_q as npl_amount_q, q.provisions as provisions_q, q.equity as equity_q
from wide_m m asof left join wide_q q on m.bank_id = q.bank_id and m.period_ts >= q.period_ts""")
fragment("asof_y", """
select m.bank_id, m.period, m.period_ts, y.period_ts as matched_ts, y.profit_y, y.operating_expense as operating_expense_y
from wide_m m asof left join wide_y y on m.bank_id = y.bank_id and m.period_ts >= y.period_ts""")
BASE_COLS = ["bank_id", "bank_name", "period", "period_ts", "customer_loans", "provisions", "operating_expense"]


def _base(fx):
    return fx.view("wide_m").select(*BASE_COLS)


@query("asof_base_frequency", "A01", "select case when (select count(*) from wide_m) > 0 then 'monthly' end as base_frequency")
def _base_freq(fx):
    wide = {"monthly": fx.view("wide_m"), "quarterly": fx.view("wide_q"), "yearly": fx.view("wide_y")}
    chosen = asof.base_frequency(wide)
    return fx.view("wide_m").agg(F.when(F.count(F.lit(1)) > 0, chosen).alias("base_frequency"))


@query("asof_backward_quarterly", "A02", f"""
select bank_id, period, case when date_diff('day', matched_ts, period_ts) <= 130 then matched_ts end as matched_ts,
  {r("case when date_diff('day', matched_ts, period_ts) <= 130 then npl_amount_q end")} as npl_amount_q,
  {r("case when date_diff('day', matched_ts, period_ts) <= 130 then provisions_q end")} as provisions_q from asof_q""")
def _asof_q(fx):
    out = asof.asof_backward(_base(fx), fx.view("wide_q"), ["npl_amount_q", "provisions"], 130)
    return out.select("bank_id", "period", F.col("_matched_ts").alias("matched_ts"),
                      half_up("_asof_npl_amount_q", 4).alias("npl_amount_q"), half_up("_asof_provisions", 4).alias("provisions_q"))


@query("asof_backward_yearly", "A02", f"""
select bank_id, period, case when date_diff('day', matched_ts, period_ts) <= 430 then matched_ts end as matched_ts,
  {r("case when date_diff('day', matched_ts, period_ts) <= 430 then profit_y end")} as profit_y from asof_y""")
def _asof_y(fx):
    out = asof.asof_backward(_base(fx), fx.view("wide_y"), ["profit_y"], 430)
    return out.select("bank_id", "period", F.col("_matched_ts").alias("matched_ts"), half_up("_asof_profit_y", 4).alias("profit_y"))


fragment("combined", """
select m.bank_id, m.period, m.period_ts, m.customer_loans, coalesce(m.provisions, q.provisions_f) as provisions,
  coalesce(m.operating_expense, y.operating_expense_f) as operating_expense, q.npl_amount_q_f as npl_amount_q, q.equity_f as equity, y.profit_y_f as profit_y,
  case when m.provisions is not null then 'monthly' when q.provisions_f is not null then 'quarterly' end as from_provisions
from wide_m m
left join (select bank_id, period, case when date_diff('day', matched_ts, period_ts) <= 130 then npl_amount_q end as npl_amount_q_f,
             case when date_diff('day', matched_ts, period_ts) <= 130 then provisions_q end as provisions_f,
             case when date_diff('day', matched_ts, period_ts) <= 130 then equity_q end as equity_f from asof_q) q using (bank_id, period)
left join (select bank_id, period, case when date_diff('day', matched_ts, period_ts) <= 430 then profit_y end as profit_y_f,
             case when date_diff('day', matched_ts, period_ts) <= 430 then operating_expense_y end as operating_expense_f from asof_y) y using (bank_id, period)""")


def combined_frame(fx):
    return asof.combine({"monthly": _base(fx), "quarterly": fx.view("wide_q"), "yearly": fx.view("wide_y")}, base="monthly")


@query("combined_fill", "A03", f"select bank_id, period, {r('provisions')} as provisions, {r('operating_expense')} as operating_expense, from_provisions from combined")
def _combined_fill(fx):
    return combined_frame(fx).select("bank_id", "period", half_up("provisions", 4).alias("provisions"),
                                     half_up("operating_expense", 4).alias("operating_expense"),
                                     F.col("_from_provisions").alias("from_provisions"))


@query("combined_new_metrics", "A04", f"select bank_id, period, {r('npl_amount_q')} as npl_amount_q, {r('equity')} as equity, {r('profit_y')} as profit_y from combined")
def _combined_new(fx):
    return combined_frame(fx).select("bank_id", "period", *[half_up(c, 4).alias(c) for c in ["npl_amount_q", "equity", "profit_y"]])


_BY_FREQ = {"monthly": ["customer_loans", "provisions", "operating_expense"], "quarterly": ["npl_amount_q", "provisions", "equity"],
            "yearly": ["profit_y", "operating_expense"]}
fragment("prov_tab", """
select * from (values ('customer_loans', 'monthly', 'monthly', false), ('npl_amount_q', 'quarterly', 'quarterly', false),
  ('equity', 'quarterly', 'quarterly', false), ('profit_y', 'yearly', 'yearly', false)) as t(metric, primary_frequency, sources, is_cross_frequency)
union all select 'provisions', 'monthly', case when count(*) filter (from_provisions = 'quarterly') > 0 then 'monthly, quarterly' else 'monthly' end,
  count(*) filter (from_provisions = 'quarterly') > 0 from combined
union all select 'operating_expense', 'monthly', 'monthly', false""")


@query("combined_provenance", "A05", "select * from prov_tab")
def _prov(fx):
    return asof.provenance(combined_frame(fx), _BY_FREQ, "monthly")


@query("combined_provenance_counts", "A06", "select primary_frequency, count(*) as n_metrics from prov_tab group by primary_frequency")
def _prov_counts(fx):
    return asof.provenance_counts(asof.provenance(combined_frame(fx), _BY_FREQ, "monthly"))


# ---------------------------------------------------------------- rules
fragment("flat_rule", values(config.FLAT_RULES, ", ".join(config.FLAT_RULE_FIELDS)))
fragment("tier_rule", values(config.TIERED_RULES, ", ".join(config.TIERED_RULE_FIELDS)))
fragment("tier", values([(k, t, *v) for k, by in config.RULE_TIERS.items() for t, v in by.items()], "rule_id, type, n1, n2, n3"))
RULE_METRICS = sorted({x[5] for x in config.FLAT_RULES + config.TIERED_RULES} & set(ALL_METRICS))
fragment("rule_long", unpivot("feat", "bank_id, bank_name, period, period_ts", RULE_METRICS))
fragment("flat_hit", """
select l.*, f.rule_id, f.severity as rule_severity, f.risk_domain, f.status, f.rule_name, f.operator, f.lo, f.hi, f.legal_source, value is null as gap
from rule_long l join flat_rule f using (metric)
where (value is null and f.severity = 'CRITICAL') or case operator when '<' then value < lo when '>' then value > lo when 'outside_range' then value < lo or value > hi end""")
fragment("tier_hit", """
select *, case when direction = 'lower_riskier' then case when value < n3 then 3 when value < n2 then 2 when value < n1 then 1 end
               else case when value > n3 then 3 when value > n2 then 2 when value > n1 then 1 end end as lvl
from rule_long join (select bank_id, type from fx_inst where type is not null and not special_control) using (bank_id)
  join tier_rule using (metric) join tier using (rule_id, type)""")
fragment("finding", """
select bank_id, period, period_ts, rule_id, rule_name, metric, case when gap then null else value end as metric_value,
  case when gap then 'DATA_GAP' else rule_severity end as severity, status, risk_domain, case when gap then 'DATA_GAP' else 'VIOLATION' end as finding_type, legal_source from flat_hit
union all select bank_id, period, period_ts, rule_id, rule_name, metric, value,
  case when value is null then 'DATA_GAP' when lvl = 3 then 'CRITICAL' when lvl = 2 then 'HIGH' else 'MEDIUM' end, status, risk_domain,
  case when value is null then 'DATA_GAP' when lvl = 3 then 'VIOLATION' when lvl = 2 then 'WARNING' else 'WATCH' end, legal_source
from tier_hit where value is null or lvl is not null
union all select bank_id, period, period_ts, 'SPECIAL_CONTROL_NO_THRESHOLD', 'No thresholds under special control', null, null, 'INFO', 'ACTIVE', 'governance', 'SPECIAL_CONTROL', 'QĐ 682/QĐ-TTGSNH4'
from wide_m where bank_id in (select bank_id from fx_inst where special_control)
union all select bank_id, period, period_ts, 'INSTITUTION_TYPE_UNKNOWN', 'Institution type unknown', null, null, 'DATA_GAP', 'ACTIVE', 'governance', 'DATA_GAP', 'QĐ 682/QĐ-TTGSNH4'
from wide_m where bank_id not in (select bank_id from fx_inst where type is not null or special_control)
union all select null, null, null, rule_id, rule_name, metric, null, 'DATA_GAP', status, risk_domain, 'DATA_GAP', legal_source from tier_rule where metric = 'tctcvm_solvency_ratio'""")
SHOW = "bank_id, period, rule_id, metric, " + r("metric_value") + " as metric_value, severity, finding_type, risk_domain"


def _show(df):
    return df.select("bank_id", "period", "rule_id", "metric", half_up("metric_value", 4).alias("metric_value"), "severity",
                     "finding_type", "risk_domain")


def findings_frame(fx):
    return rules.evaluate_rules(fx.features, fx.inst)


_OPS = [("cmp_lt", "npl_ratio", "<", 2.0, None, "value < 2.0"), ("cmp_le", "ldr", "<=", 80.0, None, "value <= 80.0"),
        ("cmp_gt", "npl_ratio", ">", 3.0, None, "value > 3.0"), ("cmp_ge", "ldr", ">=", 85.0, None, "value >= 85.0"),
        ("cmp_eq", "st_funding_for_mlt_loans", "==", 100.0, None, "value = 100.0"), ("cmp_ne", "st_funding_for_mlt_loans", "!=", 100.0, None, "value <> 100.0"),
        ("between", "car_solo", "between", 8.0, 9.5, "value between 8.0 and 9.5"),
        ("outside_range", "fx_position_ratio", "outside_range", -20.0, 20.0, "value < -20.0 or value > 20.0"),
        ("missing", "group2_ratio", "missing", None, None, "value is null"),
        ("increasing_fast", "npl_ratio", "increasing_fast", None, None, "(value - prev) / abs(nullif(prev, 0)) * 100 >= 25"),
        ("decreasing_fast", "ldr", "decreasing_fast", 30.0, None, "(value - prev) / abs(nullif(prev, 0)) * 100 <= -30")]
_OP_ROWS = {"between": "R02", "outside_range": "R03", "missing": "R04", "increasing_fast": "R05", "decreasing_fast": "R05"}
_OP_LONG = unpivot("feat", "bank_id, period, period_ts", sorted({o[1] for o in _OPS}))
for _name, _metric, _op, _lo, _hi, _cond in _OPS:
    def _make(name=_name, metric=_metric, op=_op, lo=_lo, hi=_hi, cond=_cond):
        @query(f"rule_op_{name}", _OP_ROWS.get(name, "R01"),
               f"select bank_id, period, {r('value')} as metric_value from (select *, lag(value) over (partition by bank_id, metric order by period_ts) as prev from ({_OP_LONG})) where metric = '{metric}' and ({cond})")
        def _run(fx):
            spec = [("T", "t", "s", "a", "credit", metric, op, lo, hi, "HIGH", "ACTIVE")]
            return rules.evaluate_flat(fx.features, spec).select("bank_id", "period", half_up("metric_value", 4).alias("metric_value"))
    _make()


@query("rules_flat_violations", "R06", f"select {SHOW} from finding where finding_type = 'VIOLATION' and rule_id not like 'QD%'")
def _flat(fx):
    return _show(rules.evaluate_flat(fx.features).where("finding_type = 'VIOLATION'"))


@query("rules_data_gaps", "R07", f"select {SHOW} from finding where finding_type = 'DATA_GAP' and rule_id not like 'QD%' and rule_id <> 'INSTITUTION_TYPE_UNKNOWN'")
def _gaps(fx):
    return _show(rules.evaluate_flat(fx.features).where("finding_type = 'DATA_GAP'"))


@query("rules_system_gaps", "R08", "select rule_id, metric, 'DATA_GAP' as severity, 'DATA_GAP' as finding_type from (select rule_id, metric, severity from flat_rule union all select rule_id, metric, severity from tier_rule) where severity = 'CRITICAL' and metric not in (select metric_name from fx_panel)")
def _sysgaps(fx):
    reported = fx.view("fx_panel").select(F.col("metric_name").alias("metric")).distinct()
    return rules.system_gaps(fx.features, reported=reported).select("rule_id", "metric", "severity", "finding_type")


@query("rules_tiered", "R09", f"select {SHOW} from finding where rule_id like 'QD%' and bank_id is not null")
def _tiered(fx):
    return _show(rules.evaluate_tiered(fx.features, fx.inst))


@query("rules_special_control", "R10", f"select {SHOW} from finding where finding_type = 'SPECIAL_CONTROL'")
def _special(fx):
    return _show(rules.special_control(fx.features, fx.inst))


@query("rules_unclassified", "R11", f"select {SHOW} from finding where rule_id = 'INSTITUTION_TYPE_UNKNOWN'")
def _unclassified(fx):
    return _show(rules.unclassified(fx.features, fx.inst))


_BAD_TIERS = {**config.RULE_TIERS, "QD682_LDR": {"nhtm_nha_nuoc": (83.0, 80.0, 85.0), "nhtm_co_phan": (80.0, 83.0, 85.0)}}


@query("rules_findings", "R06 R07 R08 R09 R10 R11", f"select {SHOW} from finding")
def _all_findings(fx):
    return _show(findings_frame(fx))


fragment("rule_sum", """
select bank_id, period, max(period_ts) as period_ts, case when max(o) is not null then list_extract(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], max(o) + 1)
    when count(*) filter (severity = 'DATA_GAP') > 0 then 'DATA_GAP' else 'INFO' end as worst_severity,
  count(*) filter (severity = 'CRITICAL') as n_critical, count(*) filter (severity = 'HIGH') as n_high, count(*) filter (severity = 'MEDIUM') as n_medium,
  count(*) filter (severity = 'LOW') as n_low, count(*) filter (severity = 'DATA_GAP') as n_data_gap, count(*) as n_findings
from (select *, case severity when 'INFO' then 0 when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 when 'CRITICAL' then 4 end as o from finding)
where bank_id is not null group by bank_id, period""")


@query("rules_summary", "R13", "select * from rule_sum")
def _summary(fx):
    return rules.summarize(findings_frame(fx)).drop("bank_name")


@query("tier_breaches_latest", "R09 R13 K01", """
select f.bank_id, f.period, f.rule_id, f.severity, f.finding_type, """ + r("metric_value") + """ as metric_value from finding f
join (select bank_id, max(period_ts) as period_ts from wide_m group by bank_id) l using (bank_id, period_ts)
where f.rule_id like 'QD%' and f.finding_type <> 'DATA_GAP'""")
def _flagship(fx):
    from prudens.operators.cluster import latest_snapshot
    hits = rules.evaluate_tiered(latest_snapshot(fx.features), fx.inst).where("finding_type <> 'DATA_GAP'")
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).otherwise(2)
    return hits.orderBy(rank, "bank_id", "rule_id").select("bank_id", "period", "rule_id", "severity", "finding_type",
                                                           half_up("metric_value", 4).alias("metric_value"))


# ---------------------------------------------------------------- validation
@query("validation_duplicates", "V01", "select 'DUPLICATE' as category, 'MEDIUM' as severity, bank_id, period, metric_name as metric from fx_panel group by bank_id, frequency, period, metric_name having count(*) > 1")
def _dups(fx):
    return validation.duplicates(fx.view("fx_panel")).drop("message")


@query("validation_short_history", "V02", "select 'SHORT_HISTORY' as category, 'HIGH' as severity, bank_id, cast(n as varchar) || ' ' || frequency as detail from (select bank_id, frequency, count(distinct period) as n from fx_panel group by bank_id, frequency) where n < 30")
def _short(fx):
    out = validation.short_history(fx.view("fx_panel"), 30)
    return out.select("category", "severity", "bank_id", F.regexp_replace(
        F.regexp_extract("message", r"short history: (.*)", 1), " periods,", "").alias("detail"))


fragment("missing_p", """
with s as (select distinct bank_id, frequency, period, period_ts, year(period_ts) * 12 + month(period_ts) - 1 as m,
             case frequency when 'monthly' then 1 when 'quarterly' then 3 when 'yearly' then 12 end as step from fx_panel),
  e as (select bank_id, frequency, step, unnest(generate_series(min(m), max(m), step)) as m from s group by bank_id, frequency, step having count(distinct period) >= 3)
select bank_id, frequency, m, row_number() over (partition by bank_id, frequency order by m) as rn,
  case when frequency = 'yearly' then cast(m // 12 as varchar) else cast(m // 12 as varchar) || '-' || lpad(cast(m % 12 + 1 as varchar), 2, '0') end as period
from e where not exists (select 1 from s where s.bank_id = e.bank_id and s.frequency = e.frequency
  and case when e.frequency = 'yearly' then s.m // 12 = e.m // 12 else s.m = e.m end)""")


@query("validation_missing_periods", "V03", "select 'MISSING_PERIOD' as category, 'MEDIUM' as severity, bank_id, period from missing_p")
def _missing(fx):
    return validation.missing_periods(fx.view("fx_panel")).select("category", "severity", "bank_id", "period")


fragment("neg", " union all ".join(f"select bank_id, period, '{m}' as metric, {m} as v from feat where {m} < 0" for m in config.NON_NEGATIVE))


# the nine amounts, and three columns of the data that do fall below zero
NEGATIVE_CHECKED = list(dict.fromkeys([*config.NON_NEGATIVE, "profit_before_tax", "funding_gap", "equity"]))


@query("validation_negative", "V04", f"select bank_id, period, metric, {r('v', 2)} as value from (" + " union all ".join(
    f"select bank_id, period, '{m}' as metric, {m} as v from feat where {m} < 0" for m in NEGATIVE_CHECKED) + ")")
def _neg(fx):
    out = validation.negatives(fx.features, NEGATIVE_CHECKED)
    return out.select("bank_id", "period", "metric").join(
        _long_values(fx, NEGATIVE_CHECKED), ["bank_id", "period", "metric"])


def _long_values(fx, metrics):
    from prudens.functions.reshape import to_long
    return to_long(fx.features, ["bank_id", "period"], metrics).select("bank_id", "period", "metric", half_up("value", 2).alias("value"))


fragment("oor", " union all ".join(f"select bank_id, period, '{m}' as metric, {m} as v from feat where {m} < {lo} or {m} > {hi}"
                                   for m, (lo, hi) in config.PLAUSIBLE_RANGES.items()))


@query("validation_out_of_range", "V05", "select 'OUT_OF_RANGE' as category, 'MEDIUM' as severity, bank_id, period, metric from oor")
def _oor(fx):
    return validation.out_of_range(fx.features).drop("message")


@query("validation_missing_legal_metric", "V06", "select metric, 'HIGH' as severity from scope where metric not in (select metric_name from fx_panel)")
def _absent(fx):
    reported = fx.view("fx_panel").select(F.col("metric_name").alias("metric")).distinct()
    return validation.missing_legal_metrics(fx.features, validation.legal_scope(fx.spark), reported).select("metric", "severity")


fragment("scope", """
select metric, case when bool_or(type is null) then null else string_agg(distinct type, ',' order by type) end as types
from (select metric, null as type from flat_rule where severity = 'CRITICAL' union all select metric, type from tier_rule join tier using (rule_id)) group by metric""")


@query("validation_legal_scope", "V07", "select metric, types, count(bank_id) as n_banks from scope left join fx_inst on types is null or list_contains(string_split(types, ','), type) group by metric, types")
def _scope(fx):
    """The institutions each legally required metric binds."""
    scope = validation.legal_scope(fx.spark)
    per_type = fx.inst.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    bound = scope.join(per_type, F.col("types").isNull() | F.array_contains("types", F.col("type")), "left")
    return bound.groupBy("metric", F.array_join("types", ",").alias("types")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_banks"))


fragment("legal_gap", """
select bank_id, metric, share, case when share >= 0.8 then 'CRITICAL' else 'HIGH' end as severity
from (select bank_id, metric, avg(case when value is null then 1.0::double else 0.0::double end) as share from rule_long group by bank_id, metric)
join scope using (metric) left join fx_inst using (bank_id)
where share >= 0.5 and (types is null or list_contains(string_split(types, ','), type))""")


@query("validation_legal_data_gap", "V08", "select bank_id, metric, severity from legal_gap")
def _legal_gap(fx):
    return validation.legal_data_gaps(fx.features, validation.legal_scope(fx.spark), fx.inst, RULE_METRICS).select("bank_id", "metric", "severity")


fragment("not_eval", """
select bank_id, metric, 'not evaluated in ' || cast(n as varchar) || ' periods (' || shown || ')' as message
from (select bank_id, metric, count(*) as n, array_to_string(list_sort(list(distinct period)), ', ') as shown from ratio_gap group by bank_id, metric)""")


@query("validation_ratio_not_evaluated", "V09", "select * from not_eval")
def _not_eval(fx):
    return validation.ratios_not_evaluated(ratio_gaps(fx.view("wide_m"))).select("bank_id", "metric", "message")


_NULLS = " + ".join(f"(case when {m} is null then 1 else 0 end)" for m in ALL_METRICS)


@query("validation_high_missing_period", "V10", f"select bank_id, period, cast(floor(({_NULLS}) / {len(ALL_METRICS)}.0::double * 100 + 0.5) as bigint) as pct from feat where ({_NULLS}) / {len(ALL_METRICS)}.0::double >= 0.3")
def _high_missing(fx):
    out = validation.high_missing_periods(fx.features, ALL_METRICS, 0.3)
    return out.select("bank_id", "period", F.regexp_extract("message", r"(\d+)%", 1).cast("bigint").alias("pct"))


# ---------------------------------------------------------------- red flags
_W = "over (partition by bank_id order by period_ts)"
fragment("rf_carry", "select bank_id, period, period_ts, row_number() " + _W + " as rn, "
         + ", ".join(f"last_value({c} ignore nulls) over (partition by bank_id order by period_ts rows between unbounded preceding and current row) as f_{c}" for c in redflags._CARRIED)
         + ", " + ", ".join(f"{c} as c_{c}, lag({c}) {_W} as rp_{c}" for c in sorted({*redflags.RAW_GROWTH, *redflags.RAW_LEVELS, "ldr"}))
         + ", " + ", ".join(f"{c} > lag({c}, 1 ignore nulls) {_W} and lag({c}, 1 ignore nulls) {_W} > lag({c}, 2 ignore nulls) {_W} as up_{c}" for c in redflags.RISING)
         + " from feat")
fragment("rf_prev", "select *, " + ", ".join(f"lag(f_{c}) {_W} as p_{c}" for c in redflags._CARRIED) + ", "
         + ", ".join(f"lead(f_{c}) {_W} as n_{c}, avg(f_{c}) over (partition by bank_id order by period_ts rows between 3 preceding and 1 preceding) as b_{c}" for c in redflags.WINDOW_DRESSING)
         + " from rf_carry")
fragment("rf_in", f"select *, lag(g_deposits) {_W} as gp_deposits from (select *, "
         + ", ".join(f"(f_{c} / nullif(p_{c}, 0) - 1) * 100 as g_{c}" for c in redflags.GROWTH) + ", "
         + ", ".join(f"(c_{c} / nullif(rp_{c}, 0) - 1) * 100 as rg_{c}" for c in redflags.RAW_GROWTH) + " from rf_prev)")
_UP = lambda c, by: f"f_{c} > p_{c} + {by}"
_DN = lambda c, by: f"f_{c} < p_{c} - {by}"
_SUB = "g_deposits < 0 and (coalesce(g_valuable_papers_issued > 15, false) or coalesce(g_interbank_funding > 20, false))"


def _or(*conds):
    return "(" + " or ".join(f"coalesce({c}, false)" for c in conds) + ")"


_DRESS = {c: f"rn >= 4 and b_{c} > 0 and f_{c} / b_{c} - 1 > 0.3 and n_{c} < b_{c} * 1.1" for c in redflags.WINDOW_DRESSING}
FLAG_SQL = [
    ("F01", "HOT_CREDIT_WEAK_SUPPORT", "HIGH", "null", f"rg_customer_loans > 10 and {_or('rg_equity < rg_customer_loans / 2', 'c_liquidity_reserve_ratio < rp_liquidity_reserve_ratio')}"),
    ("F02", "NPL_DROP_DIVERGENCE", "HIGH", "null", f"c_npl_ratio < rp_npl_ratio and {_or('c_group2_ratio > rp_group2_ratio', 'rg_provisions < -10')}"),
    ("F03", "PROFIT_UP_OPS_DOWN", "MEDIUM", "null", f"rg_profit_before_tax > 10 and {_or('rg_toi < 0', 'c_npl_ratio > rp_npl_ratio')}"),
    ("F04", "LDR_HIGH_DEPOSIT_STRESS", "HIGH", "null", "c_ldr > 80 and rg_deposits < -5"),
    ("F05", "CREDIT_GROWTH_CAPITAL_GAP", "HIGH", "'customer_loans'", f"g_customer_loans > 10 and {_or('g_tier1_capital < g_customer_loans / 2', 'g_own_capital_solo < g_customer_loans / 2', _DN('car_solo', 0.2))}"),
    ("F06", "CREDIT_GROWTH_RWA_DIVERGENCE", "MEDIUM", "'rwa_credit'", "g_customer_loans > 10 and g_rwa_credit < g_customer_loans / 3"),
    ("F07", "NPL_GROUP2_MIGRATION", "MEDIUM", "'group2_ratio'", _or("up_group2_ratio", "f_npl_ratio < p_npl_ratio and f_group2_ratio >= p_group2_ratio + 0.2")),
    ("F08", "PROVISION_LAG", "HIGH", "'provisions'", f"{_or('g_npl_amount > 10', _UP('group5_ratio', 0.2))} and {_or('g_provisions < case when g_npl_amount > 10 then g_npl_amount / 2 else 0 end', _DN('llr_coverage', 2))}"),
    *[("F09", "CONCENTRATION_BUILDUP", "MEDIUM", f"'{c}'", _UP(c, 2)) for c in redflags.CONCENTRATION],
    ("F10", "ACCRUED_INTEREST_CREDIT_STRESS", "HIGH", "'accrued_interest'", f"{_or('g_accrued_interest > 10', _UP('accrued_interest_days', 5))} and {_or(_UP('group2_ratio', 0), _UP('npl_ratio', 0))}"),
    ("F11", "HQLA_OUTFLOW_STRESS", "HIGH", "'hqla'", "g_hqla < -5 and g_net_cash_outflow_30d > 5"),
    ("F12", "DEPOSIT_CASA_STRESS", "HIGH", "'deposits'", f"{_or('g_deposits < 0 and gp_deposits < 0', _DN('casa', 1))} and f_ldr > 80"),
    ("F13", "WHOLESALE_FUNDING_SUBSTITUTION", "MEDIUM", "'wholesale_funding_share'", _SUB),
    ("F14", "FUNDING_SOURCE_SWAP", "MEDIUM", "'wholesale_funding_share'", f"{_SUB} and {_or('abs(f_ldr - p_ldr) <= 2', 'f_solvency_30d_vnd >= p_solvency_30d_vnd - 2')}"),
    ("F15", "MATURITY_MISMATCH_BUILDUP", "MEDIUM", "'st_funding_for_mlt_loans'", _or("g_medium_long_term_loans > g_medium_long_term_funding + 5 and g_medium_long_term_loans > 5", "up_st_funding_for_mlt_loans")),
    ("F16", "FX_LIQUIDITY_DIVERGENCE", "MEDIUM", "'solvency_30d_fx'", f"{_DN('solvency_30d_fx', 5)} and f_solvency_30d_vnd >= p_solvency_30d_vnd - 1"),
    ("F17", "INTEREST_RATE_GAP_LIQUIDITY", "MEDIUM", "'rate_sensitive_gap_ratio'", f"abs(f_rate_sensitive_gap_ratio) > 30 and {_DN('liquidity_reserve_ratio', 1)}"),
    ("F18", "ACCRUED_INTEREST_PROFIT_DIVERGENCE", "HIGH", "'accrued_interest'", f"{_or('g_accrued_interest > 15', _UP('accrued_interest_days', 10))} and {_or('g_profit_before_tax > 10', 'g_net_interest_income > 10')} and {_or('g_toi <= 0', 'f_nim <= p_nim')}"),
    ("F19", "NPL_GROUP2_PROVISION_DIVERGENCE", "HIGH", "'npl_ratio'", _or(f"f_npl_ratio < p_npl_ratio and {_or(_UP('group2_ratio', 0.2), _UP('group5_ratio', 0.2))}", f"f_npl_ratio > p_npl_ratio and {_or('g_provisions < -5', _DN('llr_coverage', 5))}")),
    ("F20", "OFFBALANCE_RISK_SHIFT", "MEDIUM", "'off_balance_commitments'", f"f_npl_ratio < p_npl_ratio and {_or('g_off_balance_commitments > 15', _UP('bad_offbalance_ratio', 0.5))}"),
    ("F21", "CAPITAL_COMPONENT_MISMATCH", "HIGH", "'car_solo'", _or(f"{_UP('car_solo', 0.2)} and {_or('g_tier1_capital < -1', 'g_own_capital_solo < -1', 'g_rwa > 5')}", "f_charter_capital > 0 and (f_charter_capital - f_charter_capital_real) / f_charter_capital * 100 > 10")),
    ("F22", "YEAR_END_LIQUIDITY_WINDOW_DRESSING", "MEDIUM", "case " + " ".join(f"when {d} then '{c}'" for c, d in _DRESS.items()) + " end", _or(*_DRESS.values())),
]
fragment("flag", " union all ".join(f"select '{c}' as category, '{s}' as severity, bank_id, period, {m} as metric from rf_in where rn > 1 and {cond}"
                                    for _, c, s, m, cond in FLAG_SQL))
for _row, _cat in dict((x[0], x[1]) for x in FLAG_SQL).items():
    def _mk(row=_row, cat=_cat):
        @query("flag_" + cat.lower(), row, f"select bank_id, period, severity, metric from flag where category = '{cat}'")
        def _run(fx):
            return redflags.red_flags(fx.features, [cat]).select("bank_id", "period", "severity", "metric")
    _mk()


@query("red_flags_all", "F01-F22", "select * from flag")
def _flags(fx):
    return redflags.red_flags(fx.features).drop("message")


fragment("validation", """
select category, severity, bank_id, period, metric from flag
union all select 'DUPLICATE', 'MEDIUM', bank_id, period, metric_name from fx_panel group by bank_id, frequency, period, metric_name having count(*) > 1
union all select 'SHORT_HISTORY', 'HIGH', bank_id, null, null from (select bank_id, frequency, count(distinct period) as n from fx_panel group by bank_id, frequency) where n < 3
union all select 'MISSING_PERIOD', 'MEDIUM', bank_id, period, null from missing_p
union all select 'NEGATIVE', 'HIGH', bank_id, period, metric from neg
union all select 'OUT_OF_RANGE', 'MEDIUM', bank_id, period, metric from oor
union all select 'MISSING_LEGAL_METRIC', 'HIGH', null, null, metric from (select distinct metric from tier_rule where metric = 'tctcvm_solvency_ratio')
union all select 'DATA_GAP_LEGAL', severity, bank_id, null, metric from legal_gap
union all select 'RATIO_NOT_EVALUATED', 'INFO', bank_id, null, metric from not_eval
union all select 'HIGH_MISSING_PERIOD', 'MEDIUM', bank_id, period, null from feat where (""" + _NULLS + f") / {len(ALL_METRICS)}.0::double >= 0.6")


def validation_frame(fx):
    return validation.run_all(fx.view("fx_panel"), fx.features, fx.inst, ratio_gaps(fx.view("wide_m")), ALL_METRICS)


@query("validation_all", "V11", "select category, severity, bank_id, period, metric from validation")
def _val_all(fx):
    return validation_frame(fx.staged).drop("message")


@query("validation_category_counts", "V11", "select category, count(*) as n from validation group by category")
def _val_counts(fx):
    return validation.category_counts(validation_frame(fx.staged))
