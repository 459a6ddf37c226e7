"""Derived ratios, trends, cross-section and systemic stress."""
from __future__ import annotations

from pyspark.sql import functions as F

from prudens import config
from prudens.functions import sqltext
from prudens.functions.numeric import half_up
from prudens.functions.reshape import to_long
from prudens.operators import crosssection, features, ratios, trends
from suite.fixtures import wide_metrics
from suite.oracle import fragment, null_sum, r, unpivot, values
from suite.registry import query

IDS = config.ID_COLS
WIDE = wide_metrics()


def _pct(num: str, den: str) -> str:
    return f"(100.0::double * ({num}) / (case when ({den}) > 0 then ({den}) end))"


_L, _A, _D = "customer_loans", "total_assets", "deposits"
_WHOLESALE = null_sum("interbank_funding", "valuable_papers_issued")
_FUNDING = null_sum("deposits", "interbank_funding", "valuable_papers_issued")
_LIQUID = null_sum("cash_fx_gold", "deposits_at_sbv", "interbank_assets", "govbond_investment")
RATIO_SQL = {
    "equity_to_assets": (_pct("equity", _A), None), "ldr": (_pct(_L, _D), 200), "npl_ratio": (_pct("npl_amount", _L), 100),
    "llr_coverage": (_pct("provisions", "npl_amount"), None), "roa": (_pct("profit_after_tax", _A), None),
    "roe": (_pct("profit_after_tax", "equity"), None), "cir": (_pct("operating_expense", "toi"), None),
    "nim": (_pct("net_interest_income", _A), None), "short_loan_ratio": (_pct("short_term_loans", _L), 100),
    "mlt_loan_ratio": (_pct("medium_long_term_loans", _L), 100), "provision_to_loans": (_pct("provisions", _L), 100),
    "credit_cost_ratio": (_pct("credit_provision_expense", _L), None),
    "accrued_interest_to_loans": (_pct("accrued_interest", _L), None),
    "accrued_interest_to_interest_income": (_pct("accrued_interest", "interest_income"), None),
    "offbalance_to_assets": (_pct("off_balance_commitments", _A), None),
    "unsecured_loan_ratio": (_pct("unsecured_loans", _L), 100), "risky_sector_ratio": (_pct("risky_sector_loans", _L), 100),
    "large_borrower_ratio": (_pct("top100_customer_loans", _L), 100),
    "wholesale_funding_share": (_pct(_WHOLESALE, _FUNDING), 100),
    "liquid_assets_to_deposits": (_pct(_LIQUID, _D), 200),
    "rate_sensitive_gap_ratio": (_pct("rate_sensitive_assets - rate_sensitive_liabilities", "equity"), None),
    "funding_gap": ("customer_loans - deposits", None),
    "interest_sensitive_gap": ("rate_sensitive_assets - rate_sensitive_liabilities", None),
}


def _derived(name: str) -> str:
    expr, ceiling = RATIO_SQL[name]
    kept = expr if ceiling is None else f"(case when {expr} <= {ceiling} then {expr} end)"
    return f"coalesce(ldr, {kept}) as ldr" if name == "ldr" else f"{kept} as {name}"


fragment("feat", "select bank_id, bank_name, period, period_ts, " + ", ".join(c for c in WIDE if c != "ldr") + ", "
         + ", ".join(_derived(n) for n in RATIO_SQL) + " from wide_m")
fragment("ratio_gap", " union all ".join(
    f"select bank_id, period, '{n}' as metric, {e} as derived_value, {c}.0::double as ceiling from wide_m where {e} > {c}"
    for n, (e, c) in RATIO_SQL.items() if c))


def ratio_query(name: str, rows: str, metrics: list[str]) -> None:
    cols = ", ".join(f"{r(m)} as {m}" for m in metrics)

    @query(name, rows, f"select bank_id, period, {cols} from feat")
    def _run(fx):
        return fx.features.select("bank_id", "period", *[half_up(m, 4).alias(m) for m in metrics])


for _row, _metrics in {
    "D01": ["equity_to_assets"], "D02": ["ldr"], "D03": ["npl_ratio"], "D04": ["llr_coverage"], "D05": ["roa"],
    "D06": ["roe"], "D07": ["cir"], "D08": ["nim"], "D09": ["rate_sensitive_gap_ratio"], "D10": ["short_loan_ratio"],
    "D11": ["mlt_loan_ratio"], "D12": ["provision_to_loans"], "D13": ["credit_cost_ratio"],
    "D14": ["accrued_interest_to_loans"], "D15": ["accrued_interest_to_interest_income"], "D16": ["offbalance_to_assets"],
    "D17": ["unsecured_loan_ratio"], "D18": ["risky_sector_ratio"], "D19": ["large_borrower_ratio"],
    "D20": ["wholesale_funding_share"], "D21": ["liquid_assets_to_deposits"], "D22": ["funding_gap"],
    "D23": ["interest_sensitive_gap"],
}.items():
    ratio_query("ratio_" + _metrics[0], _row, _metrics)


@query("ratio_gaps", "D24", f"select bank_id, period, metric, {r('derived_value')} as derived_value, ceiling, "
       "'DENOMINATOR_COLLAPSED' as reason from ratio_gap")
def _ratio_gaps(fx):
    return ratios.ratio_gaps(fx.view("wide_m")).withColumn("derived_value", half_up("derived_value", 4))


@query("base_metric_selection", "D25",
       "select metric, " + r("share") + " as non_null_share from (select metric, avg(case when value is not null then 1.0::double else 0.0::double end) as share "
       "from (" + unpivot("feat", "bank_id", [c for c in WIDE if c != "ldr"] + list(RATIO_SQL)) + ") group by metric) where share >= 0.5")
def _base_metrics(fx):
    long = to_long(fx.features, ["bank_id"], [c for c in WIDE if c != "ldr"] + list(RATIO_SQL))
    kept = ratios.base_metrics(fx.features, [c for c in WIDE if c != "ldr"] + list(RATIO_SQL), 0.5)
    return (long.where(F.col("metric").isin(kept)).groupBy("metric")
            .agg(half_up(F.avg(F.col("value").isNotNull().cast("double")), 4).alias("non_null_share")))


TREND_METRICS = ["npl_ratio", "group2_ratio", "ldr", "st_funding_for_mlt_loans", "cir", "credit_growth_yoy", "car_solo",
                 "car_consolidated", "roa", "roe", "liquidity_reserve_ratio", "llr_coverage", "solvency_30d_vnd",
                 "profit_before_tax", "toi", "deposits"]
fragment("trend_long", unpivot("feat", "bank_id, bank_name, period, period_ts", TREND_METRICS))
fragment("trend", """
select *, qoq - lag(qoq) over g as accel from (
  select *, case when f1 <> 0 then (f / f1 - 1) * 100 end as qoq, case when fy <> 0 then (f / fy - 1) * 100 end as yoy,
    case when roll_std <> 0 then (value - roll_mean) / roll_std end as roll_z,
    case when value is not null and peak <> 0 then (value - peak) / peak * 100 end as drawdown from (
    select *, lag(f) over g as f1, lag(f, 4) over g as fy from (
      select *, case when count(value) over g4 >= 2 then avg(value) over g4 end as roll_mean,
        case when count(value) over g4 >= 2 then stddev_samp(value) over g4 end as roll_std,
        last_value(value ignore nulls) over gu as f, max(value) over gu as peak
      from trend_long
      window g4 as (partition by bank_id, metric order by period_ts rows between 3 preceding and current row),
             gu as (partition by bank_id, metric order by period_ts rows between unbounded preceding and current row))
    window g as (partition by bank_id, metric order by period_ts)))
window g as (partition by bank_id, metric order by period_ts)""")


def trend_frame(fx, metrics=None):
    return trends.trend_features(to_long(fx.features, IDS, metrics or TREND_METRICS, cluster_by=["bank_id"]))


for _c, _row in [("roll_mean", "W01"), ("roll_std", "W02"), ("roll_z", "W03"), ("qoq", "W04"), ("yoy", "W05"),
                 ("accel", "W06"), ("drawdown", "W07")]:
    def _make(c=_c, row=_row):
        @query(f"trend_{c}", row, f"select bank_id, period, metric, {r(c)} as {c} from trend")
        def _run(fx):
            return trend_frame(fx).select("bank_id", "period", "metric", half_up(c, 4).alias(c))
    _make()


@query("metric_series", "W08",
       "select period, period_ts, metric, " + ", ".join(f"{r(c)} as {c}" for c in ["value", "roll_mean", "roll_std", "roll_z", "drawdown"])
       + " from trend where bank_id = 'B000007' and metric = 'npl_ratio'")
def _metric_series(fx):
    s = trends.metric_series(to_long(fx.features, IDS, ["npl_ratio"]), "B000007", "npl_ratio")
    return s.select("period", "period_ts", "metric", *[half_up(c, 4).alias(c) for c in
                                                       ["value", "roll_mean", "roll_std", "roll_z", "drawdown"]])


XMETRICS = ["npl_ratio", "group2_ratio", "ldr", "car_solo", "car_consolidated", "roa", "liquidity_reserve_ratio"]
RANKED = ["mlt_loan_ratio", "provision_to_loans", "credit_cost_ratio", "risky_sector_ratio", "real_estate_loan_ratio",
          "unsecured_loan_ratio", "large_borrower_ratio", "largest_customer_group_ratio", "accrued_interest_to_loans",
          "offbalance_to_assets", "casa", "wholesale_funding_share", "liquid_assets_to_deposits"]
_RANK = ("(rank() over (partition by period, metric order by value nulls last) + (count(value) over (partition by period, metric, value) - 1) / 2.0::double)"
         " / count(value) over (partition by period, metric) * 100")
fragment("cross_long", unpivot("feat", "bank_id, bank_name, period, period_ts", XMETRICS))
fragment("cross_feat", f"""
select *, case when sd <> 0 then (value - med) / sd end as z_cross, value - med as dev_sys_median from (
  select *, case when value is not null then {_RANK} end as pct_rank,
    quantile_cont(value, 0.5) over (partition by period, metric) as med, stddev_samp(value) over (partition by period, metric) as sd
  from cross_long)""")
fragment("rank_long", unpivot("feat", "bank_id, bank_name, period, period_ts", RANKED))
fragment("ranked", f"select *, case when value is not null then {_RANK} end as pct_rank from rank_long")


def _cross(fx, column):
    long = to_long(fx.features, IDS, XMETRICS)
    return crosssection.pct_ranks(long) if column == "pct_rank" else crosssection.systemic_features(long)


for _c, _row in [("pct_rank", "X01"), ("dev_sys_median", "X02"), ("z_cross", "X03")]:
    def _make2(c=_c, row=_row):
        @query(f"cross_{c}", row, f"select bank_id, period, metric, {r(c)} as {c} from cross_feat")
        def _run(fx):
            return _cross(fx, c).select("bank_id", "period", "metric", half_up(c, 4).alias(c))
    _make2()

STRESS_METRICS = list(config.STRESS_INDEX_METRICS)
fragment("stress_sign", values([(m, float(s)) for m, s in config.STRESS_INDEX_METRICS.items()], "metric, sign"))
fragment("stress_long", unpivot("feat", "bank_id, period, period_ts", STRESS_METRICS))
fragment("stress_index", """
select period, period_ts, avg(sign * mz) as systemic_stress_index from (
  select period, period_ts, metric, sign, avg((value - mu) / sd) as mz, count(value) as n
  from stress_long join (select metric, avg(value) as mu, nullif(stddev_pop(value), 0) as sd from stress_long group by metric) using (metric)
       join stress_sign using (metric)
  group by period, period_ts, metric, sign) where n >= 3 group by period, period_ts""")
fragment("sys_stress", """
select period, period_ts, n_banks, systemic_stress_index,
  case when systemic_stress_index is not null then
    (rank() over (order by systemic_stress_index nulls last) + (count(systemic_stress_index) over (partition by systemic_stress_index) - 1) / 2.0::double)
    / count(systemic_stress_index) over () * 100 end as systemic_stress_pct
from (select period, period_ts, count(distinct bank_id) as n_banks from wide_m group by period, period_ts)
left join stress_index using (period, period_ts)""")


def stress_frame(fx):
    return crosssection.systemic_stress(to_long(fx.features, IDS, STRESS_METRICS))


@query("systemic_stress_index", "X04",
       f"select period, period_ts, n_banks, {r('systemic_stress_index')} as systemic_stress_index from sys_stress")
def _stress_index(fx):
    """Pooled baseline; the within-period baseline is zero by construction and stays available."""
    return stress_frame(fx).select("period", "period_ts", "n_banks", half_up("systemic_stress_index", 4).alias("systemic_stress_index"))


@query("systemic_stress_percentile", "X05", f"select period, {r('systemic_stress_pct')} as systemic_stress_pct from sys_stress")
def _stress_pct(fx):
    return stress_frame(fx).select("period", half_up("systemic_stress_pct", 4).alias("systemic_stress_pct"))


@query("high_risk_period_flag", "X06",
       "select bank_id, period, cast(coalesce(systemic_stress_pct >= 75, false) as int) as high_risk_period_flag from wide_m join sys_stress using (period)")
def _flag(fx):
    flags = crosssection.high_risk_flag(stress_frame(fx)).select("period", "high_risk_period_flag")
    return fx.view("wide_m").select("bank_id", "period").join(flags, "period").select("bank_id", "period", "high_risk_period_flag")


_MOVE = {m: f"({m} - lag({m}) over w) * {s}" for m, s in config.WATCH_METRICS.items()}
fragment("breadth", "select period, period_ts, avg(s) as mean_worsen_share, count(distinct bank_id) as n_banks from (select bank_id, period, period_ts, coalesce(("
         + " + ".join(f"case when d_{m} > 0 then 1 else 0 end" for m in _MOVE) + ") / nullif(" + " + ".join(f"case when d_{m} is not null then 1 else 0 end" for m in _MOVE)
         + ", 0)::double, 0) as s from (select bank_id, period, period_ts, " + ", ".join(f"{e} as d_{m}" for m, e in _MOVE.items())
         + " from feat window w as (partition by bank_id order by period_ts))) group by period, period_ts")


@query("period_breadth", "X07", f"select period, period_ts, {r('mean_worsen_share')} as mean_worsen_share, n_banks from breadth")
def _breadth(fx):
    return crosssection.period_breadth(fx.features).withColumn("mean_worsen_share", half_up("mean_worsen_share", 4))


# ------------------------------------------------------------- the whole feature table
EVERY = [c for c in WIDE if c != "ldr"] + list(RATIO_SQL)
_SUFFIXES = [*features.TRENDS, *features.CROSS]
fragment("every_long", f"select *, list_position([{', '.join(repr(c) for c in EVERY)}], metric) as ord from (" + unpivot("feat", "bank_id, bank_name, period, period_ts", EVERY) + ")")
fragment("every_trend", """
select *, qoq - lag(qoq) over g as accel, (value - roll_mean) / nullif(roll_std, 0) as roll_z, (value - peak) / nullif(peak, 0) * 100 as drawdown from (
  select *, (f / nullif(lag(f) over g, 0) - 1) * 100 as qoq, (f / nullif(lag(f, 4) over g, 0) - 1) * 100 as yoy from (
    select *, case when count(value) over g4 >= 2 then avg(value) over g4 end as roll_mean, case when count(value) over g4 >= 2 then stddev_samp(value) over g4 end as roll_std,
      last_value(value ignore nulls) over gu as f, max(value) over gu as peak
    from every_long window g4 as (partition by bank_id, metric order by period_ts rows between 3 preceding and current row),
           gu as (partition by bank_id, metric order by period_ts rows between unbounded preceding and current row))
  window g as (partition by bank_id, metric order by period_ts))
window g as (partition by bank_id, metric order by period_ts)""")
fragment("every_feat", f"""
select *, case when value is not null then {_RANK} end as pct_rank, value - med as dev_sys_median, (value - med) / nullif(sd, 0) as z_cross from (
  select *, quantile_cont(value, 0.5) over (partition by period, metric) as med, stddev_samp(value) over (partition by period, metric) as sd from every_trend)""")
fragment("every_row", "select bank_id, period, list(struct_pack(" + ", ".join(f"{c} := {r(c)}" for c in ("value", *_SUFFIXES)) + ") order by ord) as l from every_feat group by bank_id, period")


@query("feature_table", "D25 W01 W02 W03 W04 W05 W06 W07 X01 X02 X03 X06", "select e.bank_id, e.period, " + ", ".join(f"l[{k}].value as {m}, " + ", ".join(f"l[{k}].{x} as {m}__{x}" for x in _SUFFIXES) for k, m in enumerate(EVERY, 1))
       + f", {r('systemic_stress_index')} as systemic_stress_index, {r('systemic_stress_pct')} as systemic_stress_pct, cast(coalesce(systemic_stress_pct >= 75, false) as int) as high_risk_period_flag from every_row e join sys_stress using (period)")
def _feature_table(fx):
    """Every base metric with all its features, a column each."""
    table, base = features.build_features(fx.view("wide_m"))
    cols = [x for m in base for x in (m, *[f"{m}__{s}" for s in _SUFFIXES])] + ["systemic_stress_index", "systemic_stress_pct"]
    return table.selectExpr("bank_id", "period", *[f"{sqltext.half_up(c, 4)} as {c}" for c in cols], "high_risk_period_flag")
