"""Views that give the given tables the shape of a bank panel: a supplier plays a bank, a
shipping month a reporting month. The SQL is common to Spark and DuckDB."""
from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

FX_LINE = """
select concat('B', lpad(cast(l_suppkey as string), 6, '0')) as bank_id, cast(l_shipdate as date) as d,
       cast(floor(l_extendedprice * 100 + 0.5E0) as bigint) as p, cast(floor(l_quantity + 0.5E0) as bigint) as q,
       cast(floor(l_discount * 100 + 0.5E0) as bigint) as dc, cast(floor(l_tax * 100 + 0.5E0) as bigint) as tx,
       l_returnflag as rf, l_linestatus as ls, l_linenumber as ln
from lineitem"""

_SUMS = """
  cast(sum(p) as double) / 100.0E0 as e_p, cast(sum(q) as double) as e_q, cast(sum(p * tx) as double) / 10000.0E0 as e_tx,
  cast(sum(p * dc) as double) / 10000.0E0 as e_dc, count(*) as n_rows, cast(sum(p * (tx - 2)) as double) / 10000.0E0 as e_pr, cast(sum(p * (tx - 1)) as double) / 10000.0E0 as e_ni,
  cast(sum(case when rf = 'R' then p * tx end) as double) / 10000.0E0 as e_r, cast(sum(case when rf = 'A' then p end) as double) / 100.0E0 as e_a,
  cast(sum(case when rf = 'N' then p * dc end) as double) / 10000.0E0 as e_n, cast(sum(case when rf = 'N' then q end) as double) as q_n,
  cast(sum(case when ls = 'F' then p * dc end) as double) / 10000.0E0 as e_f, cast(sum(case when ls = 'F' then p end) as double) / 100.0E0 as p_f,
  cast(sum(case when ls = 'O' then p end) as double) / 100.0E0 as p_o, cast(max(p) as double) / 100.0E0 as p_max,
  cast(sum(case when ln = 1 then p end) as double) / 100.0E0 as p1, cast(sum(case when ln = 2 then p end) as double) / 100.0E0 as p2,
  cast(sum(case when ln = 3 then p end) as double) / 100.0E0 as p3, cast(sum(case when ln = 4 then p end) as double) / 100.0E0 as p4,
  cast(sum(case when ln <= 2 then p end) as double) / 100.0E0 as p12, cast(sum(case when ln <= 3 then p end) as double) / 100.0E0 as p13,
  cast(sum(case when ln >= 2 then p end) as double) / 100.0E0 as p27, cast(sum(case when ln >= 3 then p end) as double) / 100.0E0 as p37,
  cast(sum(case when ln >= 4 then p end) as double) / 100.0E0 as p47, cast(sum(case when ln >= 5 then p end) as double) / 100.0E0 as p57,
  cast(sum(case when ln <= 3 then q end) as double) as q13, cast(sum(case when q >= 40 then p end) as double) / 100.0E0 as p_big,
  cast(sum(case when ln >= 4 then p * tx end) as double) / 10000.0E0 as tx47"""

_WIDE_BODY = """
  e_p as customer_loans, e_q * 2900 as deposits, e_dc * 0.5 as npl_amount, e_f * 0.4 as provisions,
  e_p * 1.5 as total_assets, e_tx * 2 + 8000 as equity, e_p * 0.9 as rwa, (e_p - coalesce(p57, 0)) * 0.8 as rwa_credit,
  p_o * 0.35 as hqla, p37 * 0.2 as net_cash_outflow_30d, e_pr * 0.1 as profit_before_tax,
  e_pr * 0.08 as profit_after_tax, e_tx * 0.3 as toi, e_dc * 0.12 as operating_expense,
  e_ni * 0.2 as net_interest_income, e_tx * 0.5 as interest_income, e_n * 0.3 as accrued_interest,
  e_f * 0.1 as credit_provision_expense, p57 * 0.2 as interbank_funding, p3 * 0.3 as valuable_papers_issued,
  p12 as medium_long_term_loans, q13 * 1200 as medium_long_term_funding, p37 as short_term_loans,
  e_tx * 1.5 + 5000 as tier1_capital, (e_tx - coalesce(tx47, 0) * 0.5) * 2 + 7000 as own_capital_solo,
  e_q + 6000 as charter_capital, e_q * 0.5 + 5900 as charter_capital_real, e_a * 0.5 as off_balance_commitments,
  p4 as unsecured_loans, p2 * 0.8 as risky_sector_loans, p_big as top100_customer_loans, p1 * 0.05 as cash_fx_gold,
  p2 * 0.06 as deposits_at_sbv, p57 * 0.1 as interbank_assets, p4 * 0.2 as govbond_investment,
  p13 * 0.5 as rate_sensitive_assets, p27 * 0.45 as rate_sensitive_liabilities,
  case when n_rows % 5 = 0 then 101.5E0 * e_p / (e_q * 2900) end as ldr,
  case when n_rows % 7 <> 0 then 100 * (e_tx * 2 + 8000) / (e_p * 0.9) end as car_solo,
  case when n_rows % 3 = 0 then 95 * (e_tx * 2 + 8000) / (e_p * 0.9) end as car_consolidated,
  case when n_rows % 4 <> 1 then 100 * (e_tx * 1.5 + 5000) / (e_p * 0.9) end as car_tier1,
  e_r / e_p * 100 as group2_ratio, tx47 / e_p * 100 as group5_ratio, p_o / e_p * 23 as liquidity_reserve_ratio,
  p12 / e_p * 100 as st_funding_for_mlt_loans, p47 / e_p * 100 as solvency_30d_vnd, p57 / e_p * 20 as solvency_30d_fx,
  p_f / e_p * 100 as casa, e_a / e_p * 10 as bad_offbalance_ratio, q_n * 2 as accrued_interest_days,
  (coalesce(p13, 0) - coalesce(p47, 0)) / e_p * 30 as fx_position_ratio, p3 / e_p * 40 as real_estate_loan_ratio,
  p_max / e_p * 100 as largest_customer_group_ratio, p_big / e_p * 60 - 10 as credit_growth_yoy,
  case when n_rows % 2 = 0 then p_o / e_p * 25 end as avg_liquid_asset_ratio, p4 / e_p * 45 as govbond_ratio,
  p2 / e_p * 50 as capital_contribution_ratio"""

WIDE_M = f"""
select bank_id, bank_id as bank_name, period, period_ts, {_WIDE_BODY}
from (select bank_id, concat(cast(year(d) as string), '-', lpad(cast(month(d) as string), 2, '0')) as period,
             last_day(d) as period_ts, {_SUMS}
      from fx_line group by bank_id, concat(cast(year(d) as string), '-', lpad(cast(month(d) as string), 2, '0')), last_day(d)) a"""

WIDE_Q = """
select bank_id, bank_id as bank_name, concat(cast(year(d) as string), 'Q', cast(quarter(d) as string)) as period,
  last_day(make_date(year(d), quarter(d) * 3, 1)) as period_ts,
  cast(sum(p * dc) as double) / 10000.0E0 * 0.5 as npl_amount_q, cast(sum(case when ls = 'F' then p * dc end) as double) / 10000.0E0 * 0.4 as provisions,
  cast(sum(p * tx) as double) / 10000.0E0 * 2 + 8000 as equity
from fx_line group by bank_id, concat(cast(year(d) as string), 'Q', cast(quarter(d) as string)), last_day(make_date(year(d), quarter(d) * 3, 1))"""

WIDE_Y = """
select bank_id, bank_id as bank_name, cast(year(d) as string) as period, make_date(year(d), 12, 31) as period_ts,
  cast(sum(p * (tx - 2)) as double) / 10000.0E0 * 0.1 as profit_y, cast(sum(p * dc) as double) / 10000.0E0 * 0.12 as operating_expense
from fx_line group by bank_id, cast(year(d) as string), make_date(year(d), 12, 31)"""

FX_INST = """
select concat('B', lpad(cast(s_suppkey as string), 6, '0')) as bank_id,
  case s_nationkey % 8 when 0 then 'nhtm_nha_nuoc' when 1 then 'nhtm_co_phan' when 2 then 'nh_lien_doanh' when 3 then 'nh_100_von_ngoai'
    when 4 then 'cn_nh_nuoc_ngoai' when 5 then 'cong_ty_tai_chinh' when 6 then 'cong_ty_cho_thue_tai_chinh' end as type,
  s_suppkey % 25 = 0 as special_control, case when s_suppkey % 25 = 0 then 'special control' end as reason,
  cast(s_nationkey % 3 as int) as peer
from supplier"""

FX_VIOLATION = """
select concat('B', lpad(cast(o_custkey % 100 as string), 6, '0')) as object_id, cast(year(o_orderdate) as string) as period,
  substr('CAMELS', cast(o_orderkey % 6 as int) + 1, 1) as group_code,
  o_orderpriority not in ('5-LOW', '4-NOT SPECIFIED') as found_by_authority, o_orderpriority = '4-NOT SPECIFIED' as self_reported,
  o_orderstatus = 'O' as found_in_year, o_orderstatus = 'F' as found_earlier, o_orderkey % 4 = 0 as remediated,
  case when o_orderkey % 3 <> 0 then o_totalprice / 1250.0E0 end as fine_mn,
  cast(1 + o_orderkey % 3 as int) as n_times
from orders"""

FX_FEEDBACK = """
select event_id, ts as feedback_ts, concat('B', lpad(cast(user_id % 100 as string), 6, '0')) as bank_id,
  concat(cast(1992 + event_id % 7 as string), '-', lpad(cast(1 + event_id % 12 as string), 2, '0')) as period,
  case event_type when 'signup' then 'confirmed_anomaly' when 'error' then 'false_positive' when 'click' then 'needs_more_data'
    when 'view' then 'accepted_risk' else 'escalated_to_audit' end as label,
  case when event_id % 3 = 0 then 'rule' else 'anomaly' end as source,
  case event_id % 4 when 0 then 'npl_ratio' when 1 then 'ldr' when 2 then 'car_solo' end as metric
from events"""

FX_PANEL = """
select bank_id, bank_id as bank_name, period, period_ts, 'monthly' as frequency, 'customer_loans' as metric_name, customer_loans as metric_value, 1 as load_order, 'Tổng dư nợ cho vay khách hàng (gộp)' as metric_label, 'Tỷ đồng' as unit, 'A' as camels_group, concat(bank_id, '.csv') as source_file from wide_m
union all select bank_id, bank_id, period, period_ts, 'monthly', 'group2_ratio', group2_ratio, 1, case when month(period_ts) = 3 then 'Ty le no nhom 2' else 'Tỷ lệ nợ Nhóm 2 so với tổng nợ' end, '%', 'A', concat(bank_id, '.csv') from wide_m where group2_ratio is not null
union all select bank_id, bank_id, period, period_ts, 'quarterly', 'provisions', provisions, 1, 'Số dư dự phòng rủi ro tín dụng', 'Tỷ đồng', 'A', concat(bank_id, '.csv') from wide_q where provisions is not null
union all select bank_id, bank_id, period, period_ts, 'yearly', 'profit_y', profit_y, 1, cast(null as string), cast(null as string), cast(null as string), concat(bank_id, '.csv') from wide_y
union all select bank_id, bank_id, period, period_ts, 'monthly', 'customer_loans', customer_loans * 2, 2, 'Tổng dư nợ cho vay khách hàng (gộp)', 'Tỷ đồng', 'A', concat(bank_id, '.csv') from wide_m where month(period_ts) = 6"""

FX_PERIOD_LABEL = """
select distinct concat('T', lpad(cast(month(d) as string), 2, '0'), '/', cast(year(d) as string)) as label, 'monthly' as frequency from fx_line
union select distinct concat('t ', cast(month(d) as string), ' - ', cast(year(d) as string)), 'monthly' from fx_line
union select distinct concat('Q', cast(quarter(d) as string), '/', cast(year(d) as string)), 'quarterly' from fx_line
union select distinct concat('Năm ', cast(year(d) as string)), 'yearly' from fx_line
union select distinct cast(year(d) as string), 'monthly' from fx_line
union select distinct concat(lpad(cast(day(d) as string), 2, '0'), '/', lpad(cast(month(d) as string), 2, '0'), '/', cast(year(d) as string)), case when day(d) % 2 = 0 then 'daily' else 'monthly' end from fx_line
union select 'không phải kỳ', 'monthly' union select '31/02/2024', 'daily' union select 'T13/2024', 'monthly'"""

VIEWS = {"fx_line": FX_LINE, "wide_m": WIDE_M, "wide_q": WIDE_Q, "wide_y": WIDE_Y, "fx_inst": FX_INST,
         "fx_violation": FX_VIOLATION, "fx_feedback": FX_FEEDBACK, "fx_panel": FX_PANEL, "fx_period_label": FX_PERIOD_LABEL}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def wide_metrics() -> list[str]:
    """Reported metric columns of ``wide_m`` in order."""
    return re.findall(r" as (\w+)", _WIDE_BODY)


class Fixtures:
    """The views as lazy DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir.rstrip("/"), {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            sql = VIEWS[name]
            used = [n for n in [*VIEWS, *TABLES] if re.search(rf"\b{n}\b", sql)]
            for n in used:
                sql = re.sub(rf"\b{n}\b", "{" + n + "}", sql)
            frames = {n: self.view(n) if n in VIEWS else self.table(n) for n in used}
            self._made[name] = self.spark.sql(sql, **frames)
        return self._made[name]

    @cached_property
    def features(self) -> DataFrame:
        from prudens.operators.ratios import derive_ratios
        return derive_ratios(self.view("wide_m"))

    @cached_property
    def staged(self) -> "Fixtures":
        """The same fixtures with features and monthly table written as one table, and the panel, when first read, for queries that read them many times."""
        return _Staged(self)

    @cached_property
    def inst(self) -> DataFrame:
        return self.view("fx_inst")


class _Staged(Fixtures):
    def __init__(self, source: Fixtures):
        super().__init__(source.spark, source.sf_dir)
        self._source = source

    def view(self, name: str) -> DataFrame:
        if name in ("fx_panel", "wide_m") and name not in self._made:
            from prudens.plans.staging import stage
            self._made[name] = self._monthly[1] if name == "wide_m" else stage(super().view(name), "panel")
        return super().view(name)

    @cached_property
    def _monthly(self) -> tuple[DataFrame, DataFrame]:
        """Features and the monthly table, written as one: the features hold all reported columns but those that ratios fill."""
        from prudens.operators.ratios import DERIVED, derive_ratios
        from prudens.plans.staging import stage
        wide = self._source.view("wide_m")
        features = derive_ratios(wide)
        filled = [c for c in wide.columns if c in DERIVED]
        # a reported value is its own column beside the ratio that coalesces it
        both = derive_ratios(wide.selectExpr("*", *[f"{c} as _reported_{c}" for c in filled]))
        both = stage(both.select(*features.columns, *[f"_reported_{c}" for c in filled]), "features")
        return both.select(*features.columns), both.selectExpr(*[f"_reported_{c} as {c}" if c in filled else c for c in wide.columns])

    @cached_property
    def features(self) -> DataFrame:
        return self._monthly[0]

    @cached_property
    def staged(self) -> "Fixtures":
        return self
