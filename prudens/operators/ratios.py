"""Ratios derived from reported components; reported values are never overwritten."""
from __future__ import annotations

from pyspark.sql import DataFrame

from prudens import config
from prudens.functions import sqltext
from prudens.functions.reshape import ensure_columns
from prudens.functions.stats import null_share

# name: (numerator components, denominator components); the value is 100 * sum / sum.
PERCENT_RATIOS = {
    "equity_to_assets": (["equity"], ["total_assets"]),
    "ldr": (["customer_loans"], ["deposits"]),
    "npl_ratio": (["npl_amount"], ["customer_loans"]),
    "llr_coverage": (["provisions"], ["npl_amount"]),
    "roa": (["profit_after_tax"], ["total_assets"]),
    "roe": (["profit_after_tax"], ["equity"]),
    "cir": (["operating_expense"], ["toi"]),
    "nim": (["net_interest_income"], ["total_assets"]),
    "short_loan_ratio": (["short_term_loans"], ["customer_loans"]),
    "mlt_loan_ratio": (["medium_long_term_loans"], ["customer_loans"]),
    "provision_to_loans": (["provisions"], ["customer_loans"]),
    "credit_cost_ratio": (["credit_provision_expense"], ["customer_loans"]),
    "accrued_interest_to_loans": (["accrued_interest"], ["customer_loans"]),
    "accrued_interest_to_interest_income": (["accrued_interest"], ["interest_income"]),
    "offbalance_to_assets": (["off_balance_commitments"], ["total_assets"]),
    "unsecured_loan_ratio": (["unsecured_loans"], ["customer_loans"]),
    "risky_sector_ratio": (["risky_sector_loans"], ["customer_loans"]),
    "large_borrower_ratio": (["top100_customer_loans"], ["customer_loans"]),
    "wholesale_funding_share": (["interbank_funding", "valuable_papers_issued"],
                                ["deposits", "interbank_funding", "valuable_papers_issued"]),
    "liquid_assets_to_deposits": (["cash_fx_gold", "deposits_at_sbv", "interbank_assets", "govbond_investment"],
                                  ["deposits"]),
}
DIFFERENCES = {"funding_gap": ("customer_loans", "deposits"),
               "interest_sensitive_gap": ("rate_sensitive_assets", "rate_sensitive_liabilities")}
GAP_RATIO = "rate_sensitive_gap_ratio"
DERIVED = [*PERCENT_RATIOS, GAP_RATIO, *DIFFERENCES]
COMPONENTS = sorted({c for parts in PERCENT_RATIOS.values() for side in parts for c in side}
                    | {c for pair in DIFFERENCES.values() for c in pair})


def _raw(name: str) -> str:
    """The derived value before its ceiling. Divisors must be positive, so no division by zero."""
    if name in DIFFERENCES:
        return " - ".join(DIFFERENCES[name])
    if name == GAP_RATIO:
        return "100D * (rate_sensitive_assets - rate_sensitive_liabilities) / (case when equity > 0 then equity end)"
    num, den = (side[0] if len(side) == 1 else sqltext.total(side) for side in PERCENT_RATIOS[name])
    return f"100D * {num} / (case when {den} > 0 then {den} end)"


def derive_ratios(wide: DataFrame) -> DataFrame:
    """Fill only the missing cells of each ratio; a derived value above its ceiling stays missing."""
    given = set(wide.columns)
    base = ensure_columns(wide, COMPONENTS)
    out = []
    for name in DERIVED:
        ceiling = config.RATIO_CEILINGS.get(name)
        value = _raw(name) if ceiling is None else f"case when {_raw(name)} <= {ceiling}D then {_raw(name)} end"
        out.append((f"coalesce(cast({name} as double), {value})" if name in given else f"({value})") + f" as {name}")
    return base.selectExpr(*[c for c in wide.columns if c not in DERIVED], *out)


def ratio_gaps(wide: DataFrame) -> DataFrame:
    """One row per derived value dropped at its ceiling, whether or not a reported value stood in."""
    base = ensure_columns(wide, COMPONENTS)
    hits = ", ".join(f"struct('{n}' as metric, {_raw(n)} as value, {c}D as ceiling)" for n, c in config.RATIO_CEILINGS.items())
    return (base.selectExpr("bank_id", "period", f"explode(filter(array({hits}), h -> h.value > h.ceiling)) as h")
            .selectExpr("bank_id", "period", "h.metric", "'DENOMINATOR_COLLAPSED' as reason", "h.value as derived_value", "h.ceiling"))


def base_metrics(features: DataFrame, candidates: list[str], min_ratio: float | None = None) -> list[str]:
    """Candidates populated in at least ``min_ratio`` of the rows."""
    floor = config.MODEL["min_non_null_ratio"] if min_ratio is None else min_ratio
    shares = null_share(features, candidates)
    return [c for c in candidates if shares[c] >= floor]
