"""Capital and liquidity stress of every bank-period under each scenario."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prudens import config
from prudens.functions.numeric import half_up, positive
from prudens.functions.reshape import ensure_columns
from prudens.functions.tables import literal_table
from prudens.operators.cluster import latest_snapshot

SOURCES = ["customer_loans", "total_loans", "deposits", "total_deposits", "npl_ratio", "npl_amount", "car_solo",
           "car_consolidated", "own_capital_solo", "tier1_capital", "equity", "rwa", "rwa_credit", "hqla",
           "interbank_funding", "short_term_funding", "ldr", "total_assets"]


def _first_nonzero(*names: str) -> Column:
    """First value that is neither missing nor zero; the last candidate is taken as it stands."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit(0.0)) for n in names[:-1]], F.col(names[-1]))


def stress_inputs(features: DataFrame) -> DataFrame:
    """Balance-sheet quantities with their fallbacks, and the data gaps that rule a test out."""
    df = ensure_columns(features, SOURCES)
    plausible = lambda c: F.when((c >= 1.0) & (c <= 50.0), c)
    step1 = df.select(
        *config.ID_COLS, F.coalesce("customer_loans", "total_loans").alias("loans"),
        _first_nonzero("deposits", "total_deposits").alias("_dep"), "npl_ratio",
        plausible(F.coalesce("car_solo", "car_consolidated")).alias("_car"),
        positive(_first_nonzero("own_capital_solo", "tier1_capital", "equity")).alias("_own"),
        positive(_first_nonzero("rwa", "rwa_credit")).alias("_rwa"), "hqla", "npl_amount", "interbank_funding",
        "short_term_funding", F.coalesce(F.nullif("total_assets", F.lit(0.0)), F.coalesce("customer_loans", "total_loans")).alias("total_assets"))
    # CAR = own funds / RWA: any two give the third
    step2 = step1.select(
        "*", F.coalesce("_rwa", F.col("_own") / (F.col("_car") / 100.0)).alias("_rwa2"))
    step3 = step2.select("*", F.coalesce(F.col("_car"), F.col("_own") / F.col("_rwa2") * 100.0).alias("_car2"))
    step4 = step3.select("*", F.coalesce(F.col("_own"), F.col("_car2") / 100.0 * F.col("_rwa2")).alias("_own2"))
    capital_ok = plausible(F.col("_car2")).isNotNull() & (F.col("_own2") != 0) & (F.col("_rwa2") != 0)
    base_ldr = F.col("loans") / positive("_dep") * 100.0
    liquidity_ok = (F.col("loans") != 0) & base_ldr.between(1.0, 400.0)
    wholesale = F.coalesce("interbank_funding", F.when(F.col("short_term_funding").isNotNull(), F.greatest(
        F.lit(0.0), F.col("short_term_funding") - F.coalesce("_dep", F.lit(0.0)))))
    step5 = step4.select(
        *config.ID_COLS, "loans", F.when(liquidity_ok, F.col("_dep")).alias("deposits"), "npl_ratio",
        F.coalesce("npl_amount", F.col("loans") * F.col("npl_ratio") / 100.0).alias("npl_amount"),
        F.when(capital_ok, F.col("_car2")).alias("car"), F.when(capital_ok, F.col("_own2")).alias("own_funds"),
        F.when(capital_ok, F.col("_rwa2")).alias("rwa"), "hqla", wholesale.alias("wholesale"), "total_assets")
    gaps = F.concat_ws(",", F.when(F.col("own_funds").isNull(), "capital"),
                       F.when(F.col("deposits").isNull() | F.col("loans").isNull(), "liquidity"))
    return step5.select("*", gaps.alias("data_gaps"))


def scenario_table(spark, scenarios=None) -> DataFrame:
    ddl = ("scenario_id string, scenario_name string, npl_shock_pp double, rwa_shock double, lgd double, "
           "deposit_runoff double, wholesale_runoff double, hqla_haircut double")
    return literal_table(spark, ddl, config.SCENARIOS if scenarios is None else scenarios)


def run_scenarios(inputs: DataFrame, scenarios: DataFrame, params: dict | None = None) -> DataFrame:
    """One row per bank-period and scenario; the scenarios are a literal handful, attached per row."""
    p = {**config.STRESS, **(params or {})}
    df = inputs.crossJoin(F.broadcast(scenarios))
    c = F.col
    cap_ok = ~F.contains("data_gaps", F.lit("capital")) & c("loans").isNotNull() & c("npl_ratio").isNotNull()
    loss = c("loans") * c("npl_shock_pp") / 100.0 * c("lgd")
    df = df.select("*", cap_ok.alias("_cap"), (~F.contains("data_gaps", F.lit("liquidity"))).alias("_liq"), loss.alias("_loss"),
                   (c("own_funds") - loss).alias("_own1"), (c("rwa") * (1.0 + c("rwa_shock"))).alias("_rwa1"),
                   (c("deposits") * c("deposit_runoff") + F.coalesce("wholesale", F.lit(0.0)) * c("wholesale_runoff")).alias("_out"),
                   (c("hqla") * (1.0 - c("hqla_haircut"))).alias("_avail"),
                   (c("deposits") * (1.0 - c("deposit_runoff"))).alias("_dep1"))
    df = df.select("*", (c("own_funds") / c("rwa") * 100.0).alias("_car0"), (c("_own1") / c("_rwa1") * 100.0).alias("_car1"),
                   (c("_liq") & c("hqla").isNotNull() & (c("_out") > 0) & F.lit(bool(p["use_hqla"]))).alias("_lcr_ok"),
                   (c("loans") / positive("_dep1") * 100.0).alias("_ldr1"))
    cap = lambda x: F.when(c("_cap"), x)
    lcr = F.when(c("_lcr_ok"), c("_avail") / F.nullif("_out", F.lit(0.0)) * 100.0)
    by_ldr = c("_liq") & ~c("_lcr_ok")
    zero = F.lit(0.0)
    return df.select(
        *config.ID_COLS, "scenario_id", "scenario_name", "total_assets", "data_gaps",
        F.when(c("_cap"), "OK").otherwise("DATA_GAP").alias("capital_status"),
        cap(half_up("_car0", 2)).alias("baseline_car"), cap(half_up("_car1", 2)).alias("stressed_car"),
        cap(half_up(c("_car1") - c("_car0"), 2)).alias("car_delta"), cap(half_up("_loss", 1)).alias("credit_loss"),
        cap(half_up(F.greatest(zero, F.lit(p["min_car"]) / 100.0 * c("_rwa1") - c("_own1")), 1)).alias("capital_shortfall"),
        cap(c("_car1") >= p["min_car"]).alias("passes_capital"),
        F.when(c("_liq"), "OK").otherwise("DATA_GAP").alias("liquidity_status"),
        F.when(c("_lcr_ok"), "LCR").when(by_ldr, "STRESSED_LDR").alias("liq_method"),
        half_up(lcr, 1).alias("stressed_lcr"),
        F.when(by_ldr, half_up(c("loans") / c("deposits") * 100.0, 1)).alias("baseline_ldr"),
        F.when(by_ldr, half_up("_ldr1", 1)).alias("stressed_ldr"),
        F.when(c("_lcr_ok"), half_up(F.greatest(zero, c("_out") - c("_avail")), 1)).when(
            by_ldr, half_up(F.greatest(zero, c("loans") - c("_dep1")), 1)).alias("liquidity_gap"),
        F.when(c("_lcr_ok"), half_up("_out", 1)).when(by_ldr, half_up(c("deposits") * c("deposit_runoff"), 1)).alias("deposit_outflow"),
        F.when(c("_lcr_ok"), lcr >= p["lcr_min"]).when(
            by_ldr, F.coalesce(c("_ldr1") <= p["stressed_ldr_limit"], F.lit(False))).alias("passes_liquidity"))


def breaking_points(inputs: DataFrame, params: dict | None = None) -> DataFrame:
    """Reverse stress: extra NPL points that bring CAR down to its minimum."""
    p = {**config.STRESS, **(params or {})}
    usable = ~F.contains("data_gaps", F.lit("capital")) & (F.col("loans") != 0)
    cushion = F.col("own_funds") - F.lit(p["min_car"]) / 100.0 * F.col("rwa")
    pp = F.when(cushion <= 0, 0.0).otherwise(half_up(cushion / (F.nullif("loans", F.lit(0.0)) * p["lgd"]) * 100.0, 2))
    return inputs.select(*config.ID_COLS, half_up("car", 2).alias("baseline_car"), F.when(usable, pp).alias("breaking_npl_pp"),
                         F.when(usable, cushion <= 0).alias("already_below_min"))


def snapshot_period(features: DataFrame) -> DataFrame:
    """One row: the commonest latest period over banks, the earliest on a tie."""
    last = latest_snapshot(features.select("bank_id", "period", "period_ts"))
    counts = last.groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("period", F.struct((-F.col("n")).alias("n"), "period")).alias("period"))


def system_summary(results: DataFrame) -> DataFrame:
    """Per scenario: how many banks were assessed and failed, what is missing, what share of assets fails."""
    cap, liq = F.col("capital_status") == "OK", F.col("liquidity_status") == "OK"
    cap_fail, liq_fail = cap & ~F.col("passes_capital"), liq & ~F.col("passes_liquidity")
    total = F.sum(F.when(cap, F.col("total_assets")))
    share = F.when(total != 0, half_up(F.coalesce(F.sum(F.when(cap_fail, F.col("total_assets"))), F.lit(0.0)) / total * 100, 1)).otherwise(0.0)
    money = lambda cond, c: half_up(F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0)), 1)
    return results.groupBy("scenario_id", "scenario_name").agg(
        F.count_if(cap).alias("n_assessed_capital"), F.count_if(cap_fail).alias("n_fail_capital"),
        money(cap_fail, "capital_shortfall").alias("total_capital_shortfall"),
        half_up(F.min(F.when(cap, F.col("stressed_car"))), 2).alias("min_stressed_car"),
        half_up(F.avg(F.when(cap, F.col("stressed_car"))), 2).alias("avg_stressed_car"), share.alias("assets_share_failing"),
        F.count_if(liq).alias("n_assessed_liquidity"), F.count_if(liq_fail).alias("n_fail_liquidity"),
        money(liq_fail, "liquidity_gap").alias("total_liquidity_gap"))


def at_snapshot(results: DataFrame, features: DataFrame) -> DataFrame:
    return results.join(F.broadcast(snapshot_period(features)), "period", "left_semi")
