"""Regulatory rules as data: flat limits, limits tiered by institution type, gaps and exclusions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prudens import config
from prudens.functions.tables import literal_table
from prudens.sources import settings

FINDING_COLS = ["bank_id", "bank_name", "period", "period_ts", "rule_id", "rule_name", "metric", "metric_value",
                "operator", "threshold", "severity", "status", "risk_domain", "legal_source", "article_reference",
                "finding_type", "description", "audit_recommendation"]
IDS = config.ID_COLS
TREND_OPS = ("increasing_fast", "decreasing_fast")
# Tier to finding type, severity and the action expected of the supervisor.
TIERS = [("n3", "VIOLATION", "CRITICAL", "apply supervisory measures"),
         ("n2", "WARNING", "HIGH", "find the cause and consider a recommendation"),
         ("n1", "WATCH", "MEDIUM", "monitor more closely")]


def fires(op: Column, v: Column, lo: Column, hi: Column, prev: Column | None = None) -> Column:
    """True when the value breaches the limit. A missing value never fires except for ``missing``."""
    hit = (F.when(op == "missing", v.isNull()).when(v.isNull(), False)
           .when(op == "<", v < lo).when(op == "<=", v <= lo).when(op == ">", v > lo).when(op == ">=", v >= lo)
           .when(op == "==", v == lo).when(op == "!=", v != lo)
           .when(op == "between", (v >= lo) & (v <= hi)).when(op == "outside_range", (v < lo) | (v > hi)))
    if prev is not None:
        change = F.when(prev != 0, (v - prev) / F.abs(prev) * 100)
        limit = F.coalesce(lo, F.lit(config.FAST_CHANGE_PCT))
        hit = hit.when(op == "increasing_fast", change >= limit).when(op == "decreasing_fast", change <= -limit)
    return F.coalesce(hit, F.lit(False))


def _text(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit(""))


def _threshold(lo: Column, hi: Column) -> Column:
    return F.when(hi.isNotNull(), F.concat(F.lit("["), _text(lo), F.lit(", "), _text(hi), F.lit("]"))).otherwise(_text(lo))


def _finish(df: DataFrame) -> DataFrame:
    return df.select(*FINDING_COLS)


def tier_struct(v: Column, direction: Column, n1: Column, n2: Column, n3: Column) -> Column:
    """The first tier a value falls in, worst first; tiers exclude one another."""
    out = None
    for (name, kind, severity, action), limit in zip(TIERS, (n3, n2, n1)):
        beyond = F.when(direction == "lower_riskier", v < limit).when(direction == "higher_riskier", v > limit)
        tier = F.struct(F.lit(name).alias("tier"), F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"),
                        F.lit(action).alias("action"), limit.alias("limit"))
        out = F.when(beyond, tier) if out is None else out.when(beyond, tier)
    return out


# Rows about a bank itself, as (pseudo-metric, rule, name, severity, finding type).
ABOUT_BANK = [("#special", "SPECIAL_CONTROL_NO_THRESHOLD", "No thresholds under special control", "INFO", "SPECIAL_CONTROL"),
              ("#unknown", "INSTITUTION_TYPE_UNKNOWN", "Institution type unknown", "DATA_GAP", "DATA_GAP")]
SPEC_DDL = ("metric string, rule_id string, rule_name string, severity string, about string, status string, risk_domain string, legal_source string, "
            "article_reference string, operator string, lo double, hi double, for_type string, direction string, n1 double, n2 double, n3 double")


def _spec(spark, flat, tiered, tiers, kinds: list[str]) -> DataFrame:
    """All rules as one small table with ``for_type``: tiered ones for their types, others for every one of ``kinds`` and ''."""
    about = literal_table(spark, SPEC_DDL, [(m, i, n, s, kind, "ACTIVE", "governance", "QĐ 682/QĐ-TTGSNH4", *[None] * 9) for m, i, n, s, kind in ABOUT_BANK])
    out = about.unionByName(settings.flat_rules(spark, flat), allowMissingColumns=True) if flat else about
    out = out.withColumn("for_type", F.explode(F.array(*[F.lit(k) for k in ["", *kinds]])))
    if tiered:
        limits = settings.rule_tiers(spark, tiers).withColumnRenamed("type", "for_type")
        out = out.unionByName(settings.tiered_rules(spark, tiered).join(limits, "rule_id"), allowMissingColumns=True)
    return out


def _evaluate(features: DataFrame, inst: DataFrame | None, flat, tiered, tiers, special=False, unknown=False) -> DataFrame:
    """Findings of all given rules in one pass: each row of ``features`` meets its bank's type once and is unpivoted once.

    ``inst`` has one row per bank. A bank's past enters by a lag over the wide rows, only where a rule asks for it.
    """
    has = lambda rules: [m for m in sorted({r[5] for r in rules}) if m in features.columns]
    trends = set(has([r for r in flat if r[6] in TREND_OPS]))
    rows = features.select(*IDS, *[F.col(m).cast("double").alias(m) for m in has([*flat, *tiered])])
    if trends:
        w = Window.partitionBy("bank_id").orderBy("period_ts")
        rows = rows.select("*", *[F.lag(m).over(w).alias(f"_prev_{m}") for m in sorted(trends)])
    if inst is not None:
        off = F.coalesce("special_control", F.lit(False))
        who = inst.select("bank_id", F.when(~off, F.col("type")).alias("_type"), off.alias("_special"), (off | F.col("type").isNotNull()).alias("_known"), F.col("reason").alias("_reason"))
        rows = rows.join(who, "bank_id", "left")
    else:
        rows = rows.selectExpr("*", "cast(null as string) as _type", "false as _special", "true as _known", "cast(null as string) as _reason")
    cell = lambda m, v, p: f"struct('{m}' as metric, cast({v} as double) as value, cast({p} as double) as prev)"
    cells = [cell(m, f"`{m}`", f"`_prev_{m}`" if m in trends else "null") for m in rows.columns if m in has([*flat, *tiered])]
    cells += [f"if(coalesce(_special, false), {cell('#special', 'null', 'null')}, null)"] if special else []
    cells += [f"if(coalesce(_known, false), null, {cell('#unknown', 'null', 'null')})"] if unknown else []
    if not cells:
        cells = [f"if(false, {cell('', 'null', 'null')}, null)"]
    kinds = sorted({k for by_type in (config.RULE_TIERS if tiers is None else tiers).values() for k in by_type}) if tiered else []
    rows = rows.withColumn("for_type", F.when(F.col("_type").isin(kinds), F.col("_type")).otherwise(""))
    long = rows.selectExpr(*IDS, "for_type", "_reason", f"explode(array_compact(array({', '.join(cells)}))) as _c").selectExpr(*IDS, "for_type", "_reason", "_c.metric", "_c.value", "_c.prev")
    met = long.join(F.broadcast(_spec(features.sparkSession, flat, tiered, tiers, kinds)), ["metric", "for_type"])
    v, op, tiered_row, about = F.col("value"), F.col("operator"), F.col("direction").isNotNull(), F.col("about")
    gap = v.isNull() & (F.col("severity") == "CRITICAL") & (F.coalesce(op, F.lit("")) != "missing")
    hit = met.select("*", gap.alias("_gap"), fires(op, v, F.col("lo"), F.col("hi"), F.col("prev")).alias("_fires"),
                     tier_struct(v, F.col("direction"), F.col("n1"), F.col("n2"), F.col("n3")).alias("_t")).where("_gap or _fires or _t is not null or about is not null")
    silent, limit = F.col("_gap"), _threshold(F.col("lo"), F.col("hi"))
    said = (F.when(silent, F.concat(F.lit("no value to check: "), F.col("rule_name")))
            .when(about == "SPECIAL_CONTROL", F.coalesce("_reason", F.lit("special control")))
            .when(about.isNotNull(), "no tiered threshold can be applied without an institution type")
            .when(tiered_row, F.concat("metric", F.lit(" beyond "), "_t.tier", F.lit(" for "), "for_type", F.lit(": "), "_t.action"))
            .otherwise(F.concat("metric", F.lit(" "), "operator", F.lit(" "), limit)))
    return _finish(hit.select(
        *IDS, "rule_id", "rule_name", F.when(about.isNull(), F.col("metric")).alias("metric"), v.alias("metric_value"),
        F.when(~tiered_row, op).when(silent, None).when(F.col("direction") == "lower_riskier", "<").otherwise(">").alias("operator"),
        F.when(about.isNotNull(), None).when(~tiered_row, limit).when(silent, "").otherwise(_text(F.col("_t.limit"))).alias("threshold"),
        F.when(silent, "DATA_GAP").when(tiered_row, F.col("_t.severity")).otherwise(F.col("severity")).alias("severity"), "status", "risk_domain",
        "legal_source", "article_reference",
        F.when(silent, "DATA_GAP").when(tiered_row, F.col("_t.finding_type")).otherwise(F.coalesce(about, F.lit("VIOLATION"))).alias("finding_type"),
        said.alias("description"),
        F.when(silent, "ask for the missing data").when(about.isNotNull(), "classify or treat the institution explicitly")
        .otherwise("review the metric and its sources").alias("audit_recommendation")))


def evaluate_flat(features: DataFrame, rules=None) -> DataFrame:
    """VIOLATION rows of flat rules; DATA_GAP rows where a CRITICAL rule has no value to check."""
    return _evaluate(features, None, config.FLAT_RULES if rules is None else rules, [], None)


def evaluate_tiered(features: DataFrame, inst: DataFrame, rules=None, tiers=None) -> DataFrame:
    """At most one finding per rule and bank-period, on the limits of the bank's type.

    Banks under special control are not compared; a type without limits is not evaluated.
    """
    return _evaluate(features, inst, [], config.TIERED_RULES if rules is None else rules, tiers)


def system_gaps(features: DataFrame, flat=None, tiered=None, reported: DataFrame | None = None) -> DataFrame:
    """One row without bank or period per CRITICAL rule whose metric no table reports: absent from
    the columns of ``features``, or from the metrics of a panel given as ``reported``."""
    spark = features.sparkSession
    flat = settings.flat_rules(spark, flat).select("rule_id", "rule_name", "metric", "severity", "status", "risk_domain",
                                                   "legal_source", "article_reference", "operator",
                                                   _threshold(F.col("lo"), F.col("hi")).alias("threshold"))
    tiers = settings.tiered_rules(spark, tiered).select(
        "rule_id", "rule_name", "metric", "severity", "status", "risk_domain", "legal_source", "article_reference",
        F.lit(None).cast("string").alias("operator"), F.lit("").alias("threshold"))
    critical = flat.unionByName(tiers).where("severity = 'CRITICAL'")
    absent = (critical.where(~F.col("metric").isin(list(features.columns))) if reported is None
              else critical.join(reported, "metric", "left_anti"))
    types = dict(features.dtypes)
    return _finish(absent.select(
        *[F.lit(None).cast(types[c]).alias(c) for c in IDS], "rule_id", "rule_name", "metric",
        F.lit(None).cast("double").alias("metric_value"), "operator", "threshold", F.lit("DATA_GAP").alias("severity"),
        "status", "risk_domain", "legal_source", "article_reference", F.lit("DATA_GAP").alias("finding_type"),
        F.concat(F.lit("metric absent from the data: "), F.col("rule_name")).alias("description"),
        F.lit("ask for the missing data").alias("audit_recommendation")))


def special_control(features: DataFrame, inst: DataFrame) -> DataFrame:
    """One INFO row per period of a bank that no thresholds apply to."""
    return _evaluate(features, inst, [], [], None, special=True)


def unclassified(features: DataFrame, inst: DataFrame) -> DataFrame:
    """One DATA_GAP row per period of a bank that is neither typed nor excluded."""
    return _evaluate(features, inst, [], [], None, unknown=True)


def evaluate_rules(features: DataFrame, inst: DataFrame, flat=None, tiered=None, tiers=None) -> DataFrame:
    """All findings: exclusions, unclassified banks, flat and tiered rules, system-wide gaps; ``features`` is read once."""
    f, t = config.FLAT_RULES if flat is None else flat, config.TIERED_RULES if tiered is None else tiered
    return _evaluate(features, inst, f, t, tiers, special=True, unknown=bool(t)).unionByName(system_gaps(features, flat, tiered))


def misordered_tiers(spark, rules=None, tiers=None) -> DataFrame:
    """Tier rows whose limits are out of order, so that a middle tier could never fire."""
    spec = settings.tiered_rules(spark, rules).select("rule_id", "direction").join(settings.rule_tiers(spark, tiers), "rule_id")
    falling = (F.col("n1") >= F.col("n2")) & (F.col("n2") >= F.col("n3"))
    rising = (F.col("n1") <= F.col("n2")) & (F.col("n2") <= F.col("n3"))
    return spec.where(~F.when(F.col("direction") == "lower_riskier", falling).otherwise(rising))


def worst_severity(severity: Column) -> Column:
    """Aggregate: the worst ordinary severity present; DATA_GAP only when no other is there."""
    ordinal = F.lit(None).cast("int")
    for i, s in enumerate(config.SEVERITY_ORDER):
        ordinal = F.when(severity == s, i).otherwise(ordinal)
    worst = F.max(ordinal)
    names = F.array(*[F.lit(s) for s in config.SEVERITY_ORDER])
    return F.when(worst.isNotNull(), F.get(names, worst)).when(F.count_if(severity == "DATA_GAP") > 0, "DATA_GAP").otherwise("INFO")


def summarize(findings: DataFrame) -> DataFrame:
    """Counts by severity and the worst severity per bank-period."""
    s = F.col("severity")
    n = lambda level: F.count_if(s == level)
    return findings.where(F.col("bank_id").isNotNull() & F.col("period").isNotNull()).groupBy("bank_id", "period").agg(
        F.max("period_ts").alias("period_ts"), F.max("bank_name").alias("bank_name"), worst_severity(s).alias("worst_severity"),
        n("CRITICAL").alias("n_critical"), n("HIGH").alias("n_high"), n("MEDIUM").alias("n_medium"), n("LOW").alias("n_low"),
        n("DATA_GAP").alias("n_data_gap"), F.count(F.lit(1)).alias("n_findings"))


def rule_appendix(spark, flat=None, tiered=None) -> DataFrame:
    """The configured rules as one table."""
    f = settings.flat_rules(spark, flat).select(
        "rule_id", "rule_name", "metric", "operator", _threshold(F.col("lo"), F.col("hi")).alias("threshold"), "severity",
        "status", "risk_domain", "legal_source", "article_reference")
    t = settings.tiered_rules(spark, tiered).select(
        "rule_id", "rule_name", "metric", F.lit(None).cast("string").alias("operator"), F.lit("").alias("threshold"),
        "severity", "status", "risk_domain", "legal_source", "article_reference")
    return f.unionByName(t)
