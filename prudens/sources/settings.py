"""Configuration tables: institution types, rules and tiers, label aliases, tuned parameters.

They come from the defaults in ``prudens.config`` or from JSON a user keeps; all are small
literal relations, so joins with them are broadcast on a size Catalyst knows.
"""
from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession

from prudens import config
from prudens.functions.tables import literal_table
from prudens.functions.text import normalize_text
from prudens.sources.aliases import METRIC_ALIASES


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as fh:
        return json.load(fh)


def institution_types(spark: SparkSession, cfg: dict) -> DataFrame:
    """``{"banks": {id: {"type": t}}, "special_control": [{"bank_id", "reason"}]}`` to
    ``(bank_id, type, special_control, reason)``."""
    excluded = {e["bank_id"]: e.get("reason") or "no thresholds under special control"
                for e in cfg.get("special_control") or [] if e.get("bank_id")}
    types = {b: (v or {}).get("type") for b, v in (cfg.get("banks") or {}).items()}
    rows = [(b, types.get(b), b in excluded, excluded.get(b)) for b in sorted({*types, *excluded})]
    return literal_table(spark, "bank_id string, type string, special_control boolean, reason string", rows)


def flat_rules(spark: SparkSession, rules=None) -> DataFrame:
    ddl = ("rule_id string, rule_name string, legal_source string, article_reference string, risk_domain string, "
           "metric string, operator string, lo double, hi double, severity string, status string")
    return literal_table(spark, ddl, config.FLAT_RULES if rules is None else rules)


def tiered_rules(spark: SparkSession, rules=None) -> DataFrame:
    ddl = ("rule_id string, rule_name string, legal_source string, article_reference string, risk_domain string, "
           "metric string, direction string, severity string, status string")
    return literal_table(spark, ddl, config.TIERED_RULES if rules is None else rules)


def rule_tiers(spark: SparkSession, tiers=None) -> DataFrame:
    """``(rule_id, type, n1, n2, n3)``."""
    rows = [(rule, kind, *map(float, limits)) for rule, by_type in (config.RULE_TIERS if tiers is None else tiers).items()
            for kind, limits in by_type.items()]
    return literal_table(spark, "rule_id string, type string, n1 double, n2 double, n3 double", rows)


def alias_table(spark: SparkSession, aliases: dict | None = None) -> DataFrame:
    """``(label_norm, metric)``; the last alias of a repeated label wins."""
    lookup = {normalize_text(a): m for m, labels in (aliases or METRIC_ALIASES).items() for a in labels}
    return literal_table(spark, "label_norm string, metric_name string", sorted(lookup.items()))


def first_aliases(spark: SparkSession, aliases: dict | None = None) -> DataFrame:
    rows = [(m, labels[0]) for m, labels in (aliases or METRIC_ALIASES).items() if labels]
    return literal_table(spark, "metric_name string, alias_label string", rows)


def deep_merge(base: dict, override: dict | None) -> dict:
    """Overlay nested parameters; scalars and lists of the override win."""
    out = copy.deepcopy(base)
    for key, value in (override or {}).items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = deep_merge(out[key], value) if both else copy.deepcopy(value)
    return out


def effective_model(base: dict, tuned: dict | None) -> dict:
    """Base model parameters with the tuned overlay, when that overlay is marked applied."""
    if not tuned or not tuned.get("applied"):
        return copy.deepcopy(base)
    overlay = {k: tuned[k] for k in ("forest", "kmeans") if k in tuned}
    return {**deep_merge(base, overlay), "tuned_applied": True, "tuned_at": tuned.get("tuned_at")}
