"""The long panel: tidy loads, keep-last dedup, pivots, label lookup, missing tables, upserts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from prudens import config
from prudens.functions.numeric import half_up, nan_to_null
from prudens.functions.reshape import to_wide

PANEL_DDL = ("bank_id string, bank_name string, period string, period_ts date, frequency string, camels_group string, "
             "metric_name string, metric_label string, unit string, metric_value double, source_file string, "
             "source_file_full_path string")
PANEL_KEY = ["bank_id", "period", "frequency", "metric_name"]
REQUIRED = ["bank_id", "period", "metric_name", "metric_value"]


class SchemaMismatch(ValueError):
    """A flat file without the panel's required columns."""


def read_flat_panel(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """A tidy csv or parquet panel, projected to the panel schema; absent columns become null."""
    reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
    return conform(reader.format(fmt).load(path).select("*", F.col("_metadata.file_name").alias("_f"),
                                                        F.col("_metadata.file_path").alias("_p")))


def conform(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise SchemaMismatch(f"not a panel: {missing} absent")
    out = []
    for field in PANEL_DDL.split(", "):
        name, dtype = field.split()
        if name == "source_file" and "_f" in df.columns:
            c = F.col("_f")
        elif name == "source_file_full_path" and "_p" in df.columns:
            c = F.col("_p")
        else:
            c = F.col(name) if name in df.columns else F.lit(None)
        c = c.try_cast(dtype) if name in df.columns and dtype != "string" else c.cast(dtype)
        out.append((nan_to_null(c) if dtype == "double" else c).alias(name))
    return df.select(*out)


def dedup_last(panel: DataFrame, order: str = "load_order", keys=None) -> DataFrame:
    """The last loaded row of each key. ``max_by`` combines before the shuffle, so a key repeated
    many times costs one row per task instead of one sorted group."""
    keys = keys or PANEL_KEY
    rest = [c for c in panel.columns if c not in keys]
    last = panel.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in panel.columns])


def wide_table(panel: DataFrame, metrics: list[str], frequency: str | None = None) -> DataFrame:
    """One row per bank and period; the metric list is given, so no job is run to find columns."""
    if frequency:
        panel = panel.where(F.col("frequency") == frequency)
    return to_wide(panel, [c for c in config.ID_COLS if c in panel.columns], metrics, "metric_name", "metric_value")


def available_frequencies(panel: DataFrame, combined: bool = False) -> DataFrame:
    order = {f: i for i, f in enumerate(config.FREQUENCIES)}
    ordinal = F.lit(None).cast("int")
    for f, i in order.items():
        ordinal = F.when(F.col("frequency") == f, i).otherwise(ordinal)
    found = panel.select("frequency").distinct()
    if combined:
        found = found.unionByName(found.where(F.col("frequency") == "monthly").select(F.lit("combined").alias("frequency")))
    return found.select("frequency", ordinal.alias("ordinal")).where("ordinal is not null").orderBy("ordinal")


def label_lookup(panel: DataFrame, first_aliases: DataFrame) -> DataFrame:
    """Per metric: the commonest label (ties to the smallest), first unit and group by load order;
    metrics never observed take their first configured alias and count as derived."""
    counts = panel.where(F.col("metric_label").isNotNull()).groupBy("metric_name", "metric_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("unit").isNotNull(), F.struct("load_order", "unit"))).alias("u"),
        F.min(F.when(F.col("camels_group").isNotNull(), F.struct("load_order", "camels_group"))).alias("g"))
    seen = counts.groupBy("metric_name").agg(
        F.min_by("metric_label", F.struct((-F.col("n")).alias("n"), "metric_label")).alias("label"),
        F.min("u")["unit"].alias("unit"), F.min("g")["camels_group"].alias("camels_group"))
    return seen.join(first_aliases, "metric_name", "full_outer").select(
        "metric_name", F.coalesce("label", "alias_label").alias("label"), "unit", "camels_group",
        F.col("label").isNull().alias("is_derived_ratio"))


def missing_table(features: DataFrame, metrics: list[str], labels: DataFrame) -> DataFrame:
    """Missing cells per reported metric: one aggregate over the wide table, then a small unpivot."""
    metrics = [m for m in metrics if "__" not in m]
    row = features.agg(F.count(F.lit(1)).alias("n_total"),
                       *[F.count_if(F.col(m).isNull()).alias(m) for m in metrics])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n_missing")) for m in metrics])
    out = (row.select("n_total", F.explode(cells).alias("c")).select("c.metric", "c.n_missing", "n_total")
           .where("n_missing > 0").join(labels.withColumnRenamed("metric_name", "metric"), "metric", "left"))
    pct = half_up(F.col("n_missing") / F.col("n_total") * 100, 2)
    return out.select("metric", F.coalesce("label", "metric").alias("label"), "unit", "camels_group",
                      F.coalesce("is_derived_ratio", F.lit(False)).alias("is_derived_ratio"), "n_missing", "n_total",
                      pct.alias("missing_pct")).orderBy(F.desc("missing_pct"), "label", "metric")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; other rows stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def template_rows(raw: DataFrame) -> DataFrame:
    """Rating-template rows: ``R-`` codes with their outline level and header flag."""
    code, stt = F.trim("ma_dong_nguon"), F.trim(F.coalesce("stt", F.lit("")))
    depth = F.size(F.filter(F.split(stt, r"\."), lambda x: x != ""))
    level = F.when(depth == 0, 1).otherwise(depth)
    header = (level == 1) | ((level == 2) & ~code.isin("R-191", "R-192"))
    return raw.where(code.startswith("R-")).select(
        code.alias("ma_dong_nguon"), stt.alias("stt"), F.trim(F.coalesce("chi_tieu", F.lit(""))).alias("chi_tieu"),
        "so_lieu", level.alias("cap_do"), header.alias("is_header"),
        *[c for c in raw.columns if c not in ("ma_dong_nguon", "stt", "chi_tieu", "so_lieu")])


def json_safe(df: DataFrame) -> DataFrame:
    """Columns as JSON can carry them: NaN and infinities null, doubles to 4 places, ISO times."""
    def safe(name: str, dtype: str) -> Column:
        c = F.col(name)
        if dtype in ("double", "float"):
            return half_up(nan_to_null(c), 4).alias(name)
        if dtype == "date":
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
        if dtype.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
        return c
    return df.select(*[safe(n, t) for n, t in df.dtypes])


def records(df: DataFrame, cols=None, limit: int | None = None, order=None):
    """``(rows, dropped)``: present columns of the table, and how many rows a limit leaves out."""
    out = df.select(*[c for c in cols if c in df.columns]) if cols else df
    total = df.agg(F.count(F.lit(1)).alias("n_total"))
    if limit is None:
        return out, total.select("n_total", F.lit(0).cast("bigint").alias("n_dropped"))
    kept = (out.orderBy(*order) if order else out).limit(limit)
    return kept, total.select("n_total", F.greatest(F.col("n_total") - limit, F.lit(0).cast("bigint")).alias("n_dropped"))
