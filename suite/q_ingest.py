"""Sources, reshaping and sinks."""
from __future__ import annotations

import uuid
import unicodedata

from pyspark.sql import functions as F

from prudens import config
from prudens.functions.numeric import half_up
from prudens.functions.periods import frequency_from_sheet, parse_period, period_string
from prudens.functions.text import clean_number, normalize_label, normalize_text
from prudens.plans.staging import staging_root
from prudens.sources import files, panel, settings, sheets
from prudens.sources.aliases import METRIC_ALIASES
from suite.fixtures import wide_metrics
from suite.oracle import fragment, r, values
from suite.registry import query

_NORM = "trim(regexp_replace(lower(strip_accents(replace(replace({}, 'đ', 'd'), 'Đ', 'D'))), '\\s+', ' ', 'g'))"


@query("source_scan_files", "I01")
def _scan(fx):
    return files.scan_files(fx.spark, fx.sf_dir).select("file", "suffix", "size_bytes")


@query("source_folder_signature", "I13")
def _signature(fx):
    return files.folder_signature(files.scan_files(fx.spark, fx.sf_dir))


_FILE = "case s_suppkey % 4 when 0 then concat('Ngân hàng ', cast(s_suppkey as string), '_data.csv') when 1 then concat('ACB', cast(s_suppkey as string), ' - Dữ liệu.csv') when 2 then concat('_Đông Á ', cast(s_suppkey as string), '.parquet') else concat('vcb', cast(s_suppkey as string), '_DATA.csv') end"


@query("source_bank_from_filename", "I02", f"""
select file, replace(upper(strip_accents(replace(replace(b, 'đ', 'd'), 'Đ', 'D'))), ' ', '') as bank_id, b as bank_name
from (select file, regexp_replace(regexp_replace(regexp_replace(file, '\\.[^.]*$', ''), '[_\\- ]*(data|du lieu|dữ liệu)$', '', 'i'), '^[_\\- ]+|[_\\- ]+$', '', 'g') as b from (select {_FILE} as file from supplier))""")
def _bank(fx):
    f = fx.table("supplier").selectExpr(f"{_FILE} as file")
    b = files.bank_from_filename(F.col("file"))
    return f.select("file", b["bank_id"].alias("bank_id"), b["bank_name"].alias("bank_name"))


# sheets built from the panel: one wide-by-time sheet per bank with every mapped label, some in other spellings
_SPELT = {"Tổng dư nợ cho vay khách hàng (gộp)": "  TỔNG DƯ NỢ CHO VAY   khách hàng (gộp)", "Tổng nợ xấu": "Tong no xau"}
_MAPPED = {normalize_text(a): m for m, labels in METRIC_ALIASES.items() for a in labels}
_REPORTED = wide_metrics()
#: (metric, label, the reported column whose figures stand under the label)
SHEET_LINES = [(m, _SPELT.get(a, a), m if m in _REPORTED else _REPORTED[i % len(_REPORTED)])
               for i, (m, a) in enumerate((m, a) for m, labels in METRIC_ALIASES.items() for a in labels) if _MAPPED[normalize_text(a)] == m]


def sheet_rows_fixture(fx):
    w = fx.view("wide_m")
    lab = F.concat(F.lit("T"), F.date_format("period_ts", "MM/yyyy"))
    cells = {m: F.coalesce(F.col(m).cast("string"), F.lit("")) for m in dict.fromkeys(["hqla", *[c for _, _, c in SHEET_LINES]])}
    rows = w.groupBy("bank_id").agg(F.array_sort(F.collect_list(F.struct("period_ts", lab.alias("label"), *[v.alias(m) for m, v in cells.items()]))).alias("s"))
    pick = lambda name: F.transform("s", lambda x: x[name])
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    lines = [(0, lits("Báo cáo giám sát")), (1, F.concat(lits("STT", "Nhóm chỉ tiêu", "Đơn vị", "Khung CAMELS", "Ghi chú"), pick("label")))]
    for i, (_, label, column) in enumerate(SHEET_LINES):
        lines.append((2 + i, F.concat(lits(str(i + 1), label, "Tỷ đồng", "C", "n/a"), pick(column))))
    lines.append((3 + len(SHEET_LINES), F.concat(lits("9", "Chỉ tiêu lạ", "%", "", ""), pick("hqla"))))
    lines.append((4 + len(SHEET_LINES), lits("", "", "", "")))
    every = F.array(*[F.struct(F.lit(n).alias("row_no"), c.alias("cells")) for n, c in lines])
    return rows.select(F.concat("bank_id", F.lit("_data.csv")).alias("source_file"), F.lit("Biểu Tháng").alias("sheet_name"), F.explode(every).alias("l")).select(
        "source_file", "sheet_name", "l.row_no", "l.cells")


def parsed_rows(fx):
    return sheets.sheet_rows(sheet_rows_fixture(fx), settings.alias_table(fx.spark))


_CELLS = ", ".join(f"struct_pack(m := '{m}', l := '{label.strip()}', v := cast({column} as double))" for m, label, column in SHEET_LINES)


@query("source_sheet_to_panel", "I03", f"""
select bank_id, period, period_ts, 'monthly' as frequency, c.m as metric_name, c.l as metric_label, 'Tỷ đồng' as unit, 'C' as camels_group, {r('c.v', 2)} as metric_value
from (select bank_id, period, period_ts, unnest([{_CELLS}]) as c from wide_m) where c.v is not null""")
def _sheet(fx):
    p = sheets.sheets_to_panel(parsed_rows(fx))
    return p.select("bank_id", "period", "period_ts", "frequency", "metric_name", "metric_label", "unit", "camels_group", half_up("metric_value", 2).alias("metric_value"))


_D = "regexp_matches(s, '^(\\d{1,2})[/\\-.](\\d{1,2})[/\\-.](\\d{4})$')"
_M = "regexp_matches(s, '^t\\s*0?(\\d{1,2})[/\\-. ]+(\\d{4})$', 'i')"
_Q = "regexp_matches(s, '^q\\s*([1-4])[/\\-. ]+(\\d{4})$', 'i')"
fragment("parsed_label", f"""
select label, frequency, ts as period_ts, case when ts is null then null when {_D} and frequency = 'daily' then strftime(ts, '%Y-%m-%d') when ({_D} and frequency = 'monthly') or {_M} then strftime(ts, '%Y-%m')
  when {_Q} then year(ts) || 'Q' || quarter(ts) else cast(year(ts) as varchar) end as period
from (select *, case when {_D} then try_cast(regexp_extract(s, '(\\d{{4}})$', 1) || '-' || lpad(regexp_extract(s, '^(\\d{{1,2}})[/\\-.](\\d{{1,2}})', 2), 2, '0') || '-' || lpad(regexp_extract(s, '^(\\d{{1,2}})', 1), 2, '0') as date)
    when {_M} then last_day(try_cast(regexp_extract(s, '(\\d{{4}})$', 1) || '-' || lpad(regexp_extract(s, '^t\\s*0?(\\d{{1,2}})', 1, 'i'), 2, '0') || '-01' as date))
    when {_Q} then last_day(make_date(cast(regexp_extract(s, '(\\d{{4}})$', 1) as int), cast(regexp_extract(s, '^q\\s*([1-4])', 1, 'i') as int) * 3, 1))
    when frequency = 'yearly' or regexp_full_match(s, '(nam\\s*)?\\d{{4}}') then try_cast(regexp_extract(s, '(\\d{{4}})', 1) || '-12-31' as date) end as ts
  from (select *, trim(strip_accents(label)) as s from fx_period_label))""")


@query("source_parse_period", "I04", "select * from parsed_label")
def _parse(fx):
    df = fx.view("fx_period_label").withColumn("p", parse_period(F.col("label"), F.col("frequency")))
    return df.select("label", "frequency", "p.period", "p.period_ts")


_FREQ = "case l_orderkey % 4 when 0 then 'daily' when 1 then 'monthly' when 2 then 'quarterly' else 'yearly' end"


@query("source_period_string", "I05", f"select f as frequency, d, case f when 'daily' then strftime(d, '%Y-%m-%d') when 'monthly' then strftime(d, '%Y-%m') when 'quarterly' then year(d) || 'Q' || quarter(d) else cast(year(d) as varchar) end as period, count(*) as n from (select {_FREQ} as f, cast(l_shipdate as date) as d from lineitem) group by all")
def _pstr(fx):
    df = fx.table("lineitem").selectExpr(f"{_FREQ} as frequency", "cast(l_shipdate as date) as d").groupBy("frequency", "d").agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("period", period_string(F.col("d"), F.col("frequency")))


_LABEL = "concat(case s_suppkey % 3 when 0 then '  Tổng  DƯ NỢ cho vay Đặc biệt ' when 1 then 'Tỷ lệ   ỨNG PHÓ – Ngoại Tệ ' else 'Quỹ của tổ chức TÍN DỤNG ' end, cast(s_suppkey as string), ' ', s_name)"


@query("source_normalize_label", "I06", f"select label, {_NORM.format('label')} as norm from (select {_LABEL} as label from supplier)")
def _norm(fx):
    return fx.table("supplier").selectExpr(f"{_LABEL} as label").withColumn("norm", normalize_label(F.col("label")))


_ALL_LABELS = [a for labels in METRIC_ALIASES.values() for a in labels]
_PICK = "list_extract([" + ", ".join("'" + a.replace("'", "''") + "'" for a in _ALL_LABELS) + f"], cast(o_orderkey % {len(_ALL_LABELS)} + 1 as int))"


def _plain(text):
    t = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    return " ".join("".join(c for c in t if unicodedata.category(c) != "Mn").lower().split())


fragment("alias_map", values(sorted({(_plain(a), m) for m, labels in METRIC_ALIASES.items() for a in labels}), "label_norm, metric_name"))
fragment("label_rows", f"select o_orderkey, case when o_orderkey % 5 = 0 then upper({_PICK}) when o_orderkey % 7 = 0 then 'lạ ' || cast(o_custkey % 4 as varchar) else {_PICK} end as label from orders")


def label_rows_fixture(fx):
    arr = F.array(*[F.lit(a) for a in _ALL_LABELS])
    pick = F.get(arr, (F.col("o_orderkey") % len(_ALL_LABELS)).cast("int"))
    label = F.when(F.col("o_orderkey") % 5 == 0, F.upper(pick)).when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("lạ "), (F.col("o_custkey") % 4).cast("string"))).otherwise(pick)
    return fx.table("orders").select("o_orderkey", label.alias("label"))


@query("source_alias_lookup", "I07", f"select metric_name, count(*) as n from label_rows join alias_map on {_NORM.format('label')} = label_norm group by metric_name")
def _alias(fx):
    df = label_rows_fixture(fx).withColumn("label_norm", normalize_label(F.col("label")))
    return df.join(F.broadcast(settings.alias_table(fx.spark)), "label_norm").groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"))


@query("source_unmapped_labels", "I08", f"select label, count(*) as n from label_rows where {_NORM.format('label')} not in (select label_norm from alias_map) group by label")
def _unmapped(fx):
    df = label_rows_fixture(fx).withColumn("label_norm", normalize_label(F.col("label")))
    rows = df.join(F.broadcast(settings.alias_table(fx.spark)), "label_norm", "left").withColumnRenamed("label", "metric_label")
    return sheets.unmapped_labels(rows)


_TEXT = "case o_orderkey % 6 when 0 then concat(cast(cast(floor(o_totalprice) as bigint) as string), '%') when 1 then concat(' 1,', lpad(cast(o_custkey % 1000 as string), 3, '0'), '.25 ') when 2 then 'n/a' when 3 then '' when 4 then concat('-', cast(o_custkey as string)) else concat(cast(o_orderkey as string), 'x') end"


@query("source_clean_number", "I09", f"select o_orderkey, try_cast(trim(regexp_replace({_TEXT}, '[,%]', '', 'g')) as double) as value from orders")
def _num(fx):
    df = fx.table("orders").selectExpr("o_orderkey", f"{_TEXT} as t")
    return df.select("o_orderkey", clean_number(F.col("t")).alias("value"))


_SHEET = "concat(case o_orderkey % 6 when 0 then 'Biểu NGÀY ' when 1 then 'Tháng ' when 2 then 'Số liệu Quý ' when 3 then 'NĂM ' when 4 then 'thai ' else 'khác ' end, cast(o_orderkey % 50 as string))"
_FKEYS = " ".join(f"when contains(n, '{_plain(k)}') then '{f}'" for k, f in config.FREQUENCY_BY_SHEET)


@query("source_frequency_of_sheet", "I10", f"select sheet, case {_FKEYS} end as frequency, count(*) as n from (select sheet, {_NORM.format('sheet')} as n from (select {_SHEET} as sheet from orders)) group by all")
def _freq(fx):
    df = fx.table("orders").selectExpr(f"{_SHEET} as sheet").groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("frequency", frequency_from_sheet(F.col("sheet")))


@query("source_tidy_panel", "I11", "select bank_id, period, metric_name, " + r("metric_value") + " as metric_value, cast(null as varchar) as unit, cast(null as date) as period_ts from fx_panel")
def _tidy(fx):
    tidy = fx.view("fx_panel").select("bank_id", "period", "metric_name", F.col("metric_value").cast("string").alias("metric_value"))
    return panel.conform(tidy).select("bank_id", "period", "metric_name", half_up("metric_value", 4).alias("metric_value"), "unit", "period_ts")


fragment("panel_last", "select * exclude (k) from (select *, row_number() over (partition by bank_id, period, frequency, metric_name order by load_order desc) as k from fx_panel) where k = 1")


@query("panel_dedup_last", "I12", f"select bank_id, period, frequency, metric_name, load_order, {r('metric_value')} as metric_value from panel_last")
def _dedup(fx):
    return panel.dedup_last(fx.view("fx_panel")).select("bank_id", "period", "frequency", "metric_name", "load_order", half_up("metric_value", 4).alias("metric_value"))


@query("source_file_metadata", "I14", """
select file, 'S' || substr(file, 2, 6) as bank_id, coalesce(n, 0) as rows, coalesce(f, '') as frequencies, coalesce(m, 0) as metrics, floor(size_bytes / 1024.0::double * 10 + 0.5) / 10 as size_kb
from (select 'S' || substr(bank_id, 2) || '.csv' as file, (row_number() over (order by bank_id) - 1) * 1000 as size_bytes, bank_id from fx_inst)
left join (select bank_id, count(*) as n, string_agg(distinct frequency, ',' order by frequency) as f, count(distinct metric_name) as m from fx_panel group by bank_id) using (bank_id)""")
def _meta(fx):
    rows = fx.table("supplier").select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".csv")).alias("file"),
                                       (F.col("s_suppkey") * 1000).alias("size_bytes"))
    p = fx.view("fx_panel").withColumn("source_file", F.concat(F.lit("S"), F.substring("source_file", 2, 100)))
    return files.file_metadata(rows, p).drop("bank_name")


_PM = ["customer_loans", "group2_ratio", "provisions", "profit_y"]


@query("panel_pivot_wide", "I15", f"select bank_id, bank_name, period, period_ts, {r('max(metric_value) filter (metric_name = ' + chr(39) + 'customer_loans' + chr(39) + ')')} as customer_loans, {r('max(metric_value) filter (metric_name = ' + chr(39) + 'group2_ratio' + chr(39) + ')')} as group2_ratio from panel_last where frequency = 'monthly' group by bank_id, bank_name, period, period_ts")
def _pivot(fx):
    w = panel.wide_table(panel.dedup_last(fx.view("fx_panel")), ["customer_loans", "group2_ratio"], "monthly")
    return w.select("bank_id", "bank_name", "period", "period_ts", half_up("customer_loans", 4).alias("customer_loans"), half_up("group2_ratio", 4).alias("group2_ratio"))


fragment("first_alias", values([(m, a[0]) for m, a in METRIC_ALIASES.items()], "metric_name, alias_label"))
fragment("label_info", """
select coalesce(s.metric_name, f.metric_name) as metric_name, coalesce(s.label, f.alias_label) as label, unit, camels_group, s.label is null as is_derived_ratio
from (select metric_name, arg_min(metric_label, (-n, metric_label)) as label, min(unit) as unit, min(camels_group) as camels_group
      from (select metric_name, metric_label, count(*) as n, min(unit) as unit, min(camels_group) as camels_group from fx_panel where metric_label is not null group by metric_name, metric_label) group by metric_name) s
full join first_alias f on s.metric_name = f.metric_name""")


@query("panel_label_lookup", "I16", "select * from label_info")
def _labels(fx):
    return panel.label_lookup(fx.view("fx_panel"), settings.first_aliases(fx.spark))


_MISS = [m for m in wide_metrics() if m != "ldr"]
fragment("miss_rows", " union all ".join(f"select '{m}' as metric, count(*) filter ({m} is null) as n_missing, count(*) as n_total from wide_m" for m in _MISS))


@query("panel_missing_metrics", "I17", f"select metric, coalesce(label, metric) as label, unit, camels_group, coalesce(is_derived_ratio, false) as is_derived_ratio, n_missing, n_total, {r('n_missing / n_total::double * 100', 2)} as missing_pct from miss_rows left join label_info on metric = metric_name where n_missing > 0")
def _missing(fx):
    return panel.missing_table(fx.view("wide_m"), _MISS, panel.label_lookup(fx.view("fx_panel"), settings.first_aliases(fx.spark)))


@query("panel_frequencies", "I18", "select frequency, case frequency when 'combined' then 0 when 'monthly' then 1 when 'quarterly' then 2 when 'yearly' then 3 end as ordinal from (select distinct frequency from fx_panel union select 'combined')")
def _freqs(fx):
    return panel.available_frequencies(fx.view("fx_panel"), combined=True)


_TPL = "select concat(case when l_linenumber = 7 then 'X-' else 'R-' end, cast(100 + l_orderkey % 93 as string)) as ma_dong_nguon, concat(cast(1 + l_orderkey % 7 as string), case when l_linenumber > 1 then concat('.', cast(l_linenumber as string)) else '' end, case when l_linenumber > 3 then '.1' else '' end, case when l_orderkey % 2 = 0 then '.' else '' end) as stt, concat(' ', l_returnflag, ' ') as chi_tieu, l_quantity as so_lieu from {t}"


@query("source_template_rows", "I19", f"""
select ma_dong_nguon, stt, chi_tieu, cap_do, cap_do = 1 or (cap_do = 2 and ma_dong_nguon not in ('R-191', 'R-192')) as is_header, so_lieu
from (select ma_dong_nguon, trim(stt) as stt, trim(chi_tieu) as chi_tieu, so_lieu, cast(len(list_filter(string_split(stt, '.'), lambda x: x <> '')) as int) as cap_do from ({_TPL.format(t='lineitem')}) where ma_dong_nguon like 'R-%')""")
def _template(fx):
    return panel.template_rows(fx.spark.sql(_TPL.format(t="{t}"), t=fx.table("lineitem")))


@query("sink_json_safe", "I20", "select bank_id, period, case when isnan(x) or isinf(x) then null else floor(x * 10000 + 0.5) / 10000 end as x, strftime(period_ts, '%Y-%m-%dT%H:%M:%S') as period_ts from (select bank_id, period, period_ts, case month(period_ts) when 1 then 'nan'::double when 2 then 'inf'::double when 3 then '-inf'::double else group2_ratio end as x from wide_m)")
def _safe(fx):
    x = F.expr("case month(period_ts) when 1 then double('NaN') when 2 then double('Infinity') when 3 then double('-Infinity') else group2_ratio end")
    return panel.json_safe(fx.view("wide_m").select("bank_id", "period", "period_ts", x.alias("x")))


@query("sink_records_dropped", "I21", "select count(*) as n_total, greatest(count(*) - 5000, 0) as n_dropped from wide_m")
def _records(fx):
    return panel.records(fx.view("wide_m"), ["bank_id", "period", "absent"], limit=5000)[1]


@query("sink_report_sections", "I22", "select 'features' as section, count(*) as n from wide_m union all select 'banks', count(distinct bank_id) from wide_m")
def _sections(fx):
    """Writes sections and reads their row counts back."""
    from prudens.sources.sinks import write_sections
    root = f"{staging_root(fx.spark)}/sections-{uuid.uuid4().hex}"
    w = fx.view("wide_m").select("bank_id", "period", "period_ts", "group2_ratio")
    write_sections({"features": w, "banks": w.select("bank_id").distinct()}, root)
    read = lambda n: fx.spark.read.json(f"{root}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("section"), "n")
    return read("features").unionByName(read("banks"))


_UPSERTED = "select bank_id, period, " + r("case when month(period_ts) = 6 then customer_loans * 2 else customer_loans end") + " as v from wide_m union all select bank_id, 'NEW', 1.0::double from fx_inst"


def _old_and_new(fx):
    old = fx.view("wide_m").select("bank_id", "period", F.col("customer_loans").alias("v"))
    return old, fx.view("wide_m").where("month(period_ts) = 6").select("bank_id", "period", (F.col("customer_loans") * 2).alias("v")).unionByName(
        fx.inst.select("bank_id", F.lit("NEW").alias("period"), F.lit(1.0).alias("v")))


@query("sink_upsert", "I23", _UPSERTED)
def _upsert(fx):
    return panel.upsert(*_old_and_new(fx), ["bank_id", "period"]).withColumn("v", half_up("v", 4))


@query("sink_upsert_versions", "I23", _UPSERTED)
def _upsert_versions(fx):
    """The same through a stored table: first version, then the merge as the second."""
    from prudens.sources.sinks import upsert_table
    root = f"{staging_root(fx.spark)}/table-{uuid.uuid4().hex}"
    old, new = _old_and_new(fx)
    upsert_table(fx.spark, old, root, ["bank_id", "period"])
    return upsert_table(fx.spark, new, root, ["bank_id", "period"]).withColumn("v", half_up("v", 4))


@query("sink_append_log", "I24", "select label, 2 * count(*) as n from fx_feedback group by label")
def _append(fx):
    from prudens.sources.sinks import append_log
    path = f"{staging_root(fx.spark)}/log-{uuid.uuid4().hex}"
    append_log(fx.view("fx_feedback"), path)
    append_log(fx.view("fx_feedback"), path)
    return fx.spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
