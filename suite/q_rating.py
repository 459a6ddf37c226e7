"""Criteria-set rating: a bank-month is an input, its reported values a map."""
from __future__ import annotations

from pyspark.sql import functions as F

from prudens.functions.numeric import half_up
from prudens.operators import rating
from prudens.plans.rating_run import run_rating
from prudens.plans.staging import stage
from prudens.operators.rating import Criterion, higher_is_better, lower_is_better
from suite.oracle import fragment, r, values
from suite.registry import query

CAR_LABEL, NPL_LABEL = "Tỷ lệ an toàn vốn tối thiểu (CAR) (riêng lẻ)", "Tổng nợ xấu"
V = lambda n: {"ma_bien": n}
OP = lambda op, *a: {"phep_toan": op, "tham_so": list(a)}
N = lambda x: {"gia_tri": x}
BIG, SMALL_T, BRANCH = "NHTM_QUY_MO_LON", "NHTM_QUY_MO_NHO", "CHI_NHANH_NGAN_HANG_NUOC_NGOAI"
CRITERIA = [
    Criterion("1.1.a", "1.1", "C", OP("NHAN", OP("CHIA", V("VCSH"), V("RWA")), N(100)), (("VCSH", True), ("RWA", True)),
              {"kieu": "SO_SANH", "truong": "tt41", "gia_tri": "true"}, {BIG: (60, higher_is_better(15, 12, 8, 5)), "ALL": (50, higher_is_better(14, 11, 8, 5))}),
    Criterion("1.1.b", "1.1", "C", OP("MAX", V("CAR_BC"), N(0)), (("CAR_BC", True),),
              {"kieu": "SO_SANH", "truong": "tt41", "phep_so_sanh": "KHAC", "gia_tri": "true"}, {"ALL": (60, higher_is_better(15, 12, 8, 5))}),
    Criterion("1.2", "1.2", "C", OP("TRUNG_BINH", V("CAR_BC"), OP("TRU", V("CAR_BC"), N(1))), (("CAR_BC", True),), None, {"ALL": (40, higher_is_better(12, 10, 7, 4))}),
    Criterion("C_DT", "C_DT", "C", None, (), None, {"ALL": (100, None)}),
    Criterion("2.1", "2.1", "A", OP("NHAN", OP("CHIA", V("NO_XAU_X"), V("TONG_NO")), N(100)), (), None, {"CN_NGAN_HANG_NUOC_NGOAI": (70, lower_is_better(1, 2, 3, 5)), "*": (70, lower_is_better(1, 1.5, 3, 5))}),
    Criterion("2.2", "2.2", "A", OP("GIA_TRI_TUYET_DOI", V("NHOM2")), (("NHOM2", True),), {"kieu": "SO_SANH", "truong": "quy_mo", "phep_so_sanh": "LON_HON", "gia_tri": 3},
              {BIG: (30, lower_is_better(0.5, 1, 2, 4)), SMALL_T: (30, lower_is_better(0.5, 1, 2, 4)[:4])}),
    Criterion("2.2.x", "2.2", "A", OP("LUY_THUA", V("NHOM2"), N(1)), (("NHOM2", True),), {"kieu": "SO_SANH", "truong": "quy_mo", "phep_so_sanh": "TRONG_DANH_SACH", "gia_tri": ["2", "6"]},
              {"ALL": (30, lower_is_better(0.5, 1, 2, 4) + [(2, 3, False, 3.2, True)])}),
    Criterion("A_DT", "A_DT", "A", None, (), None, {"ALL": (100, None)}),
    Criterion("5.3", "5.3", "L", OP("MIN", OP("NHAN", OP("CHIA", V("TONG_NO"), V("TIEN_GUI")), N(100)), N(500)), (("TONG_NO", True), ("TIEN_GUI", True)), None,
              {BIG: (100, lower_is_better(70, 80, 90, 95)), BRANCH: (100, lower_is_better(60, 80, 90, 95))}),
]
WEIGHTS = [("C", 20, 15), ("A", 30, 25), ("L", 15, 15)]
_TYPE = "case cast(substr(bank_id, 2) as int) % 4 when 0 then 'NHTM_QUY_MO_LON' when 1 then 'NHTM_QUY_MO_NHO' when 2 then 'CN_NGAN_HANG_NUOC_NGOAI' else 'KHAC' end"
_K = "cast(substr(bank_id, 2) as int)"

fragment("ri", f"""
select bank_id as object_id, period, {_TYPE} as type_code, {_K} % 3 <> 0 as tt41, 1 + {_K} % 6 as quy_mo, equity, rwa, case when {_K} % 5 <> 4 then car_solo end as car_bc, npl_amount, customer_loans, group2_ratio, deposits from wide_m""")


def inputs_frame(fx):
    k = "cast(substr(bank_id, 2) as int)"
    pairs = {"VCSH": "equity", "RWA": "rwa", "CAR_BC": f"case when {k} % 5 <> 4 then car_solo end", NPL_LABEL: "npl_amount", "TONG_NO": "customer_loans",
             "NHOM2": "group2_ratio", "TIEN_GUI": "deposits", CAR_LABEL: "car_solo"}
    entries = ", ".join(f"struct('{n}' as key, {e} as value)" for n, e in pairs.items())
    return fx.view("wide_m").selectExpr(
        "bank_id as object_id", "period", f"{_TYPE} as type_code", "1 as version",
        f"map('tt41', if({k} % 3 <> 0, 'true', 'false'), 'quy_mo', cast(1 + {k} % 6 as string)) as attributes",
        f"map_from_entries(filter(array({entries}), e -> e.value is not null)) as data")


def violations_frame(fx):
    v = fx.view("fx_violation")
    month = F.concat(F.col("period"), F.lit("-06"))
    return v.withColumn("period", month)


def scored(fx):
    return rating.score_criteria(inputs_frame(fx), CRITERIA, violations_frame(fx))


# ---------------------------------------------------------------- inputs
fragment("vin", "select bank_id as object_id, period, v as version, case when v = 3 then 'CHO_DUYET' else 'DA_PHE_DUYET' end as status, case when v = 2 and month(period_ts) = 4 then 0 else 1 end as is_active, customer_loans * v as x from wide_m, (select unnest([1, 2, 3]) as v)")


@query("rating_approved_input", "G01", f"select object_id, period, version, {r('x')} as x from vin where status = 'DA_PHE_DUYET' and is_active = 1 qualify row_number() over (partition by object_id, period order by version desc) = 1")
def _approved(fx):
    w = fx.view("wide_m").select("bank_id", "period", "period_ts", "customer_loans", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version"))
    w = w.selectExpr("bank_id as object_id", "period", "version", "if(version = 3, 'CHO_DUYET', 'DA_PHE_DUYET') as status",
                     "if(version = 2 and month(period_ts) = 4, 0, 1) as is_active", "customer_loans * version as x")
    return rating.approved_inputs(w).select("object_id", "period", "version", half_up("x", 4).alias("x"))


@query("rating_merge_attributes", "G02", f"select object_id, period, case when quy_mo % 2 = 0 then 'input' else 'object' end as a, 'object' as b, case when quy_mo % 2 = 0 then 'input' end as c, coalesce(case when quy_mo > 2 then type_code end, 'OBJ') as type_code from ri where object_id in (select bank_id from fx_inst)")
def _merge(fx):
    k = "cast(substr(object_id, 2) as int)"
    i = inputs_frame(fx).selectExpr("object_id", "period", f"if((1 + {k} % 6) % 2 = 0, map('a', 'input', 'c', 'input'), null) as attributes", f"if(1 + {k} % 6 > 2, type_code, null) as type_code")
    o = fx.inst.selectExpr("bank_id as object_id", "map('a', 'object', 'b', 'object') as attributes", "'OBJ' as type_code")
    m = rating.merge_attributes(i, o).join(fx.inst.selectExpr("bank_id as object_id"), "object_id", "left_semi")
    return m.selectExpr("object_id", "period", "try_element_at(attributes, 'a') as a", "try_element_at(attributes, 'b') as b", "try_element_at(attributes, 'c') as c", "type_code")


_CONDS = [("eq", {"kieu": "SO_SANH", "truong": "tt41", "gia_tri": "true"}, "tt41"), ("ne", {"kieu": "SO_SANH", "truong": "tt41", "phep_so_sanh": "KHAC", "gia_tri": "true"}, "not tt41"),
          ("gt", {"kieu": "SO_SANH", "truong": "quy_mo", "phep_so_sanh": "LON_HON", "gia_tri": 3}, "quy_mo > 3"), ("ge", {"kieu": "SO_SANH", "truong": "quy_mo", "phep_so_sanh": "LON_HON_HOAC_BANG", "gia_tri": 3}, "quy_mo >= 3"),
          ("lt", {"kieu": "SO_SANH", "truong": "quy_mo", "phep_so_sanh": "NHO_HON", "gia_tri": 3}, "quy_mo < 3"), ("le", {"kieu": "SO_SANH", "truong": "quy_mo", "phep_so_sanh": "NHO_HON_HOAC_BANG", "gia_tri": 3}, "quy_mo <= 3"),
          ("in", {"kieu": "SO_SANH", "truong": "quy_mo", "phep_so_sanh": "TRONG_DANH_SACH", "gia_tri": ["2", "6"]}, "quy_mo in (2, 6)"),
          ("not_in", {"kieu": "SO_SANH", "truong": "quy_mo", "phep_so_sanh": "KHONG_TRONG_DANH_SACH", "gia_tri": ["2", "6"]}, "quy_mo not in (2, 6)"), ("always", None, "true")]


@query("rating_conditions", "G03", "select object_id, period, " + ", ".join(f"{e} as c_{n}" for n, _, e in _CONDS) + " from ri")
def _conds(fx):
    return inputs_frame(fx).select("object_id", "period", *[rating.applies(c).alias(f"c_{n}") for n, c, _ in _CONDS])


_TREES = {"ratio": (OP("NHAN", OP("CHIA", V("TONG_NO"), V("TIEN_GUI")), N(100)), "customer_loans / nullif(deposits, 0) * 100"),
          "spread": (OP("TRU", OP("CONG", V("VCSH"), N(5), V("RWA")), V("TIEN_GUI")), "equity + 5 + rwa - deposits"),
          "low": (OP("MIN", V("NHOM2"), N(1), OP("TRU", N(-2))), "case when group2_ratio is not null then least(group2_ratio, 1, 2) end"),
          "mean": (OP("TRUNG_BINH", V("NHOM2"), N(1), N(4)), "(group2_ratio + 1 + 4) / 3"), "power": (OP("LUY_THUA", V("NHOM2"), N(2)), "pow(group2_ratio, 2)"),
          "absolute": (OP("GIA_TRI_TUYET_DOI", OP("TRU", V("VCSH"), V("RWA"))), "abs(equity - rwa)"), "high": (OP("MAX", V("CAR_BC"), N(9)), "case when car_bc is not null then greatest(car_bc, 9) end")}


@query("rating_formula_trees", "G04", "select object_id, period, " + ", ".join(f"{r(e)} as {n}" for n, (_, e) in _TREES.items()) + " from ri")
def _trees(fx):
    get = lambda n: F.try_element_at("data", F.lit(n))
    return inputs_frame(fx).select("object_id", "period", *[half_up(rating.compile_formula(t, get), 4).alias(n) for n, (t, _) in _TREES.items()])


# every label of every code, reported by some banks, zero at others, missing at the rest
_LABELS = sorted({n.lstrip("?") for labels, parts, below in rating.METRIC_FALLBACK.values() for names in (labels, *parts, below) for n in names})
_FIGURES = ["customer_loans", "deposits", "equity", "rwa", "npl_amount", "total_assets", "car_solo"]
_REPORT = {n: f"case when ({_K} + {i}) % 7 = 0 then 0.0 when ({_K} + {i}) % 3 <> 0 then {_FIGURES[i % len(_FIGURES)]} end" for i, n in enumerate(_LABELS)}
_CODES = [*rating.METRIC_FALLBACK, "1.1.a", "9.9"]


def _first_sql(names):
    return "coalesce(" + ", ".join([*[f"nullif(cast({_REPORT[n]} as double), 0)" for n in names[:-1]], f"cast({_REPORT[names[-1]]} as double)"]) + ")" if names else "cast(null as double)"


def _fallback_sql(code):
    """A code's own labels, else what its parts come to against its divisor, in percent."""
    if code == "9.9":
        return "cast(null as double)"
    labels, parts, below = rating.METRIC_FALLBACK[code.removesuffix(".a")]
    if not parts:
        return _first_sql(labels)
    terms = [f"coalesce(cast({_REPORT[p[0][1:]]} as double), 0)" if p[0][0] == "?" else _first_sql(p) for p in parts]
    top = {"6.2": f"abs({' - '.join(terms)})", "5.1": f"case when {' + '.join(terms)} > 0 then {' + '.join(terms)} end"}.get(code, " + ".join(terms))
    return f"coalesce({_first_sql(labels)}, (select floor(q * 10000 + 0.5) / 10000 from (select ({top}) / case when d > 0 then d end * 100 as q from (select {_first_sql(below)} as d))))"


@query("rating_metric_fallback", "G05", "select object_id, period, " + ", ".join(f"{r(n)} as {n}" for n in ("v" + c.replace(".", "") for c in _CODES)) + " from (select bank_id as object_id, period, "
       + ", ".join(f"{_fallback_sql(c)} as v{c.replace('.', '')}" for c in _CODES) + " from wide_m)")
def _fallback(fx):
    entries = ", ".join(f"'{n}', cast({e} as double)" for n, e in _REPORT.items())
    i = fx.view("wide_m").selectExpr("bank_id as object_id", "period", f"map({entries}) as data")
    return i.select("object_id", "period", *[half_up(rating.resolve_metric(c), 4).alias("v" + c.replace(".", "")) for c in _CODES])


# ---------------------------------------------------------------- scoring
_BANDS = [(c.code, t, i, float(b[0]), None if b[1] is None else float(b[1]), b[2], None if b[3] is None else float(b[3]), b[4]) for c in CRITERIA for t, (_, bs) in c.by_type.items() for i, b in enumerate(bs or [])]
fragment("rband", values(_BANDS, "code, config_type, pos, score, low, low_in, high, high_in"))
fragment("rcfg", values([(c.code, t, i, float(w)) for c in CRITERIA for i, (t, (w, _)) in enumerate(c.by_type.items())], "code, config_type, type_pos, weight"))
fragment("rapp", """
select object_id, period, type_code, '1.1.a' as code, '1.1' as root, 'C' as grp, false as qual, equity / nullif(rwa, 0) * 100 as v, '' as miss from ri where tt41
union all select object_id, period, type_code, '1.1.b', '1.1', 'C', false, case when car_bc is not null then greatest(car_bc, 0) end, case when car_bc is null then 'CAR_BC' else '' end from ri where not tt41
union all select object_id, period, type_code, '1.2', '1.2', 'C', false, (car_bc + (car_bc - 1)) / 2, case when car_bc is null then 'CAR_BC' else '' end from ri
union all select object_id, period, type_code, 'C_DT', 'C_DT', 'C', true, null, '' from ri
union all select object_id, period, type_code, '2.1', '2.1', 'A', false, npl21 / nullif(customer_loans, 0) * 100, '' from (select *, floor(nullif(npl_amount, 0) / customer_loans * 100 * 10000 + 0.5) / 10000 as npl21 from ri)
union all select object_id, period, type_code, '2.2', '2.2', 'A', false, abs(group2_ratio), case when group2_ratio is null then 'NHOM2' else '' end from ri where quy_mo > 3
union all select object_id, period, type_code, '2.2.x', '2.2', 'A', false, group2_ratio, case when group2_ratio is null then 'NHOM2' else '' end from ri where quy_mo in (2, 6)
union all select object_id, period, type_code, 'A_DT', 'A_DT', 'A', true, null, '' from ri
union all select object_id, period, type_code, '5.3', '5.3', 'L', false, least(customer_loans / nullif(deposits, 0) * 100, 500), '' from ri""")
fragment("rrow", f"""
select a.*, {r('v')} as value, count(*) over (partition by object_id, period, root) as n_variants, c.config_type, c.weight from rapp a left join (
  select * from (select *, row_number() over (partition by code, type_code order by type_pos) as k from (select g.code, g.config_type, g.type_pos, g.weight, t.type_code from rcfg g, (select distinct type_code from ri) t
    where g.config_type in ('ALL', '*') or g.config_type = t.type_code or (g.config_type in ('CN_NGAN_HANG_NUOC_NGOAI', 'CHI_NHANH_NGAN_HANG_NUOC_NGOAI') and t.type_code in ('CN_NGAN_HANG_NUOC_NGOAI', 'CHI_NHANH_NGAN_HANG_NUOC_NGOAI')))) where k = 1) c using (code, type_code)""")
fragment("rhit", """
select *, (select count(*) from rband b where b.code = w.code and b.config_type = w.config_type and (low is null or case when low_in then value >= low else value > low end) and (high is null or case when high_in then value <= high else value < high end)) as n_hit,
  (select arg_min(score, pos) from rband b where b.code = w.code and b.config_type = w.config_type and (low is null or case when low_in then value >= low else value > low end) and (high is null or case when high_in then value <= high else value < high end)) as hit from rrow w""")
fragment("rqual", """
select object_id, period || '-06' as period, group_code as grp, count(*) as n_violations, cast(sum(greatest(n_times, 1)) as bigint) as n_times, cast(sum(greatest(n_times - 1, 0)) as bigint) as n_repeats,
  cast(min(b) as double) as base_score, least(sum(greatest(n_times - 1, 0)), 9) / 10.0::double as deduction, greatest(min(b) * 10 - least(sum(greatest(n_times - 1, 0)), 9), 10) / 10.0::double as qualitative_score
from (select *, case when fine_mn is null or fine_mn <= 100 then 4 when fine_mn <= 200 then 3 when fine_mn <= 300 then 2 else 1 end as b from fx_violation where (found_by_authority or self_reported) and (found_in_year or (found_earlier and not remediated)))
group by object_id, period, group_code""")
fragment("rscore", f"""
select *, {r('band_score * weight / 100')} as converted_score from (
  select w.*, case when n_variants > 1 then 'VARIANT_CONFLICT' when weight is null then 'NOT_APPLICABLE' when qual then 'SCORED' when miss <> '' or value is null then 'MISSING_INPUT' when n_hit = 0 then 'NO_BAND' when n_hit > 1 then 'OVERLAPPING_BANDS' else 'SCORED' end as status,
    case when n_variants = 1 and weight is not null then case when qual then coalesce(qualitative_score, 5) when miss = '' and n_hit = 1 then hit end end as band_score
  from rhit w left join rqual using (object_id, period, grp))""")


@query("rating_band_lookup", "G06", "select object_id, period, code, value, status, band_score from rscore")
def _band(fx):
    return scored(fx).select("object_id", "period", "code", "value", "status", "band_score")


_LIMIT = "case when floor({0}) = {0} then cast(cast({0} as bigint) as varchar) else cast({0} as varchar) end"


@query("rating_band_explanation", "G07", f"""
select object_id, period, code, 'value ' || case when floor(value) = value then cast(cast(value as bigint) as varchar) else case when value < 0 then '-' else '' end || cast(t // 1000 as varchar) || ',' || lpad(cast(t % 1000 as varchar), 3, '0') end
  || case when low is not null and high is not null then ' ' || up || ' ' || ltxt || ' and ' || down || ' ' || htxt when high is not null then ' ' || down || ' ' || htxt when low is not null then ' ' || up || ' ' || ltxt else '' end || ': ' || cast(cast(score as int) as varchar) || ' points' as explanation
from (select s.*, b.low, b.high, b.score, {_LIMIT.format('b.low')} as ltxt, {_LIMIT.format('b.high')} as htxt, case when low_in then '>=' else '>' end as up, case when high_in then '<=' else '<' end as down, cast(floor(abs(value) * 1000 + 0.5) as bigint) as t
  from rscore s join rband b on b.code = s.code and b.config_type = s.config_type and (low is null or case when low_in then value >= low else value > low end) and (high is null or case when high_in then value <= high else value < high end)
  where status = 'SCORED' and not qual)""")
def _explain(fx):
    return scored(fx).where("explanation is not null").select("object_id", "period", "code", "explanation")


@query("rating_band_builders", "G08", "select bank_id, period, case when h >= 15 then 5 when h >= 12 then 4 when h >= 8 then 3 when h >= 5 then 2 else 1 end::double as higher, case when l <= 1 then 5 when l <= 1.5 then 4 when l <= 3 then 3 when l <= 5 then 2 else 1 end::double as lower "
       f"from (select bank_id, period, {r('car_solo')} as h, {r('npl_ratio')} as l from feat where car_solo is not null)")
def _builders(fx):
    c = [Criterion("h", "h", "C", V("H"), (), None, {"ALL": (100, higher_is_better(15, 12, 8, 5))}), Criterion("l", "l", "A", V("L"), (), None, {"ALL": (100, lower_is_better(1, 1.5, 3, 5))})]
    i = fx.features.where("car_solo is not null").selectExpr("bank_id as object_id", "period", "'X' as type_code", "map('a', 'b') as attributes", "map('H', car_solo, 'L', npl_ratio) as data")
    s = rating.score_criteria(i, c).groupBy("object_id", "period").agg(F.max(F.when(F.col("code") == "h", F.col("band_score"))).alias("higher"), F.max(F.when(F.col("code") == "l", F.col("band_score"))).alias("lower"))
    return s.withColumnRenamed("object_id", "bank_id")


@query("rating_type_configuration", "G09", "select object_id, period, code, config_type, weight from rrow")
def _types(fx):
    rows = rating.with_configuration(rating.applicable_criteria(inputs_frame(fx), CRITERIA), CRITERIA)
    return rows.select("object_id", "period", "code", "config_type", "weight")


@query("rating_variant_conflicts", "G10", "select object_id, period, root, count(*) as n, string_agg(code, ',' order by code) as codes from rapp group by object_id, period, root having count(*) > 1")
def _conflicts(fx):
    rows = rating.applicable_criteria(inputs_frame(fx), CRITERIA).where("n_variants > 1")
    return rows.groupBy("object_id", "period", "root").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


@query("rating_missing_variables", "G11", "select object_id, period, code, miss as variable from rrow where n_variants = 1 and weight is not null and miss <> ''")
def _missv(fx):
    return rating.missing_variables(inputs_frame(fx), CRITERIA)


@query("rating_converted_score", "G12", "select object_id, period, code, weight, converted_score from rscore where status = 'SCORED'")
def _conv(fx):
    return scored(fx).where("status = 'SCORED'").select("object_id", "period", "code", "weight", "converted_score")


fragment("rw", values([(g, float(w), float(q)) for g, w, q in WEIGHTS], "grp, w, wq"))
fragment("rgroup", f"""
select object_id, period, grp, quantitative, qualitative, {r('coalesce(quantitative, 0) * (wq / 100) + coalesce(qualitative, 0) * (greatest(w - wq, 0) / 100)')} as group_score from (
  select object_id, period, grp, {r('sum(converted_score) filter (not qual)')} as quantitative, {r('sum(converted_score) filter (qual)')} as qualitative from rscore where status = 'SCORED' group by object_id, period, grp) join rw using (grp)""")
fragment("rtotal", f"""
select object_id, period, {r('t', 2)} as total_score, case when t >= 4.5 then 'A' when t >= 3.5 then 'B' when t >= 2.5 then 'C' when t >= 1.5 then 'D' else 'E' end as grade
from (select object_id, period, sum(cast(floor(group_score * 10000 + 0.5) as bigint))::double / 10000.0::double as t from rgroup group by object_id, period)""")


def groups_frame(fx):
    return rating.group_scores(scored(fx), rating.group_weights(fx.spark, WEIGHTS))


@query("rating_group_score", "G13", "select object_id, period, grp as \"group\", quantitative, qualitative, group_score from rgroup")
def _groups(fx):
    return groups_frame(fx)


@query("rating_total_grade", "G14", "select * from rtotal")
def _total(fx):
    return rating.totals(groups_frame(fx))


@query("rating_qualitative_score", "G15", "select object_id, period, grp as \"group\", n_violations, n_times, n_repeats, base_score, deduction, qualitative_score from rqual")
def _qual(fx):
    return rating.qualitative_scores(violations_frame(fx))


fragment("rcar0", f"select bank_id as object_id, period, year(period_ts) * 12 + month(period_ts) as m, {r('car_solo', 3)} * case when {_K} % 10 = 0 then 0.3::double else 1 end as car from wide_m")
fragment("rcar", f"select *, floor(car * 1000 + 0.5) / 1000 as c from rcar0")
fragment("rcarw", f"""
select a.object_id, a.period, count(b.c) as n, {r('sum(cast(floor(b.c * 1000 + 0.5) as bigint))::double / 1000.0::double / count(b.c)', 3)} as car_mean, min(b.c) as car_min, max(b.c) as car_max, count(b.c) >= 12 and coalesce(max(b.c) < 8, true) as below_8_all
from rcar a join rcar b on a.object_id = b.object_id and b.m between a.m - 11 and a.m group by a.object_id, a.period""")
fragment("rrun", """
select object_id, period, max(len) as longest from (select object_id, period, g, count(*) as len from (
  select a.object_id, a.period, b.m, b.c, row_number() over (partition by a.object_id, a.period order by b.m) - row_number() over (partition by a.object_id, a.period, b.c < 4 order by b.m) as g from rcar a join rcar b on a.object_id = b.object_id and b.m between a.m - 11 and a.m where b.c is not null)
  where c < 4 group by object_id, period, g) group by object_id, period""")


def car_frame(fx):
    k = "cast(substr(bank_id, 2) as int)"
    i = fx.view("wide_m").selectExpr("bank_id as object_id", "period", f"if(car_solo is null, map(), map('CAR', floor(car_solo * 1000 + 0.5D) / 1000D * if({k} % 10 = 0, 0.3D, 1D))) as data")
    return rating.car_window(i)


@query("rating_car_window", "G16", "select object_id, period, n as n_months, car_mean, car_min, car_max, below_8_all, cast(coalesce(longest, 0) as int) as longest_below_4 from rcarw left join rrun using (object_id, period)")
def _car(fx):
    return car_frame(fx).drop("month").withColumn("n_months", F.col("n_months").cast("bigint"))


@query("rating_forced_downgrade", "G17", f"""
select object_id, period, grade as original_grade, loss_ratio, coalesce(loss_ratio > 50, false) as loss_breach, coalesce(below_8_all or longest >= 6, false) as car_breach, weak as liquidity_advisory,
  case when coalesce(loss_ratio > 50, false) or coalesce(below_8_all or longest >= 6, false) then 'E' else grade end as final_grade
from rtotal join (select bank_id as object_id, period, case when charter_capital <> 0 then case when profit_before_tax >= 0 then 0 else {r('abs(profit_before_tax * 40) / charter_capital * 100', 2)} end end as loss_ratio from wide_m) using (object_id, period)
left join rcarw using (object_id, period) left join rrun using (object_id, period) left join (select object_id, period, coalesce(bool_or(band_score < 2), false) as weak from rscore where grp = 'L' group by object_id, period) using (object_id, period)""")
def _down(fx):
    fx = fx.staged
    losses = fx.view("wide_m").selectExpr("bank_id as object_id", "period", "profit_before_tax * 40 as retained", "charter_capital as capital")
    s = scored(fx)
    out = rating.forced_downgrade(rating.totals(rating.group_scores(s, rating.group_weights(fx.spark, WEIGHTS))), losses, car_frame(fx), s)
    return out.select("object_id", "period", "original_grade", "loss_ratio", "loss_breach", "car_breach", "liquidity_advisory", "final_grade")


# ---------------------------------------------------------------- template path
_LINES = {"R-106": "equity", "R-107": "rwa", "R-109": "case when month(period_ts) % 2 = 0 then car_tier1 end", "R-113": "tier1_capital", "R-114": "rwa", "R-116": "case when month(period_ts) % 3 = 0 then npl_amount / customer_loans * 100 end", "R-117": "npl_amount",
          "R-119": "provisions", "R-120": "customer_loans", "R-121": "group2_ratio", "R-125": "top100_customer_loans", "R-126": "customer_loans", "R-128": "off_balance_commitments * 0.01", "R-130": "total_assets", "R-143": "operating_expense", "R-144": "toi",
          "R-154": "profit_before_tax * 12", "R-155": "equity", "R-157": "profit_before_tax * 12", "R-158": "total_assets", "R-160": "net_interest_income", "R-161": "total_assets", "R-172": "hqla", "R-173": "total_assets", "R-175": "medium_long_term_loans", "R-176": "medium_long_term_funding",
          "R-177": "customer_loans", "R-179": "customer_loans", "R-180": "deposits", "R-182": "valuable_papers_issued", "R-183": "deposits", "R-185": "fx_position_ratio", "R-187": "rate_sensitive_assets", "R-188": "rate_sensitive_liabilities", "R-189": "equity"}
_COLS = {c: c.replace("R-", "r") for c in rating.template_codes()}
fragment("tw", "select bank_id as object_id, period, " + ", ".join(f"{_LINES.get(c, 'cast(null as double)')} as {n}" for c, n in _COLS.items()) + " from wide_m")


def lines_frame(fx):
    cells = ", ".join(f"struct('{c}' as code, cast({e} as double) as value)" for c, e in _LINES.items())
    return fx.view("wide_m").selectExpr("bank_id as object_id", "period", f"explode(array({cells})) as l").selectExpr("object_id", "period", "l.code", "l.value")


def items_frame(fx):
    return rating.template_items(rating.template_wide(lines_frame(fx), rating.template_codes()))


def _item_sql():
    out = []
    z = lambda c: f"coalesce({c.lstrip('-').replace('R-', 'r')}, 0)"
    for item, g, rep, num, den, d, n1, n2, n3, n4, w in rating.TEMPLATE_ITEMS:
        parts = [c.replace("R-", "r") for c in rep]
        if num:
            bottom = "(" + " + ".join(z(c) for c in den) + ")"
            parts.append(f"case when {bottom} > 0 then (" + " + ".join(("-" if c.startswith("-") else "") + z(c) for c in num) + f") / {bottom} * 100 end")
        v = f"coalesce({', '.join(parts)})"
        op = ">=" if d == "higher" else "<="
        x = "abs(v)" if d == "lower_abs" else "v"
        out.append(f"select object_id, period, '{item}' as item, '{g}' as grp, v, cast(case when {x} {op} {n1} then 5 when {x} {op} {n2} then 4 when {x} {op} {n3} then 3 when {x} {op} {n4} then 2 when v is not null then 1 end as int) as score, {w}::double as weight from (select object_id, period, {v} as v from tw)")
    return " union all ".join(out)


fragment("titem", _item_sql())


@query("rating_template_formula", "G18", f"select object_id, period, {r('coalesce((coalesce(r117, 0) + coalesce(r119, 0)) / nullif(coalesce(r120, 0), 0) * 100, 0)')} as bad_share, {r('coalesce((coalesce(r175, 0) - coalesce(r176, 0)) / nullif(coalesce(r177, 0), 0) * 100, 0)')} as st_share, {r('coalesce(r106, 0) * 1.0::double')} as plain from tw")
def _formula(fx):
    w = rating.template_wide(lines_frame(fx), rating.template_codes())
    f = rating.template_formula
    return w.select("object_id", "period", *[half_up(F.expr(e), 4).alias(n) for n, e in {
        "bad_share": f(["R-117", "R-119"], ["R-120"]), "st_share": f(["R-175", "R-176"], ["R-177"], minus=True), "plain": f(["R-106"], [], 1.0)}.items()])


@query("rating_template_items", "G19", f"select object_id, period, item, {r('v', 3)} as value, score, weight, {r('score * weight / 100', 3)} as converted_score from titem")
def _items(fx):
    return items_frame(fx).select("object_id", "period", "item", "value", "score", "weight", "converted_score")


_TQ = rating.TEMPLATE_QUALITATIVE
_CONV3 = r("score * weight / 100", 3)
_GSQL = {g: f"(coalesce(sum(cast(floor({_CONV3} * 1000 + 0.5) as bigint)) filter (grp = '{g}'), 0) + cast(floor(coalesce(max(q) filter (grp = '{g}'), 5) * {w} * 10 + 0.5) as bigint))" for g, w in _TQ.items()}
fragment("trate", "select *, case when total_score >= 4 then 'A' when total_score >= 3 then 'B' when total_score >= 2 then 'C' else 'D' end as original_grade from (select object_id, period, "
         + ", ".join(f"{r(e + '::double / 1000.0::double', 2)} as group_{g}" for g, e in _GSQL.items()) + f", {r('(' + ' + '.join(_GSQL.values()) + ')::double / 1000.0::double', 2)} as total_score, "
         + "coalesce(bool_or(grp = 'L' and score < 2), false) or coalesce(max(q) filter (grp = 'L'), 5) < 2 or coalesce(max(" + r("v", 3) + ") filter (item = '1.1') < 8, false) as forced_e, count(*) filter (score is null) as n_not_evaluated "
         + "from titem left join (select object_id, period, grp, qualitative_score as q from rqual) using (object_id, period, grp) group by object_id, period)")


def template_frame(fx):
    return rating.template_rating(items_frame(fx), rating.qualitative_scores(violations_frame(fx)))


@query("rating_template_result", "G19", "select *, case when forced_e then 'E' else original_grade end as final_grade from trate")
def _trate(fx):
    return template_frame(fx).drop("quantitative_total", "qualitative_total")


_GL = rating.TEMPLATE_GROUP_LINES
fragment("tline", " union all ".join(f"select bank_id as object_id, period, '{c}' as code, cast({e} as double) as value from wide_m" for c, e in {**{"R-121": "group2_ratio", "R-185": "fx_position_ratio"}, **{l: "customer_loans" for l in _GL.values()}}.items()))
_FIRST = {i[0]: i[2][0] for i in rating.TEMPLATE_ITEMS}


@query("rating_scores_on_lines", "G20", f"""
select l.object_id, l.period, l.code, {r('l.value')} as value, s.score, s.converted_score, s.kind as score_kind from tline l left join (
  select object_id, period, case item {' '.join(f"when '{i}' then '{c}'" for i, c in _FIRST.items())} end as code, cast(score as double) as score, {r('score * weight / 100', 3)} as converted_score, 'CHI_TIEU' as kind from titem
  union all {' union all '.join(f"select object_id, period, '{l}', null, group_{g}, 'NHOM' from trate" for g, l in _GL.items())}) s using (object_id, period, code)""")
def _lines(fx):
    keep = {"R-121": "group2_ratio", "R-185": "fx_position_ratio", **{l: "customer_loans" for l in _GL.values()}}
    cells = ", ".join(f"struct('{c}' as code, cast({e} as double) as value)" for c, e in keep.items())
    rows = fx.view("wide_m").selectExpr("bank_id as object_id", "period", f"explode(array({cells})) as l").selectExpr("object_id", "period", "l.code", "l.value")
    out = rating.scores_on_lines(rows, items_frame(fx), template_frame(fx))
    return out.withColumn("value", half_up("value", 4))


# ---------------------------------------------------------------- configuration checks over the inputs they touch
_BAD = [Criterion("b1", "b1", "C", OP("CONG", V("VCSH")), (("VCSH", True),), None, {"ALL": (60, [(6, None, False, 1, True), (4, 1, False, None, False)])}),
        Criterion("b2", "b2", "C", OP("CHIA", V("XX"), N(None)), (("VCSH", True),), None, {"ALL": (30, [(4, 1, False, 2, True), (4, 1, False, 2, True)])}),
        Criterion("b3", "b3", "A", OP("CAN", V("VCSH"), N(2)), (("VCSH", True),), None, {"ALL": (100, lower_is_better(1, 2, 3, 4))})]
_BADB = [(c.code, t, i, float(b[0]), None if b[1] is None else float(b[1]), b[2], None if b[3] is None else float(b[3]), b[4]) for c in _BAD for t, (_, bs) in c.by_type.items() for i, b in enumerate(bs)]


@query("rating_config_formula_errors", "G21", "select code, error, count(*) as n_inputs from (select * from (values ('b1', 'WRONG_ARITY'), ('b2', 'UNDECLARED_VARIABLE'), ('b2', 'NULL_CONSTANT'), ('b3', 'UNKNOWN_OPERATION')) as t(code, error)), wide_m group by code, error")
def _ferr(fx):
    """Faulty formulas with the number of inputs each would leave unrated."""
    n = inputs_frame(fx).agg(F.count(F.lit(1)).alias("n_inputs"))
    return rating.formula_errors(fx.spark, _BAD).select("code", "error").crossJoin(n)


fragment("badband", values(_BADB, "code, type, pos, score, low, low_in, high, high_in"))


@query("rating_config_band_errors", "G22", "select code, error, n_inputs from (select code, 'SCORE_TOO_HIGH' as error from badband where score > 5 union all select code, 'IDENTICAL_BANDS' from badband group by code, type, score, low, low_in, high, high_in having count(*) > 1), (select count(*) as n_inputs from wide_m)")
def _berr(fx):
    n = inputs_frame(fx).agg(F.count(F.lit(1)).alias("n_inputs"))
    return rating.band_errors(rating.band_table(fx.spark, _BAD)).select("code", "error").crossJoin(n)


@query("rating_config_weight_errors", "G23", "select 'C' as \"group\", 90.0::double as total_weight, n_inputs from (select count(*) as n_inputs from wide_m)")
def _werr(fx):
    from prudens.functions.tables import literal_table
    g = literal_table(fx.spark, "code string, group string", [(c.code, c.group) for c in _BAD])
    n = inputs_frame(fx).agg(F.count(F.lit(1)).alias("n_inputs"))
    return rating.weight_errors(rating.weight_table(fx.spark, _BAD), g).select("group", "total_weight").crossJoin(n)


@query("rating_batch_summary", "G24", "select object_id, period, count(*) filter (bad) = 0 as ok, case when count(*) filter (bad) > 0 then arg_min(status, code) filter (bad) end as error, count(*) filter (bad) as n_errors from (select *, status in ('VARIANT_CONFLICT', 'MISSING_INPUT', 'NO_BAND', 'OVERLAPPING_BANDS') as bad from rscore) group by object_id, period")
def _batch(fx):
    return rating.batch_summary(scored(fx))


@query("rating_ranking", "G25", "select object_id, period, total_score, rank() over (partition by period order by total_score desc) as rank, rank() over (partition by period order by total_score desc) || '/' || count(*) over (partition by period) as rank_text from rtotal")
def _ranking(fx):
    return rating.rank_objects(stage(rating.totals(groups_frame(fx)), "totals"), "total_score").drop("grade")


@query("rating_grade_counts", "G25", "select period, grade, count(*) as n from rtotal group by period, grade")
def _gc(fx):
    return rating.grade_counts(rating.totals(groups_frame(fx)))


@query("rating_history", "G26", f"select object_id, period, total_score, lag(total_score) over w as previous, {r('total_score - lag(total_score) over w', 2)} as change from rtotal window w as (partition by object_id order by period)")
def _hist(fx):
    return rating.score_history(rating.totals(groups_frame(fx))).drop("grade")


# ---------------------------------------------------------------- a whole run
_VERSION = "case when month(period_ts) = 4 then 1 else 2 end"


def versions_frame(fx):
    """Three versions of each input: the third pending, the second withdrawn every April; some banks have no approved one."""
    current = fx.view("wide_m").selectExpr("bank_id as object_id", "period", f"{_VERSION} as good",
                                           f"map_from_entries(filter(array(struct('{CAR_LABEL}' as key, floor(car_solo * 1000 + 0.5D) / 1000D * if({_K} % 10 = 0, 0.3D, 1D) as value)), e -> e.value is not null)) as car")
    i = inputs_frame(fx).drop("version").join(current, ["object_id", "period"])
    data = f"map_concat(map_filter(data, (k, v) -> k <> '{CAR_LABEL}'), car)"
    k = _K.replace("bank_id", "object_id")
    return i.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).selectExpr(
        "object_id", "period", "version", f"if(version = 3 or {k} % 11 = 5, 'CHO_DUYET', 'DA_PHE_DUYET') as status", "if(version = 2 and good = 1, 0, 1) as is_active",
        "if(version = good, type_code, 'OLD') as type_code", "if(version = good, map('quy_mo', attributes['quy_mo']), map()) as attributes",
        f"if(version = good, {data}, map()) as data")


def objects_frame(fx):
    return fx.view("wide_m").select("bank_id").distinct().selectExpr("bank_id as object_id", "'OBJECT' as type_code", f"map('tt41', if({_K} % 3 <> 0, 'true', 'false'), 'quy_mo', '99') as attributes")


def whole_run(fx):
    losses = fx.view("wide_m").selectExpr("bank_id as object_id", "period", "profit_before_tax * 40 as retained", "charter_capital as capital")
    return run_rating(versions_frame(fx), objects_frame(fx), CRITERIA, WEIGHTS, violations_frame(fx), losses)


fragment("runbad", f"""
select object_id, period, case when not ok then 'NO_APPROVED_INPUT' else first.status end as error, case when ok then first.code end as code, case when ok then n else 0 end as n_errors, case when ok then coalesce(gaps, '') end as missing from (
  select object_id, period, {_K.replace("bank_id", "object_id")} % 11 <> 5 as ok, min(struct_pack(code := code, status := status)) filter (bad) as first, count(*) filter (bad) as n, string_agg(distinct miss, ',' order by miss) filter (bad and miss <> '') as gaps
  from (select *, status in ('VARIANT_CONFLICT', 'MISSING_INPUT', 'NO_BAND', 'OVERLAPPING_BANDS') as bad from rscore) group by object_id, period)""")
fragment("rungood", f"select object_id, period, grp, code, status, band_score from rscore semi join (select * from runbad where error is null) using (object_id, period)")
fragment("runrate", f"""
select object_id, period, total_score, grade as original_grade, loss_ratio, coalesce(loss_ratio > 50, false) as loss_breach, coalesce(below_8_all or longest >= 6, false) as car_breach, weak as liquidity_advisory,
  concat_ws('; ', case when loss_ratio > 50 then 'losses above 50% of capital' end, case when below_8_all then 'CAR below 8% in 12 months' end, case when longest >= 6 then 'CAR below 4% in 6 running months' end) as reasons,
  case when coalesce(loss_ratio > 50, false) or coalesce(below_8_all or longest >= 6, false) then 'E' else grade end as final_grade
from rtotal semi join rungood using (object_id, period) join (select bank_id as object_id, period, {_VERSION} as version, case when charter_capital <> 0 then case when profit_before_tax >= 0 then 0 else {r('abs(profit_before_tax * 40) / charter_capital * 100', 2)} end end as loss_ratio from wide_m) using (object_id, period)
left join rcarw using (object_id, period) left join rrun using (object_id, period) left join (select object_id, period, coalesce(bool_or(band_score < 2), false) as weak from rungood where grp = 'L' and code <> 'L_DT' group by object_id, period) using (object_id, period)""")


@query("rating_run_results", "G01 G02 G14 G17 G25 G26", f"""
select r.object_id, r.period, total_score, original_grade, final_grade, loss_ratio, loss_breach, car_breach, loss_breach or car_breach as forced_e, coalesce(liquidity_advisory, false) as liquidity_advisory, reasons,
  rank() over (partition by r.period order by total_score desc) as rank, rank() over (partition by r.period order by total_score desc) || '/' || count(*) over (partition by r.period) as rank_text,
  lag(total_score) over w as previous, {r('total_score - lag(total_score) over w', 2)} as change, {_TYPE.replace('bank_id', 'r.object_id')} as type_code, v.version
from runrate r join (select bank_id as object_id, period, {_VERSION} as version from wide_m) v using (object_id, period) window w as (partition by r.object_id order by r.period)""")
def _run_results(fx):
    """Every input from its versions to grade, downgrade, rank and change."""
    return whole_run(fx).results


@query("rating_run_errors", "G11 G24", "select object_id, period, error, code, n_errors, coalesce(missing, '') as missing from runbad where error is not null")
def _run_errors(fx):
    """Inputs that could not be rated, and why."""
    return whole_run(fx).errors.withColumn("missing", F.coalesce("missing", F.lit("")))


@query("rating_run_groups", "G13", "select object_id, period, grp as \"group\", quantitative, qualitative, group_score from rgroup semi join rungood using (object_id, period)")
def _run_groups(fx):
    return whole_run(fx).groups
