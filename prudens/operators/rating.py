"""Criteria-set rating of institutions.

All inputs meet all criteria in one plan: applicability and value of each criterion are
expressions on the input row, exploded once; bands and weights are small configuration tables.
What a single-object service would raise as an exception is a row with an error code here.
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from prudens.functions.ranks import Positions
from prudens.functions.numeric import half_up
from prudens.functions.tables import literal_table

KEY = ["object_id", "period"]
WILDCARDS = ["ALL", "*"]
# Institution-type codes that mean the same.
TYPE_ALIASES = [{"CN_NGAN_HANG_NUOC_NGOAI", "CHI_NHANH_NGAN_HANG_NUOC_NGOAI"}]
# Grade ladders, (minimum score, grade).
LADDER = [(4.5, "A"), (3.5, "B"), (2.5, "C"), (1.5, "D"), (None, "E")]
TEMPLATE_LADDER = [(4.0, "A"), (3.0, "B"), (2.0, "C"), (None, "D")]


@dataclass(frozen=True)
class Criterion:
    """``formula`` is a tree of nodes ``{"gia_tri": x} | {"ma_bien": v} | {"phep_toan": op, "tham_so": [...]}``;
    without one the criterion is qualitative. ``by_type`` maps a type code to ``(weight, bands)``,
    a band being ``(score, low, low_inclusive, high, high_inclusive)``."""
    code: str
    root: str
    group: str
    formula: dict | None = None
    variables: tuple = ()            # (name, required)
    condition: dict | None = None
    by_type: dict = field(default_factory=dict)


# ------------------------------------------------------------------ inputs
def approved_inputs(inputs: DataFrame) -> DataFrame:
    """The highest version of each object and period among approved, active inputs."""
    ok = inputs.where((F.col("status") == "DA_PHE_DUYET") & (F.col("is_active") == 1))
    rest = [c for c in inputs.columns if c not in KEY]
    best = ok.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.col("version")).alias("_r"))
    return best.select(*[F.col(c) if c in KEY else F.col(f"_r.{c}").alias(c) for c in inputs.columns])


def merge_attributes(inputs: DataFrame, objects: DataFrame) -> DataFrame:
    """Attributes and type of the object, overridden by those of the input."""
    o = objects.select("object_id", F.col("attributes").alias("_oa"), F.col("type_code").alias("_ot"))
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce("attributes", none)
    # object entries whose key the input does not set, then the input's
    kept = F.map_filter(F.coalesce("_oa", none), lambda k, v: ~F.map_contains_key(own, k))
    return inputs.join(o, "object_id", "left").select(
        *[c for c in inputs.columns if c not in ("attributes", "type_code")],
        F.map_concat(kept, own).alias("attributes"), F.coalesce("type_code", "_ot").alias("type_code"))


# ------------------------------------------------------------------ configuration to expressions
def applies(condition: dict | None, attributes: str = "attributes") -> Column:
    """Applicability of a criterion: always, or a comparison on one attribute."""
    if not condition or condition.get("kieu", "LUON_DUNG") == "LUON_DUNG" or not condition.get("truong"):
        return F.lit(True)
    if condition["kieu"] != "SO_SANH":
        return F.lit(True)
    value, target, op = F.try_element_at(attributes, F.lit(condition["truong"])), condition.get("gia_tri"), condition.get("phep_so_sanh", "BANG")
    if op in ("TRONG_DANH_SACH", "KHONG_TRONG_DANH_SACH"):
        if not isinstance(target, (list, tuple, set)):
            return F.lit(False)
        inside = F.coalesce(value.isin([str(t) for t in target]), F.lit(False))
        return inside if op == "TRONG_DANH_SACH" else ~inside
    if op in ("BANG", "KHAC"):
        same = value.eqNullSafe(F.lit(None if target is None else str(target)))
        return same if op == "BANG" else ~same
    number = value.try_cast("double")
    tests = {"LON_HON": number > target, "LON_HON_HOAC_BANG": number >= target, "NHO_HON": number < target, "NHO_HON_HOAC_BANG": number <= target} \
        if isinstance(target, (int, float)) else {}
    return F.coalesce(tests[op], F.lit(False)) if op in tests else F.lit(False)


class FormulaError(ValueError):
    """A formula tree that cannot be evaluated."""


def compile_formula(node: dict, variable) -> Column:
    """A formula tree as one column; null when a variable is missing or a divisor is zero."""
    if "gia_tri" in node:
        if node["gia_tri"] is None:
            raise FormulaError("constant is null")
        return F.lit(float(node["gia_tri"]))
    if "ma_bien" in node:
        return variable(node["ma_bien"])
    op, args = node.get("phep_toan"), [compile_formula(p, variable) for p in node.get("tham_so", [])]
    arity = {"CONG": (2, None), "NHAN": (2, None), "TRU": (1, 2), "CHIA": (2, 2), "MIN": (1, None), "MAX": (1, None),
             "TRUNG_BINH": (1, None), "LUY_THUA": (2, 2), "GIA_TRI_TUYET_DOI": (1, 1)}
    if op not in arity:
        raise FormulaError(f"unknown operation {op}")
    low, high = arity[op]
    if len(args) < low or (high is not None and len(args) > high):
        raise FormulaError(f"{op} takes {low}..{high} arguments, got {len(args)}")
    total = args[0]
    if op in ("CONG", "TRUNG_BINH"):
        for a in args[1:]:
            total = total + a
        return total / len(args) if op == "TRUNG_BINH" else total
    if op == "TRU":
        return -args[0] if len(args) == 1 else args[0] - args[1]
    if op == "NHAN":
        for a in args[1:]:
            total = total * a
        return total
    if op == "CHIA":
        return args[0] / F.nullif(args[1], F.lit(0.0))
    if op in ("MIN", "MAX"):
        if len(args) == 1:
            return total
        known = total.isNotNull()
        for a in args[1:]:
            known = known & a.isNotNull()
        return F.when(known, F.least(*args) if op == "MIN" else F.greatest(*args))
    if op == "LUY_THUA":
        return F.pow(args[0], args[1])
    return F.abs(args[0])


# Per criterion code, labels that report it, then components: numerators and divisors.
METRIC_FALLBACK = {
    "1.1": (["Tỷ lệ an toàn vốn tối thiểu (CAR) (riêng lẻ)", "Tỷ lệ an toàn vốn (CAR) hợp nhất", "CAR"],
            [["Giá trị vốn cấp 1", "VON_CAP_1"], ["?Giá trị vốn cấp 2"]], ["Tài sản có rủi ro (RWA)", "RWA"]),
    "1.2": (["Tỷ lệ an toàn vốn cấp 1", "CAR1"], [["Giá trị vốn cấp 1", "VON_CAP_1"]], ["Tài sản có rủi ro (RWA)", "RWA"]),
    "2.1": (["Tỷ lệ nợ xấu", "NO_XAU_PCT"], [["Tổng nợ xấu", "NO_XAU"]], ["Tổng dư nợ cho vay khách hàng (gộp)", "TONG_NO"]),
    "2.2": (["Tỷ lệ nợ Nhóm 2 so với tổng nợ", "NO_NHOM_2_PCT"], [["Nợ nhóm 2", "NO_NHOM_2"]], ["Tổng dư nợ cho vay khách hàng (gộp)", "TONG_NO"]),
    "2.3": (["Tỷ lệ dư nợ nhóm khách hàng lớn nhất / dư nợ cho vay"],
            [["Dư nợ 100 khách hàng lớn nhất và người liên quan (nội bảng)", "DU_NO_KHACH_HANG_LON"]], ["Tổng dư nợ cho vay khách hàng (gộp)", "TONG_NO"]),
    "2.4": (["Tỷ lệ nợ và cam kết ngoại bảng nhóm 3-5 / tổng (1-5)"], [], []),
    "2.5": ([], [["Dư nợ ngành nông nghiệp, lâm nghiệp, thủy sản (lĩnh vực ưu tiên)"]], ["Tổng dư nợ cho vay khách hàng (gộp)", "TONG_NO"]),
    "2.6": (["Tỷ lệ dự phòng RR chứng khoán KD, đầu tư / số dư CK"], [["Số dư dự phòng rủi ro tín dụng"]], ["Chứng khoán đầu tư"]),
    "2.7": (["Tỷ lệ dư nợ đầu tư, kinh doanh bất động sản"], [["Dư nợ cấp tín dụng lĩnh vực bất động sản", "DU_NO_BAT_DONG_SAN"]],
            ["Tổng dư nợ cho vay khách hàng (gộp)", "TONG_NO"]),
    "3.1": (["Tỷ lệ chi phí / thu nhập (CIR)", "CIR"], [["Chi phí hoạt động", "CHI_PHI_HOAT_DONG"]],
            ["Tổng thu nhập hoạt động (TOI)", "TONG_THU_NHAP_HOAT_DONG"]),
    "4.1": (["Tỷ suất sinh lời vốn chủ sở hữu (ROE)", "ROE"], [["Lợi nhuận sau thuế", "Lợi nhuận trước thuế", "LOI_NHUAN_TRUOC_THUE"]],
            ["Tổng vốn chủ sở hữu", "VON_CHU_SO_HUU"]),
    "4.2": (["Tỷ suất sinh lời tổng tài sản (ROA)", "ROA"], [["Lợi nhuận sau thuế", "Lợi nhuận trước thuế", "LOI_NHUAN_TRUOC_THUE"]],
            ["Tổng tài sản", "TONG_TAI_SAN"]),
    "4.3": (["Tỷ lệ thu nhập lãi cận biên (NIM)", "NIM"], [["Thu nhập lãi thuần (NII)"]], ["Tổng tài sản"]),
    "4.4": (["Số ngày lãi phải thu"], [], []),
    "5.1": (["Tỷ lệ tài sản thanh khoản cao bình quân / tổng tài sản bình quân"],
            [["?Tiền mặt, chứng từ có giá trị ngoại tệ, kim loại quý"], ["?Tiền gửi tại Ngân hàng Nhà nước"],
             ["?Tiền gửi và cho vay các TCTD khác (tài sản)"]], ["Tổng tài sản"]),
    "5.2": (["Tỷ lệ nguồn vốn ngắn hạn được sử dụng để cho vay trung và dài hạn"], [], []),
    "5.3": (["Tỷ lệ dư nợ cho vay so với tổng tiền gửi (LDR)", "LDR"], [["Tổng dư nợ cho vay khách hàng (gộp)", "DU_NO_CHO_VAY"]],
            ["Tổng tiền gửi của khách hàng và Phát hành giấy tờ có giá", "Tổng tiền gửi", "TONG_TIEN_GUI"]),
    "5.4": (["Tỷ lệ tiền gửi không kỳ hạn (CASA)", "CASA"], [], []),
    "6.1": (["Tỷ lệ trạng thái ngoại tệ trên vốn tự có"], [], []),
    "6.2": (["Tỷ lệ chênh lệch tài sản - nợ nhạy cảm lãi suất / vốn chủ sở hữu"],
            [["Tổng giá trị tài sản nhạy cảm với lãi suất", "TAI_SAN_NHAY_CAM_LAI_SUAT"], ["Nợ phải trả nhạy cảm với lãi suất", "NO_NHAY_CAM_LAI_SUAT"]],
            ["Tổng vốn chủ sở hữu", "VON_CHU_SO_HUU"]),
}


def resolve_metric(code: str, data: str = "data") -> Column:
    """A criterion's value from what was reported: its own label, an alternative, else its components.

    A zero reported under one label gives way to the next; nothing found is null, not zero.
    """
    key = code[:-2] if code.endswith(".a") else code
    if key not in METRIC_FALLBACK:
        return F.lit(None).cast("double")
    labels, parts, divisors = METRIC_FALLBACK[key]
    get = lambda name: F.try_element_at(data, F.lit(name))
    first = lambda names: F.coalesce(*[F.nullif(get(n), F.lit(0.0)) for n in names[:-1]], get(names[-1])) if names else F.lit(None).cast("double")
    value = first(labels)
    if parts:
        terms = [F.coalesce(get(p[0][1:]), F.lit(0.0)) if p[0].startswith("?") else first(p) for p in parts]
        top = terms[0]
        for t in terms[1:]:
            top = top - t if key == "6.2" else top + t
        top = F.abs(top) if key == "6.2" else (F.when(top > 0, top) if all(p[0].startswith("?") for p in parts) else top)
        bottom = first(divisors)
        value = F.coalesce(value, half_up(top / F.when(bottom > 0, bottom) * 100, 4))
    return value


# ------------------------------------------------------------------ bands
def higher_is_better(n1, n2, n3, n4):
    """Bands 5..1 of a metric where more is safer: closed below, open above."""
    return [(5, n1, True, None, False), (4, n2, True, n1, False), (3, n3, True, n2, False), (2, n4, True, n3, False), (1, None, False, n4, False)]


def lower_is_better(n1, n2, n3, n4):
    """Bands 5..1 of a metric where less is safer: open below, closed above."""
    return [(5, None, False, n1, True), (4, n1, False, n2, True), (3, n2, False, n3, True), (2, n3, False, n4, True), (1, n4, False, None, False)]


qualitative_bands = lower_is_better


def band_table(spark, criteria: list[Criterion]) -> DataFrame:
    """``(code, type, pos, score, low, low_in, high, high_in)``."""
    num = lambda x: None if x is None else float(x)
    rows = [(c.code, t, i, float(b[0]), num(b[1]), b[2], num(b[3]), b[4]) for c in criteria for t, (_, bands) in c.by_type.items()
            for i, b in enumerate(bands or [])]
    return literal_table(spark, "code string, type string, pos int, score double, low double, low_in boolean, high double, high_in boolean", rows)


def weight_table(spark, criteria: list[Criterion]) -> DataFrame:
    """``(code, type, type_pos, weight)`` in configured order."""
    rows = [(c.code, t, i, float(w)) for c in criteria for i, (t, (w, _)) in enumerate(c.by_type.items())]
    return literal_table(spark, "code string, type string, type_pos int, weight double", rows)


def alias_types(spark, types) -> DataFrame:
    """``(type_code, type)``: a type code with every configured type that covers it."""
    rows = sorted({(t, t) for t in types} | {(a, b) for group in TYPE_ALIASES for a in group for b in group})
    return literal_table(spark, "type_code string, type string", rows)


def in_band(v: Column) -> Column:
    low = F.col("low").isNull() | F.when(F.col("low_in"), v >= F.col("low")).otherwise(v > F.col("low"))
    high = F.col("high").isNull() | F.when(F.col("high_in"), v <= F.col("high")).otherwise(v < F.col("high"))
    return low & high


def _trim_number(c: Column) -> Column:
    whole = F.floor(c).cast("double") == c
    return F.when(whole, F.floor(c).cast("string")).otherwise(c.cast("string"))


def band_text(v: Column, score: Column) -> Column:
    """Why a value earned its score."""
    thousandths = F.floor(F.abs(v) * 1000 + 0.5)
    shown = F.when(F.floor(v).cast("double") == v, F.floor(v).cast("string")).otherwise(F.concat(
        F.when(v < 0, "-").otherwise(""), F.floor(thousandths / 1000).cast("string"), F.lit(","), F.lpad((thousandths % 1000).cast("string"), 3, "0")))
    low, high, s = _trim_number(F.col("low")), _trim_number(F.col("high")), F.floor(score).cast("string")
    up, down = F.when(F.col("low_in"), ">=").otherwise(">"), F.when(F.col("high_in"), "<=").otherwise("<")
    both = F.col("low").isNotNull() & F.col("high").isNotNull()
    span = (F.when(both, F.concat(F.lit(" "), up, F.lit(" "), low, F.lit(" and "), down, F.lit(" "), high))
            .when(F.col("high").isNotNull(), F.concat(F.lit(" "), down, F.lit(" "), high))
            .when(F.col("low").isNotNull(), F.concat(F.lit(" "), up, F.lit(" "), low)).otherwise(""))
    return F.concat(F.lit("value "), shown, span, F.lit(": "), s, F.lit(" points"))


# ------------------------------------------------------------------ scoring
def applicable_criteria(inputs: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """One row per input and criterion that applies: value, where it came from, missing variables,
    and how many variants of the same root apply. ``_direct`` carries directly given qualitative scores."""
    numbered = list(enumerate(criteria))
    quant = [(i, c) for i, c in numbered if c.formula]
    names = {i: sorted({*_variables(c.formula), *[n for n, _ in c.variables]}) for i, c in quant}
    # one projection per step: each value is computed once and referenced by name afterwards
    df = inputs.select(*KEY, "type_code", "data", F.map_filter("data", lambda k, v: k.endswith("_DT")).alias("_direct"), *[applies(c.condition).alias(f"_a{i}") for i, c in numbered],
                       *[resolve_metric(c.code).alias(f"_fb{i}") for i, c in quant])
    df = df.select(*[c for c in df.columns if c != "data"], *[F.coalesce(F.try_element_at("data", F.lit(n)), F.col(f"_fb{i}")).alias(f"_v{i}_{j}")
                                                              for i, _ in quant for j, n in enumerate(names[i])])
    df = df.select("*", *[compile_formula(c.formula, lambda n, i=i: F.col(f"_v{i}_{names[i].index(n)}")).alias(f"_d{i}") for i, c in quant])
    df = df.selectExpr("*", *[f"coalesce(_d{i}, _fb{i}) as _x{i}" for i, _ in quant])
    df = df.select("*", *[half_up(f"_x{i}", 4).alias(f"_r{i}") for i, _ in quant])
    cells = []
    for i, c in numbered:
        value, source, missing = "cast(null as double)", "'qualitative'", "cast(array() as array<string>)"
        if c.formula:
            value, source = f"_r{i}", f"case when _d{i} is not null then 'formula' when _fb{i} is not null then 'fallback' else 'none' end"
            required = [f"if(_v{i}_{names[i].index(n)} is null, '{n}', null)" for n, needed in c.variables if needed]
            missing = f"array_compact(array({', '.join(required)}))" if required else missing
        variants = " + ".join(f"int(_a{j})" for j, other in numbered if other.root == c.root)
        cells.append(f"if(_a{i}, struct('{c.code}' as code, '{c.root}' as root, '{c.group}' as `group`, {str(c.formula is None).lower()} as qualitative, "
                     f"{value} as value, {source} as value_source, {missing} as missing, {variants} as n_variants), null)")
    return df.selectExpr(*KEY, "type_code", "_direct", f"explode(array_compact(array({', '.join(cells)}))) as _c").select(*KEY, "type_code", "_direct", "_c.*")


def _variables(node: dict) -> set[str]:
    if "ma_bien" in node:
        return {node["ma_bien"]}
    return set().union(*[_variables(p) for p in node.get("tham_so", [])], set())


def with_configuration(rows: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """Adds the first configured type covering the object's type and its weight; null if there is none."""
    spark = rows.sparkSession
    types = {t for c in criteria for t in c.by_type}
    pairs = alias_types(spark, types).join(weight_table(spark, criteria), "type")
    wild = weight_table(spark, criteria).where(F.col("type").isin(WILDCARDS)).select(F.lit("*").alias("type_code"), "type", "code", "type_pos", "weight")
    cover = pairs.select("type_code", "type", "code", "type_pos", "weight").unionByName(wild).distinct()
    # configuration is small: the candidates of one criterion travel as one array
    options = cover.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("type_pos", "type_code", "type", "weight"))).alias("_o"))
    fits = F.filter("_o", lambda o: (o["type_code"] == F.col("type_code")) | (o["type_code"] == "*"))
    return rows.join(F.broadcast(options), "code", "left").withColumn("_f", F.try_element_at(fits, F.lit(1))).select(
        *rows.columns, F.col("_f.type").alias("config_type"), F.col("_f.weight").alias("weight"))


def qualitative_scores(violations: DataFrame) -> DataFrame:
    """Per object, period and group: the worst fine band of valid violations, less 0.1 for each
    repetition (at most 0.9), never below 1."""
    source = F.coalesce("found_by_authority", F.lit(True)) | F.coalesce("self_reported", F.lit(False))
    when = F.coalesce("found_in_year", F.lit(True)) | (F.coalesce("found_earlier", F.lit(False)) & ~F.coalesce("remediated", F.lit(False)))
    fine = F.col("fine_mn")
    base = F.when(fine <= 0, 4).when(fine <= 100, 4).when(fine <= 200, 3).when(fine <= 300, 2).when(fine > 300, 1).otherwise(4)
    per = violations.where(source & when).groupBy(*KEY, F.col("group_code").alias("group")).agg(
        F.count(F.lit(1)).alias("n_violations"), F.sum(F.greatest("n_times", F.lit(1))).alias("n_times"),
        F.sum(F.greatest(F.col("n_times") - 1, F.lit(0))).alias("n_repeats"), F.min(base).alias("_base"))
    # tenths of a point are integers, so the result is exact
    tenths = F.greatest(F.col("_base") * 10 - F.least("n_repeats", F.lit(9)), F.lit(10))
    return per.select(*KEY, "group", "n_violations", "n_times", "n_repeats", F.col("_base").cast("double").alias("base_score"),
                      (F.least("n_repeats", F.lit(9)) / 10.0).alias("deduction"), (tenths / 10.0).alias("qualitative_score"))


def score_criteria(inputs: DataFrame, criteria: list[Criterion], violations: DataFrame | None = None) -> DataFrame:
    """Every applicable criterion with its band, score, converted score and status.

    Status: SCORED, NOT_APPLICABLE (no configuration for the type), VARIANT_CONFLICT, MISSING_INPUT,
    NO_BAND, OVERLAPPING_BANDS.
    """
    spark = inputs.sparkSession
    rows = with_configuration(applicable_criteria(inputs, criteria), criteria)
    bands = band_table(spark, criteria).groupBy("code", F.col("type").alias("config_type")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "score", "low", "low_in", "high", "high_in"))).alias("_bands"))
    rows = rows.join(F.broadcast(bands), ["code", "config_type"], "left")
    inside = lambda b: ((b["low"].isNull() | F.when(b["low_in"], F.col("value") >= b["low"]).otherwise(F.col("value") > b["low"]))
                        & (b["high"].isNull() | F.when(b["high_in"], F.col("value") <= b["high"]).otherwise(F.col("value") < b["high"])))
    rows = rows.withColumn("_hit", F.coalesce(F.filter("_bands", inside), F.array()))
    if violations is not None:
        q = qualitative_scores(violations).select(*KEY, "group", F.col("qualitative_score").alias("_q"))
        rows = rows.join(q, [*KEY, "group"], "left")
    else:
        rows = rows.withColumn("_q", F.lit(None).cast("double"))
    qualitative = F.coalesce("_q", F.try_element_at("_direct", F.concat("group", F.lit("_DT"))), F.lit(5.0))
    n = F.size("_hit")
    status = (F.when(F.col("n_variants") > 1, "VARIANT_CONFLICT").when(F.col("weight").isNull(), "NOT_APPLICABLE")
              .when(F.col("qualitative"), "SCORED").when((F.size("missing") > 0) | F.col("value").isNull(), "MISSING_INPUT").when(n == 0, "NO_BAND")
              .when(n > 1, "OVERLAPPING_BANDS").otherwise("SCORED"))
    rows = rows.withColumn("status", status).withColumn("_b", F.try_element_at("_hit", F.lit(1)))
    ok = F.col("status") == "SCORED"
    rows = rows.withColumn("band_score", F.when(ok, F.when(F.col("qualitative"), qualitative).otherwise(F.col("_b.score"))))
    b = rows.select("*", "_b.low", "_b.low_in", "_b.high", "_b.high_in")
    return b.select(*KEY, "type_code", "group", "root", "code", "qualitative", "value", "value_source", "missing", "config_type", "weight", "status", "band_score",
                    half_up(F.col("band_score") * F.col("weight") / 100, 4).alias("converted_score"),
                    F.when(ok & ~F.col("qualitative"), band_text(F.col("value"), F.col("band_score"))).alias("explanation"))


def group_weights(spark, weights) -> DataFrame:
    """``[(group, criterion_weight, quantitative_weight)]``."""
    return literal_table(spark, "group string, w double, wq double", [(g, float(w), float(q)) for g, w, q in weights])


def group_scores(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Quantitative and qualitative parts of each group, weighted."""
    ok = scored.where("status = 'SCORED'")
    quant, qual = F.sum(F.when(~F.col("qualitative"), F.col("converted_score"))), F.sum(F.when(F.col("qualitative"), F.col("converted_score")))
    g = ok.groupBy(*KEY, "group").agg(half_up(quant, 4).alias("quantitative"), half_up(qual, 4).alias("qualitative"))
    z = F.lit(0.0)
    value = F.coalesce("quantitative", z) * (F.col("wq") / 100) + F.coalesce("qualitative", z) * (F.greatest(F.col("w") - F.col("wq"), z) / 100)
    return g.join(F.broadcast(weights), "group").select(*KEY, "group", "quantitative", "qualitative", half_up(value, 4).alias("group_score"))


def grade(score: Column, ladder=None) -> Column:
    out = None
    for minimum, name in ladder or LADDER:
        if minimum is None:
            return out.otherwise(name)
        out = F.when(score >= minimum, name) if out is None else out.when(score >= minimum, name)
    return out


def totals(groups: DataFrame, ladder=None) -> DataFrame:
    """Sum of the group scores and its grade; group scores are summed as exact ten-thousandths."""
    t = groups.groupBy(*KEY).agg((F.sum(F.floor(F.col("group_score") * 10000 + 0.5)) / 10000.0).alias("_t"))
    return t.select(*KEY, half_up("_t", 2).alias("total_score"), grade(F.col("_t"), ladder).alias("grade"))


def missing_variables(inputs: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """Required variables absent from an input, for criteria that apply and are configured."""
    rows = with_configuration(applicable_criteria(inputs, criteria), criteria)
    return rows.where("n_variants = 1 and weight is not null").select(*KEY, "code", F.explode("missing").alias("variable"))


def batch_summary(scored: DataFrame) -> DataFrame:
    """Per input: rated or failed with its first error; failures never stop the batch."""
    bad = F.col("status").isin("VARIANT_CONFLICT", "MISSING_INPUT", "NO_BAND", "OVERLAPPING_BANDS")
    return scored.groupBy(*KEY).agg(F.min_by("status", F.when(bad, F.col("code"))).alias("error"), F.count_if(bad).alias("n_errors")).select(
        *KEY, (F.col("n_errors") == 0).alias("ok"), F.when(F.col("n_errors") > 0, F.col("error")).alias("error"), "n_errors")


# ------------------------------------------------------------------ CAR history and downgrade
# Keys that may hold the capital ratio, first present wins.
CAR_KEYS = ["Tỷ lệ an toàn vốn tối thiểu (CAR) (riêng lẻ)", "Tỷ lệ an toàn vốn tối thiểu (CAR)", "Tỷ lệ an toàn vốn",
            "R-101", "R-105", "R-102", "1.1", "1.1.a", "CAR"]


def month_of(period: Column) -> Column:
    """First day of a month period spelt ``T03/2024``, ``T3/2024``, ``03/2024`` or ``2024-03``."""
    iso = F.regexp_extract(period, r"^(\d{4})-(\d{1,2})$", 1)
    slash = r"(?i)^T?(\d{1,2})/(\d{4})$"
    year = F.when(iso != "", iso).otherwise(F.regexp_extract(period, slash, 2))
    month = F.when(iso != "", F.regexp_extract(period, r"^(\d{4})-(\d{1,2})$", 2)).otherwise(F.regexp_extract(period, slash, 1))
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lit("01")), "yyyy-MM-dd")


def car_window(inputs: DataFrame, months: int = 12) -> DataFrame:
    """Over the months ending at each period: reported values, mean, extremes, all below 8, and the
    longest run below 4 among the reported values in order.

    A frame over the month number holds at most ``months`` rows; absent months just are not there.
    """
    car = half_up(F.coalesce(*[F.try_element_at("data", F.lit(k)) for k in CAR_KEYS]), 3)
    rows = inputs.select(*KEY, month_of(F.col("period")).alias("month"), car.alias("car")).where("month is not null")
    rows = rows.withColumn("_m", (F.year("month") * 12 + F.month("month")).cast("int"))
    w = Window.partitionBy("object_id").orderBy("_m").rangeBetween(-(months - 1), 0)
    seen = F.array_sort(F.collect_list(F.when(F.col("car").isNotNull(), F.struct("_m", "car"))).over(w))
    df = rows.select(*KEY, "month", F.transform(seen, lambda s: s["car"]).alias("cars"))
    run = F.aggregate("cars", F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best")),
                      lambda a, c: F.struct(F.when(c < 4.0, a["cur"] + 1).otherwise(0).alias("cur"),
                                            F.greatest(a["best"], F.when(c < 4.0, a["cur"] + 1).otherwise(0)).alias("best")))["best"]
    thousandths = F.aggregate(F.transform("cars", lambda c: F.floor(c * 1000 + 0.5)), F.lit(0).cast("bigint"), lambda a, c: a + c)
    n = F.size("cars")
    return df.select(*KEY, "month", n.alias("n_months"), F.when(n > 0, half_up(thousandths / 1000.0 / n, 3)).alias("car_mean"),
                     F.array_min("cars").alias("car_min"), F.array_max("cars").alias("car_max"),
                     ((n >= 12) & F.forall("cars", lambda c: c < 8.0)).alias("below_8_all"), run.alias("longest_below_4"))


def forced_downgrade(rated: DataFrame, losses: DataFrame, car: DataFrame, liquidity: DataFrame | None = None) -> DataFrame:
    """Grade E when accumulated losses exceed half of capital and reserves, or CAR stayed below 8 in all
    of 12 months or below 4 in 6 running months. A weak liquidity item is only reported.

    ``losses`` is ``(object_id, period, retained, capital)``; ``liquidity`` the scored criteria of the group.
    """
    ratio = F.when(F.col("capital") != 0, F.when(F.col("retained") >= 0, 0.0).otherwise(half_up(F.abs("retained") / F.nullif("capital", F.lit(0.0)) * 100, 2)))
    df = rated.join(losses, KEY, "left").join(car.select(*KEY, "below_8_all", "longest_below_4"), KEY, "left").withColumn("loss_ratio", ratio)
    if liquidity is not None:
        weak = liquidity.where("group = 'L' and not qualitative").groupBy(*KEY).agg(F.bool_or(F.col("band_score") < 2).alias("_weak"))
        df = df.join(weak, KEY, "left")
    else:
        df = df.withColumn("_weak", F.lit(False))
    no = F.lit(False)
    b, c1, c2 = F.coalesce(F.col("loss_ratio") > 50, no), F.coalesce("below_8_all", no), F.coalesce(F.col("longest_below_4") >= 6, no)
    forced = b | c1 | c2
    reasons = F.concat_ws("; ", F.when(b, "losses above 50% of capital"), F.when(c1, "CAR below 8% in 12 months"), F.when(c2, "CAR below 4% in 6 running months"))
    return df.select(*KEY, "total_score", F.col("grade").alias("original_grade"), "loss_ratio", F.coalesce("_weak", no).alias("liquidity_advisory"),
                     b.alias("loss_breach"), (c1 | c2).alias("car_breach"), forced.alias("forced_e"), reasons.alias("reasons"),
                     F.when(forced, "E").otherwise(F.col("grade")).alias("final_grade"))


# ------------------------------------------------------------------ reporting template
def template_wide(rows: DataFrame, codes: list[str]) -> DataFrame:
    """Template lines ``(object_id, period, code, value)`` as one row per object; columns ``r101``…"""
    return rows.where(F.col("code").isin(codes)).groupBy(*KEY).agg(
        *[F.expr(f"max(case when code = '{c}' then value end) as {c.replace('R-', 'r')}") for c in codes])


# The template's items
# item, group, reported lines, numerator lines (signed), divisor lines, direction, n1..n4, weight.
TEMPLATE_ITEMS = [
    ("1.1", "C", ["R-105", "R-102"], ["R-106"], ["R-107"], "higher", 15.0, 12.0, 8.0, 5.0, 7.5),
    ("1.2", "C", ["R-112", "R-109"], ["R-113"], ["R-114"], "higher", 12.0, 10.0, 7.0, 4.0, 7.5),
    ("2.1", "A", ["R-116"], ["R-117", "R-118", "R-119"], ["R-120", "R-119"], "lower", 1.0, 1.5, 3.0, 5.0, 11.25),
    ("2.2", "A", ["R-121"], ["R-122"], ["R-123"], "lower", 1.0, 2.0, 3.0, 5.0, 3.75),
    ("2.3", "A", ["R-124"], ["R-125"], ["R-126"], "lower", 10.0, 15.0, 20.0, 25.0, 5.0),
    ("2.4", "A", ["R-127"], ["R-128", "R-129"], ["R-130", "R-131"], "lower", 1.0, 2.0, 3.0, 5.0, 2.5),
    ("2.5", "A", ["R-135"], ["R-136"], ["R-137"], "lower", 3.0, 5.0, 10.0, 15.0, 1.25),
    ("2.6", "A", ["R-138"], ["R-139"], ["R-140"], "lower", 3.0, 7.0, 11.0, 15.0, 1.25),
    ("3.1", "M", ["R-142"], ["R-143"], ["R-144"], "lower", 35.0, 45.0, 50.0, 60.0, 3.0),
    ("4.1", "E", ["R-153"], ["R-154"], ["R-155"], "higher", 15.0, 13.0, 10.0, 8.0, 5.625),
    ("4.2", "E", ["R-156"], ["R-157"], ["R-158"], "higher", 1.5, 1.1, 0.8, 0.6, 5.625),
    ("4.3", "E", ["R-159"], ["R-160"], ["R-161"], "higher", 3.0, 2.5, 2.0, 1.5, 3.75),
    ("5.1", "L", ["R-171"], ["R-172"], ["R-173"], "higher", 20.0, 15.0, 9.0, 5.0, 2.5),
    ("5.2", "L", ["R-174"], ["R-175", "-R-176"], ["R-177"], "lower", 25.0, 30.0, 35.0, 40.0, 2.5),
    ("5.3", "L", ["R-178"], ["R-179"], ["R-180"], "lower", 70.0, 80.0, 90.0, 95.0, 3.0),
    ("5.4", "L", ["R-181"], ["R-182"], ["R-183"], "lower", 5.0, 10.0, 13.0, 18.0, 2.0),
    ("6.1", "S", ["R-185"], [], [], "lower_abs", 10.0, 15.0, 20.0, 25.0, 1.0),
    ("6.2", "S", ["R-186"], ["R-187", "-R-188"], ["R-189"], "lower_abs", 50.0, 65.0, 80.0, 95.0, 1.0),
]
TEMPLATE_QUALITATIVE = {"C": 5.0, "A": 5.0, "M": 7.0, "E": 5.0, "L": 5.0, "S": 3.0}
TEMPLATE_GROUP_LINES = {"C": "R-100", "A": "R-115", "M": "R-141", "E": "R-152", "L": "R-170", "S": "R-184"}


def template_codes() -> list[str]:
    return sorted({c.lstrip("-") for i in TEMPLATE_ITEMS for c in [*i[2], *i[3], *i[4]]})


def _line(code: str) -> str:
    return code.lstrip("-").replace("R-", "r")


def template_formula(numerator: list[str], divisor: list[str], factor: float = 100.0, minus: bool = False) -> str:
    """Template-line arithmetic as SQL text: missing lines count 0; a zero divisor gives 0."""
    z = lambda c: f"coalesce({_line(c)}, 0D)"
    top = f"({z(numerator[0])} - {z(numerator[1])})" if minus and len(numerator) >= 2 else "(" + " + ".join(z(c) for c in numerator) + ")"
    if not divisor:
        return f"{top} * {float(factor)}D"
    bottom = "(" + " + ".join(z(c) for c in divisor) + ")"
    return f"coalesce({top} / nullif({bottom}, 0D) * {float(factor)}D, 0D)"


def template_items(wide: DataFrame) -> DataFrame:
    """Value and 1..5 score of each item. A reported line wins over its components; an item with
    neither is not evaluated (no constant stands in for missing data)."""
    cells = []
    for item, group, reported, num, den, direction, n1, n2, n3, n4, weight in TEMPLATE_ITEMS:
        v = [_line(c) for c in reported]
        if num:
            top = " + ".join((f"-coalesce({_line(c)}, 0D)" if c.startswith("-") else f"coalesce({_line(c)}, 0D)") for c in num)
            bottom = "(" + " + ".join(f"coalesce({_line(c)}, 0D)" for c in den) + ")"
            v.append(f"(case when {bottom} > 0 then ({top}) / nullif({bottom}, 0D) * 100D end)")
        value = f"coalesce({', '.join(v)})"
        x = f"abs({value})" if direction == "lower_abs" else value
        op = ">=" if direction == "higher" else "<="
        score = f"case when {x} {op} {n1}D then 5 when {x} {op} {n2}D then 4 when {x} {op} {n3}D then 3 when {x} {op} {n4}D then 2 when {x} is not null then 1 end"
        cells.append(f"struct('{item}' as item, '{group}' as `group`, '{reported[0]}' as line, {value} as value, {score} as score, {weight}D as weight)")
    return wide.selectExpr(*KEY, f"explode(array({', '.join(cells)})) as i").select(*KEY, "i.*").select(
        *KEY, "item", "group", "line", half_up("value", 3).alias("value"), "score", "weight",
        half_up(F.col("score") * F.col("weight") / 100, 3).alias("converted_score"))


def template_rating(items: DataFrame, qualitative: DataFrame | None = None) -> DataFrame:
    """Group scores, total, grade and forced E of the template path: quantitative 70 %, qualitative 30 %.

    ``qualitative`` is ``(object_id, period, group, qualitative_score)``; a group without a row scores 5.
    """
    c = F.col
    part = lambda g: F.coalesce(F.sum(F.when(c("group") == g, F.floor(c("converted_score") * 1000 + 0.5))), F.lit(0))
    quant = items.groupBy(*KEY).agg(
        *[part(g).alias(f"_{g}") for g in TEMPLATE_QUALITATIVE], F.sum(c("score") * c("weight") / 100).alias("_q"),
        F.bool_or((c("group") == "L") & (c("score") < 2)).alias("_weak"), F.max(F.when(c("item") == "1.1", c("value"))).alias("_car"),
        F.count_if(c("score").isNull()).alias("n_not_evaluated"))
    if qualitative is not None:
        q = qualitative.groupBy(*KEY).agg(*[F.max(F.when(c("group") == g, c("qualitative_score"))).alias(f"q_{g}") for g in TEMPLATE_QUALITATIVE])
        quant = quant.join(q, KEY, "left")
    else:
        quant = quant.select("*", *[F.lit(None).cast("double").alias(f"q_{g}") for g in TEMPLATE_QUALITATIVE])
    quant = quant.select(*[x for x in quant.columns if not x.startswith("q_")], *[F.coalesce(f"q_{g}", F.lit(5.0)).alias(f"q_{g}") for g in TEMPLATE_QUALITATIVE])
    # thousandths keep the sums exact
    thousandths = {g: c(f"_{g}") + F.floor(c(f"q_{g}") * w * 10 + 0.5) for g, w in TEMPLATE_QUALITATIVE.items()}
    total = half_up(sum(thousandths.values(), F.lit(0).cast("bigint")) / 1000.0, 2)
    weak = F.coalesce("_weak", F.lit(False)) | (c("q_L") < 2)
    low_car = F.coalesce(c("_car") < 8.0, F.lit(False))
    soft = sum((c(f"q_{g}") * (w / 100) for g, w in TEMPLATE_QUALITATIVE.items()), F.lit(0.0))
    df = quant.select(*KEY, *[half_up(t / 1000.0, 2).alias(f"group_{g}") for g, t in thousandths.items()], half_up("_q", 2).alias("quantitative_total"),
                      half_up(soft, 2).alias("qualitative_total"), total.alias("total_score"), (weak | low_car).alias("forced_e"), "n_not_evaluated")
    g = grade(c("total_score"), TEMPLATE_LADDER)
    return df.select("*", g.alias("original_grade"), F.when(c("forced_e"), "E").otherwise(g).alias("final_grade"))


def scores_on_lines(rows: DataFrame, items: DataFrame, rating: DataFrame) -> DataFrame:
    """Template lines with the item or group score that belongs to them."""
    by_item = items.select(*KEY, F.col("line").alias("code"), F.col("score").cast("double").alias("score"), "converted_score", F.lit("CHI_TIEU").alias("score_kind"))
    groups = ", ".join(f"struct('{line}' as code, group_{g} as s)" for g, line in TEMPLATE_GROUP_LINES.items())
    by_group = rating.selectExpr(*KEY, f"explode(array({groups})) as g").select(
        *KEY, "g.code", F.lit(None).cast("double").alias("score"), F.col("g.s").alias("converted_score"), F.lit("NHOM").alias("score_kind"))
    return rows.join(by_item.unionByName(by_group), [*KEY, "code"], "left")


# ------------------------------------------------------------------ configuration checks
SUPPORTED_OPS = ["CONG", "TRU", "NHAN", "CHIA", "MIN", "MAX", "TRUNG_BINH", "LUY_THUA", "GIA_TRI_TUYET_DOI"]


def _nodes(node, path="0"):
    if not isinstance(node, dict) or not node:
        yield path, "EMPTY", None, 0
    elif "gia_tri" in node:
        yield path, "CONSTANT", None if node["gia_tri"] is None else str(node["gia_tri"]), 0
    elif "ma_bien" in node:
        yield path, "VARIABLE", node["ma_bien"], 0
    elif "phep_toan" in node:
        args = node.get("tham_so", [])
        yield path, "OPERATION", node["phep_toan"], len(args)
        for i, a in enumerate(args):
            yield from _nodes(a, f"{path}.{i}")
    else:
        yield path, "UNKNOWN", json.dumps(node), 0


def formula_errors(spark, criteria: list[Criterion]) -> DataFrame:
    """Formula trees as node rows, checked: undeclared variables, unknown operations, arity, null constants."""
    nodes = [(c.code, *n) for c in criteria if c.formula is not None for n in _nodes(c.formula)]
    df = literal_table(spark, "code string, path string, kind string, name string, n_args int", nodes)
    declared = literal_table(spark, "code string, name string, declared boolean", [(c.code, v[0], True) for c in criteria for v in c.variables])
    df = df.join(declared, ["code", "name"], "left")
    op = F.col("kind") == "OPERATION"
    error = (F.when(F.col("kind").isin("EMPTY", "UNKNOWN"), "INVALID_NODE").when((F.col("kind") == "CONSTANT") & F.col("name").isNull(), "NULL_CONSTANT")
             .when((F.col("kind") == "VARIABLE") & F.col("declared").isNull(), "UNDECLARED_VARIABLE").when(op & ~F.col("name").isin(SUPPORTED_OPS), "UNKNOWN_OPERATION")
             .when(op & (F.col("name") == "CHIA") & (F.col("n_args") != 2), "WRONG_ARITY").when(op & F.col("name").isin("CONG", "NHAN") & (F.col("n_args") < 2), "WRONG_ARITY"))
    return df.select("code", "path", "name", error.alias("error")).where("error is not null")


def band_errors(bands: DataFrame, max_score: float = 5.0) -> DataFrame:
    """Bands scoring above the maximum, and bands repeated in full."""
    high = bands.where(F.col("score") > max_score).select("code", "type", "pos", F.lit("SCORE_TOO_HIGH").alias("error"))
    same = bands.groupBy("code", "type", "score", "low", "low_in", "high", "high_in").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).where("n > 1")
    return high.unionByName(same.select("code", "type", "pos", F.lit("IDENTICAL_BANDS").alias("error")))


def weight_errors(weights: DataFrame, groups: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Groups whose criterion weights for a type do not sum to 100."""
    return (weights.join(groups, "code").groupBy("group", "type").agg(F.sum("weight").alias("total_weight"))
            .where(F.abs(F.col("total_weight") - 100) > tolerance))


# ------------------------------------------------------------------ ranking and history
def rank_objects(scores: DataFrame, by: str, period: str | None = None) -> DataFrame:
    """Rank and rank text ``i/n`` by a score column within each period; equal scores share a rank.

    Positions come from range partitions; no period is sorted in one task and nothing meets on a score.
    """
    df = scores if period is None else scores.where(F.col("period") == period)
    pos = Positions(df.withColumn("_s", half_up(F.coalesce(F.col(by), F.lit(0.0)), 2)), ["period"], "_s", ["object_id"])
    rank = F.col("n_total") - F.col("n_below") - F.col("n_eq") + 1
    return pos.rows.select(*scores.columns, rank.alias("rank"), F.concat(rank.cast("string"), F.lit("/"), F.col("n_total").cast("string")).alias("rank_text"))


def grade_counts(rated: DataFrame, col: str = "grade") -> DataFrame:
    return rated.groupBy("period", col).agg(F.count(F.lit(1)).alias("n"))


def score_history(rated: DataFrame, order: str = "period") -> DataFrame:
    """Score per object over time with its change."""
    w = Window.partitionBy("object_id").orderBy(order)
    return rated.select("*", F.lag("total_score").over(w).alias("previous"),
                        half_up(F.col("total_score") - F.lag("total_score").over(w), 2).alias("change"))
