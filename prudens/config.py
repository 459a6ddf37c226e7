"""Default parameters. Everything here is data, passed to the operators as arguments;
a caller replaces any table with their own (see ``prudens.sources.settings``)."""

ID_COLS = ["bank_id", "bank_name", "period", "period_ts"]
FREQUENCIES = ["combined", "monthly", "quarterly", "yearly", "daily"]

# --- Fixed values: regulatory limits. One row per flat rule:
# id, name, legal source, article, domain, metric, operator, lo, hi, severity, status.
FLAT_RULE_FIELDS = ["rule_id", "rule_name", "legal_source", "article_reference", "risk_domain",
                    "metric", "operator", "lo", "hi", "severity", "status"]
FLAT_RULES = [
    ("CAR_CONSOLIDATED_MIN", "Tỷ lệ an toàn vốn tối thiểu (hợp nhất)", "Thông tư 41/2016/TT-NHNN", "Điều 6",
     "capital", "car_consolidated", "<", 8.0, None, "CRITICAL", "ACTIVE"),
    ("TIER1_MIN", "Tỷ lệ an toàn vốn cấp 1", "Thông tư 41/2016/TT-NHNN", "Điều 6",
     "capital", "car_tier1", "<", 6.0, None, "CRITICAL", "REVIEW_REQUIRED"),
    ("CAPITAL_CONTRIBUTION_LIMIT", "Giới hạn góp vốn, mua cổ phần", "Luật các TCTD", "40% VĐL và quỹ",
     "capital", "capital_contribution_ratio", ">", 40.0, None, "CRITICAL", "REVIEW_REQUIRED"),
    ("EQUITY_TO_ASSETS_LOW", "Đòn bẩy cao", "CAMELS (C)", None,
     "capital", "equity_to_assets", "<", 5.0, None, "MEDIUM", "ACTIVE"),
    ("NPL_RATIO_LIMIT", "Tỷ lệ nợ xấu vượt 3%", "Định hướng điều hành NHNN", None,
     "credit", "npl_ratio", ">", 3.0, None, "HIGH", "ACTIVE"),
    ("NPL_RATIO_CRITICAL", "Tỷ lệ nợ xấu nghiêm trọng", "Cảnh báo giám sát", None,
     "credit", "npl_ratio", ">", 5.0, None, "CRITICAL", "REVIEW_REQUIRED"),
    ("GROUP2_HIGH", "Nợ nhóm 2 cao", "CAMELS (A)", None,
     "credit", "group2_ratio", ">", 3.0, None, "MEDIUM", "ACTIVE"),
    ("LLR_COVERAGE_LOW", "Bao phủ nợ xấu thấp", "CAMELS (A)", None,
     "credit", "llr_coverage", "<", 50.0, None, "MEDIUM", "ACTIVE"),
    ("ROA_LOW", "ROA thấp", "CAMELS (E)", None,
     "profitability", "roa", "<", 0.5, None, "MEDIUM", "ACTIVE"),
    ("CIR_HIGH", "CIR cao", "CAMELS (E)", None,
     "profitability", "cir", ">", 60.0, None, "LOW", "ACTIVE"),
    ("FX_POSITION_LIMIT", "Trạng thái ngoại tệ vượt giới hạn", "Quy định trạng thái ngoại tệ của NHNN", "20% vốn tự có",
     "market", "fx_position_ratio", "outside_range", -20.0, 20.0, "HIGH", "REVIEW_REQUIRED"),
    ("CREDIT_GROWTH_HOT", "Tăng trưởng tín dụng nóng", "Cảnh báo nội bộ", None,
     "credit", "credit_growth_yoy", ">", 30.0, None, "HIGH", "ACTIVE"),
]

# --- Fixed values: tiered limits per institution type, (n1, n2, n3) from mild to breach.
TIERED_RULE_FIELDS = ["rule_id", "rule_name", "legal_source", "article_reference", "risk_domain",
                      "metric", "direction", "severity", "status"]
TIERED_RULES = [
    ("QD682_CAR_SOLO", "Tỷ lệ an toàn vốn riêng lẻ (CAR)", "QĐ 682/QĐ-TTGSNH4", "Phụ lục 1, mục 1",
     "capital", "car_solo", "lower_riskier", "CRITICAL", "ACTIVE"),
    ("QD682_LDR", "Dư nợ cho vay / tổng tiền gửi (LDR)", "QĐ 682/QĐ-TTGSNH4", "Phụ lục 1, mục 2",
     "liquidity", "ldr", "higher_riskier", "CRITICAL", "ACTIVE"),
    ("QD682_ST_FUNDING_MLT", "Vốn ngắn hạn cho vay trung dài hạn", "QĐ 682/QĐ-TTGSNH4", "Phụ lục 1, mục 3",
     "liquidity", "st_funding_for_mlt_loans", "higher_riskier", "CRITICAL", "ACTIVE"),
    ("QD682_LIQUIDITY_RESERVE", "Tỷ lệ dự trữ thanh khoản", "QĐ 682/QĐ-TTGSNH4", "Phụ lục 1, mục 5",
     "liquidity", "liquidity_reserve_ratio", "lower_riskier", "CRITICAL", "ACTIVE"),
    ("QD682_SOLVENCY_30D_VND", "Khả năng chi trả 30 ngày (VND)", "QĐ 682/QĐ-TTGSNH4", "Phụ lục 1, mục 6",
     "liquidity", "solvency_30d_vnd", "lower_riskier", "CRITICAL", "ACTIVE"),
    ("QD682_SOLVENCY_30D_FX", "Khả năng chi trả 30 ngày (ngoại tệ)", "QĐ 682/QĐ-TTGSNH4", "Phụ lục 1, mục 7",
     "liquidity", "solvency_30d_fx", "lower_riskier", "CRITICAL", "ACTIVE"),
    ("QD682_GOVBOND", "Mua, đầu tư trái phiếu Chính phủ", "QĐ 682/QĐ-TTGSNH4", "Phụ lục 1, mục 4",
     "liquidity", "govbond_ratio", "higher_riskier", "CRITICAL", "ACTIVE"),
    ("QD618_TCTCVM_CAR", "CAR của TCTCVM", "QĐ 618/QĐ-TTGSNH3", "Mục 1",
     "capital", "car_solo", "lower_riskier", "CRITICAL", "ACTIVE"),
    ("QD618_TCTCVM_SOLVENCY", "Khả năng chi trả của TCTCVM", "QĐ 618/QĐ-TTGSNH3", "Mục 1",
     "liquidity", "tctcvm_solvency_ratio", "lower_riskier", "CRITICAL", "REVIEW_REQUIRED"),
]
RULE_TIERS = {
    "QD682_CAR_SOLO": {
        "nhtm_nha_nuoc": (9.0, 8.5, 8.0), "nhtm_co_phan": (9.5, 8.5, 8.0), "nh_lien_doanh": (9.5, 8.5, 8.0),
        "nh_100_von_ngoai": (13.0, 11.0, 8.0), "cn_nh_nuoc_ngoai": (11.0, 9.5, 8.0),
        "cong_ty_tai_chinh": (13.0, 11.0, 9.0), "cong_ty_cho_thue_tai_chinh": (14.0, 11.5, 9.0)},
    "QD682_LDR": {
        "nhtm_nha_nuoc": (80.0, 83.0, 85.0), "nhtm_co_phan": (80.0, 83.0, 85.0), "nh_lien_doanh": (77.0, 81.0, 85.0),
        "nh_100_von_ngoai": (81.0, 83.0, 85.0), "cn_nh_nuoc_ngoai": (78.0, 82.0, 85.0)},
    "QD682_ST_FUNDING_MLT": {
        "nhtm_nha_nuoc": (30.0, 32.0, 34.0), "nhtm_co_phan": (31.0, 33.0, 34.0), "nh_lien_doanh": (30.0, 32.0, 34.0),
        "nh_100_von_ngoai": (30.0, 32.0, 34.0), "cn_nh_nuoc_ngoai": (28.0, 31.0, 34.0),
        "cong_ty_tai_chinh": (75.0, 85.0, 90.0), "cong_ty_cho_thue_tai_chinh": (85.0, 87.0, 90.0)},
    "QD682_LIQUIDITY_RESERVE": {
        "nhtm_nha_nuoc": (12.0, 11.0, 10.0), "nhtm_co_phan": (11.5, 10.5, 10.0), "nh_lien_doanh": (13.0, 11.5, 10.0),
        "nh_100_von_ngoai": (14.0, 12.0, 10.0), "cn_nh_nuoc_ngoai": (15.0, 12.0, 10.0),
        "cong_ty_tai_chinh": (3.0, 2.0, 1.0), "cong_ty_cho_thue_tai_chinh": (3.0, 2.0, 1.0)},
    "QD682_SOLVENCY_30D_VND": {
        "nhtm_nha_nuoc": (60.0, 55.0, 50.0), "nhtm_co_phan": (58.0, 52.0, 50.0), "nh_lien_doanh": (60.0, 55.0, 50.0),
        "nh_100_von_ngoai": (60.0, 55.0, 50.0), "cn_nh_nuoc_ngoai": (60.0, 55.0, 50.0),
        "cong_ty_tai_chinh": (23.0, 21.5, 20.0), "cong_ty_cho_thue_tai_chinh": (25.0, 22.0, 20.0)},
    "QD682_SOLVENCY_30D_FX": {
        "nhtm_nha_nuoc": (35.0, 20.0, 10.0), "nhtm_co_phan": (33.0, 17.0, 10.0), "nh_lien_doanh": (30.0, 12.0, 10.0),
        "nh_100_von_ngoai": (30.0, 12.0, 10.0), "cn_nh_nuoc_ngoai": (7.0, 6.0, 5.0),
        "cong_ty_tai_chinh": (8.0, 6.0, 5.0), "cong_ty_cho_thue_tai_chinh": (8.0, 6.0, 5.0)},
    "QD682_GOVBOND": {
        "nhtm_nha_nuoc": (27.0, 29.0, 30.0), "nhtm_co_phan": (26.0, 28.0, 30.0), "nh_lien_doanh": (25.0, 27.0, 30.0),
        "nh_100_von_ngoai": (26.0, 28.0, 30.0), "cn_nh_nuoc_ngoai": (23.0, 25.0, 30.0),
        "cong_ty_tai_chinh": (23.0, 25.0, 30.0)},
    "QD618_TCTCVM_CAR": {
        "tctcvm_tinh_thuong": (21.0, 15.5, 10.0), "tctcvm_lao_dong_ngheo": (23.0, 16.5, 10.0),
        "tctcvm_m7": (17.0, 13.5, 10.0), "tctcvm_thanh_hoa": (15.3, 13.3, 10.0)},
    "QD618_TCTCVM_SOLVENCY": {
        "tctcvm_tinh_thuong": (23.4, 22.1, 20.0), "tctcvm_lao_dong_ngheo": (24.8, 23.1, 20.0),
        "tctcvm_m7": (25.1, 23.2, 20.0), "tctcvm_thanh_hoa": (24.7, 23.7, 20.0)},
}
FAST_CHANGE_PCT = 25.0
SEVERITY_ORDER = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]

# --- Fixed values: ceilings of derived ratios.
RATIO_CEILINGS = {
    "ldr": 200.0, "npl_ratio": 100.0, "short_loan_ratio": 100.0, "mlt_loan_ratio": 100.0,
    "provision_to_loans": 100.0, "unsecured_loan_ratio": 100.0, "risky_sector_ratio": 100.0,
    "large_borrower_ratio": 100.0, "wholesale_funding_share": 100.0, "liquid_assets_to_deposits": 200.0,
}

# --- Fixed values: plausible ranges and amounts that must not be negative.
PLAUSIBLE_RANGES = {
    "car_solo": (0, 60), "car_consolidated": (0, 60), "car_tier1": (0, 60), "ldr": (0, 200),
    "npl_ratio": (0, 100), "group2_ratio": (0, 100), "roa": (-20, 20), "roe": (-100, 100),
    "nim": (-10, 20), "cir": (0, 300), "liquidity_reserve_ratio": (0, 100),
    "st_funding_for_mlt_loans": (0, 100), "solvency_30d_vnd": (0, 500), "solvency_30d_fx": (0, 5000),
    "equity_to_assets": (0, 60),
}
NON_NEGATIVE = ["total_assets", "equity", "customer_loans", "deposits", "npl_amount", "provisions",
                "charter_capital", "rwa", "hqla"]

# --- Fixed values: metrics by sign of deterioration (+1: higher is worse).
STRESS_INDEX_METRICS = {
    "npl_ratio": 1, "group2_ratio": 1, "ldr": 1, "st_funding_for_mlt_loans": 1, "car_solo": -1,
    "car_consolidated": -1, "liquidity_reserve_ratio": -1, "avg_liquid_asset_ratio": -1, "roa": -1,
    "solvency_30d_vnd": -1, "solvency_30d_fx": -1,
}
WATCH_METRICS = {
    "npl_ratio": 1, "group2_ratio": 1, "ldr": 1, "st_funding_for_mlt_loans": 1, "car_solo": -1,
    "car_consolidated": -1, "liquidity_reserve_ratio": -1, "profit_before_tax": -1, "roa": -1,
}
TREND_SCORE_METRICS = {
    "npl_ratio": 1, "group2_ratio": 1, "ldr": 1, "st_funding_for_mlt_loans": 1, "cir": 1,
    "credit_growth_yoy": 1, "car_solo": -1, "car_consolidated": -1, "roa": -1, "roe": -1,
    "liquidity_reserve_ratio": -1, "llr_coverage": -1, "solvency_30d_vnd": -1,
}
CLUSTER_PROFILE_METRICS = {
    "npl_ratio": 1, "group2_ratio": 1, "ldr": 1, "st_funding_for_mlt_loans": 1, "credit_growth_yoy": 1,
    "cir": 1, "car_solo": -1, "car_consolidated": -1, "roa": -1, "roe": -1,
    "liquidity_reserve_ratio": -1, "llr_coverage": -1,
}

# --- Fixed values: red-flag categories grouped by nature, one score step per cluster.
FLAG_CLUSTERS = [
    ("credit", "growth_capital", "CREDIT_GROWTH_CAPITAL_GAP"),
    ("credit", "growth_capital", "CREDIT_GROWTH_RWA_DIVERGENCE"),
    ("credit", "growth_capital", "HOT_CREDIT_WEAK_SUPPORT"),
    ("credit", "migration_provision", "NPL_GROUP2_MIGRATION"),
    ("credit", "migration_provision", "PROVISION_LAG"),
    ("credit", "migration_provision", "NPL_DROP_DIVERGENCE"),
    ("credit", "concentration", "CONCENTRATION_BUILDUP"),
    ("credit", "accrued_offbalance", "ACCRUED_INTEREST_CREDIT_STRESS"),
    ("liquidity", "buffer_30d", "HQLA_OUTFLOW_STRESS"),
    ("liquidity", "funding_stability", "DEPOSIT_CASA_STRESS"),
    ("liquidity", "funding_stability", "WHOLESALE_FUNDING_SUBSTITUTION"),
    ("liquidity", "funding_stability", "LDR_HIGH_DEPOSIT_STRESS"),
    ("liquidity", "maturity_mismatch", "MATURITY_MISMATCH_BUILDUP"),
    ("liquidity", "market_sensitivity", "FX_LIQUIDITY_DIVERGENCE"),
    ("liquidity", "market_sensitivity", "INTEREST_RATE_GAP_LIQUIDITY"),
    ("fraud", "earnings_quality", "ACCRUED_INTEREST_PROFIT_DIVERGENCE"),
    ("fraud", "earnings_quality", "PROFIT_UP_OPS_DOWN"),
    ("fraud", "classification_provision", "NPL_GROUP2_PROVISION_DIVERGENCE"),
    ("fraud", "classification_provision", "NPL_DROP_DIVERGENCE"),
    ("fraud", "classification_provision", "OFFBALANCE_RISK_SHIFT"),
    ("fraud", "window_dressing", "YEAR_END_LIQUIDITY_WINDOW_DRESSING"),
    ("fraud", "window_dressing", "FUNDING_SOURCE_SWAP"),
    ("fraud", "capital_rwa", "CAPITAL_COMPONENT_MISMATCH"),
    ("fraud", "capital_rwa", "CREDIT_GROWTH_RWA_DIVERGENCE"),
]

# --- Fixed values: model and scoring parameters.
MODEL = {
    "random_state": 42, "model_version": "1.1.0", "config_version": "1.1.0",
    "winsorize": (0.01, 0.99), "scaler": "standard", "min_non_null_ratio": 0.30,
    "forest": {"n_estimators": 300, "contamination": 0.08, "max_samples": "auto", "top_features": 6},
    "kmeans": {"k_min": 2, "k_max": 10, "k_selection": "silhouette", "manual_k": 4, "n_init": 10, "max_iter": 300},
    "rolling_window": 4,
    "high_risk": {"min_anomaly_rate": 0.20, "min_critical_banks": 2, "systemic_stress_pct": 0.75},
    "weights": {"rule_violation_score": 0.35, "anomaly_score_norm": 0.25, "trend_risk_score": 0.15,
                "cluster_risk_score": 0.10, "data_quality_risk_score": 0.10, "systemic_period_risk_score": 0.05},
    "floors": {"CRITICAL": 90.0, "HIGH": 75.0, "MEDIUM": 50.0, "LOW": 25.0, "DATA_GAP": 70.0},
    "levels": [(25.0, "LOW"), (50.0, "MEDIUM"), (75.0, "HIGH"), (None, "CRITICAL")],
    "severity_points": {"INFO": 10.0, "LOW": 25.0, "MEDIUM": 50.0, "HIGH": 75.0, "CRITICAL": 100.0, "DATA_GAP": 70.0},
    "quality_points": {"INFO": 10.0, "LOW": 25.0, "MEDIUM": 50.0, "HIGH": 75.0, "CRITICAL": 100.0,
                       "DATA_GAP": 70.0, "CRITICAL_DATA_GAP": 100.0},
    "tolerance_days": {"quarterly": 130, "yearly": 430},
}

# --- Fixed values: early-warning metrics
# name, label, direction, limit, buffer, domain, weight, plausible lo, plausible hi.
EWS_METRICS = [
    ("car_solo", "CAR riêng lẻ", "higher_safer", 8.0, 1.5, "capital", 1.3, 1.0, 50.0),
    ("car_consolidated", "CAR hợp nhất", "higher_safer", 8.0, 1.5, "capital", 1.1, 1.0, 50.0),
    ("ldr", "LDR", "lower_safer", 85.0, 5.0, "liquidity", 1.1, 5.0, 200.0),
    ("st_funding_for_mlt_loans", "Vốn ngắn hạn cho vay TDH", "lower_safer", 30.0, 4.0, "liquidity", 1.0, 0.0, 100.0),
    ("liquidity_reserve_ratio", "Dự trữ thanh khoản", "higher_safer", 10.0, 3.0, "liquidity", 1.0, 0.0, 100.0),
    ("solvency_30d_vnd", "Khả năng chi trả 30 ngày", "higher_safer", 50.0, 10.0, "liquidity", 0.8, 0.0, 600.0),
    ("npl_ratio", "Tỷ lệ nợ xấu", "lower_safer", 3.0, 1.0, "credit", 1.1, 0.0, 60.0),
    ("group2_ratio", "Nợ nhóm 2", "lower_safer", 5.0, 2.0, "credit", 0.7, 0.0, 60.0),
    ("llr_coverage", "Bao phủ nợ xấu", "higher_safer", 50.0, 20.0, "credit", 0.6, 0.0, 500.0),
    ("roa", "ROA", "higher_safer", 0.0, 0.5, "profitability", 0.5, -30.0, 30.0),
]
EWS = {
    "lookback": 6, "horizon": 12, "min_points": 3,
    "signal_weights": {"proximity": 0.30, "trend": 0.24, "acceleration": 0.10, "volatility": 0.10,
                       "breach_streak": 0.16, "anomaly_persistence": 0.10},
    "levels": [(25.0, "NORMAL"), (50.0, "WATCH"), (75.0, "WARNING"), (None, "ALARM")],
    "labels": {"NORMAL": "Bình thường", "WATCH": "Theo dõi", "WARNING": "Cảnh báo", "ALARM": "Báo động"},
    "near_rank": 1, "breached_rank": 2, "breached_worsening_rank": 3, "projected_rank": 2,
    "adverse_trend": 0.3, "projected_periods": 3,
    "warn_share_warning": 0.20, "warn_share_alarm": 0.30, "watch_mean": 40.0, "score_jump": 12.0,
}

# --- Fixed values: stress scenarios
# id, name, NPL shock (pp), RWA shock, LGD, deposit run-off, wholesale run-off, HQLA haircut.
SCENARIOS = [
    ("baseline", "Cơ sở", 1.0, 0.02, 0.45, 0.05, 0.10, 0.05),
    ("adverse", "Bất lợi", 3.0, 0.05, 0.55, 0.10, 0.25, 0.10),
    ("severe", "Nghiêm trọng (khủng hoảng)", 6.0, 0.10, 0.65, 0.20, 0.40, 0.20),
    ("credit_crisis", "Sốc tín dụng cực đoan", 10.0, 0.08, 0.70, 0.05, 0.10, 0.05),
    ("liquidity_run", "Rút tiền hàng loạt (bank run)", 1.0, 0.0, 0.45, 0.30, 0.60, 0.25),
]
STRESS = {"min_car": 8.0, "lcr_min": 100.0, "stressed_ldr_limit": 100.0, "lgd": 0.55, "use_hqla": True}

# --- Fixed values: sheet-name keys to frequency, first match wins.
FREQUENCY_BY_SHEET = [("Ngày", "daily"), ("Thang", "monthly"), ("Thái", "monthly"), ("Quý", "quarterly"),
                      ("Quy", "quarterly"), ("Năm", "yearly"), ("Nam", "yearly")]
HEADER_KEYWORDS = ["Nhóm chỉ tiêu", "STT"]
NAME_KEYWORDS = ["Nhóm chỉ tiêu", "Chỉ tiêu"]
UNIT_KEYWORDS = ["Đơn vị"]
CAMELS_KEYWORDS = ["Khung CAMELS", "CAMELS"]

# --- Fixed values: text-mining keywords (normalised), metric, suggested rule; first match wins.
LIMIT_KEYWORDS = [
    ("ty le an toan von toi thieu", "car_solo", "CAR_SOLO_MIN"),
    ("ty le an toan von cap 1", "car_tier1", "TIER1_MIN"),
    ("ty le an toan von", "car_solo", "CAR_SOLO_MIN"),
    ("ty le kha nang chi tra", "solvency_30d_vnd", "QD682_SOLVENCY_30D_VND"),
    ("ty le du tru thanh khoan", "liquidity_reserve_ratio", "LIQUIDITY_RESERVE_MIN"),
    ("nguon von ngan han", "st_funding_for_mlt_loans", "ST_FUNDING_MLT_LIMIT"),
    ("cho vay trung han va dai han", "st_funding_for_mlt_loans", "ST_FUNDING_MLT_LIMIT"),
    ("du no cho vay so voi tong tien gui", "ldr", "LDR_LIMIT"),
    ("ty le du no cho vay", "ldr", "LDR_LIMIT"),
    ("gioi han cap tin dung", "credit_limit", "CREDIT_LIMIT"),
    ("gop von, mua co phan", "capital_contribution_ratio", "CAPITAL_CONTRIBUTION_LIMIT"),
    ("gop von mua co phan", "capital_contribution_ratio", "CAPITAL_CONTRIBUTION_LIMIT"),
    ("trai phieu chinh phu", "govbond_ratio", "GOVBOND_INVEST_LIMIT"),
    ("xep hang to chuc tin dung", "rating", "RATING"),
    ("no xau", "npl_ratio", "NPL_RATIO_LIMIT"),
    ("no co cau", "restructured_debt", "RESTRUCTURED"),
    ("vamc", "vamc", "VAMC"),
    ("von chu so huu", "equity", "EQUITY"),
    ("tong tai san", "total_assets", "TOTAL_ASSETS"),
    ("nim", "nim", "NIM"),
]
LIMIT_BOUND_WORDS = ["toi thieu", "toi da", "khong thap hon", "khong vuot qua", "khong duoc thap hon"]
COMMON_LEGAL_WORDS = ["ngan hang", "to chuc tin dung", "dieu", "thong tu", "ty le", "quy dinh"]
