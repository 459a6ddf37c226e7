"""Canonical metric to the source labels that report it."""

METRIC_ALIASES = {
    "total_assets": ["Tổng tài sản"],
    "charter_capital": ["Vốn điều lệ"],
    "charter_capital_real": ["Giá trị thực của vốn điều lệ"],
    "equity": ["Tổng vốn chủ sở hữu", "Vốn chủ sở hữu"],
    "own_capital_solo": ["Vốn tự có (riêng lẻ)", "Vốn tự có"],
    "tier1_capital": ["Giá trị vốn cấp 1"],
    "tier2_capital": ["Giá trị vốn cấp 2"],
    "funds": ["Quỹ của tổ chức tín dụng"],
    "customer_loans": ["Tổng dư nợ cho vay khách hàng (gộp)", "Tổng dư nợ tín dụng KH cá nhân, tổ chức kinh tế"],
    "total_loans": ["Tổng dư nợ cho vay", "Tổng dư nợ cấp tín dụng"],
    "short_term_loans": ["Tổng dư nợ cho vay khách hàng ngắn hạn"],
    "medium_long_term_loans": ["Tổng dư nợ cho vay trung, dài hạn"],
    "deposits": ["Tiền gửi của khách hàng"],
    "total_deposits": ["Tổng tiền gửi"],
    "customer_deposits_and_valuable_papers": ["Tổng tiền gửi của khách hàng và Phát hành giấy tờ có giá"],
    "interbank_funding": ["Tổng Tiền gửi của các TCTD khác và Vay các TCTD khác"],
    "valuable_papers_issued": ["Phát hành giấy tờ có giá"],
    "total_liabilities": ["Tổng nợ phải trả"],
    "npl_amount": ["Tổng nợ xấu"],
    "provisions": ["Số dư dự phòng rủi ro tín dụng"],
    "hqla": ["Tài sản thanh khoản cao (HQLA)"],
    "rwa": ["Tài sản có rủi ro (RWA)"],
    "rwa_credit": ["Tài sản tính theo rủi ro tín dụng (RWA tín dụng)"],
    "short_term_funding": ["Tổng nguồn vốn ngắn hạn"],
    "medium_long_term_funding": ["Tổng nguồn vốn trung, dài hạn"],
    "off_balance_commitments": ["Tổng cam kết ngoại bảng"],
    "govbond_investment": ["Tổng giá trị mua, đầu tư TPCP, TP được CP bảo lãnh"],
    "real_estate_loans": ["Dư nợ cấp tín dụng lĩnh vực bất động sản"],
    "risky_sector_loans": ["Dư nợ cấp tín dụng lĩnh vực tiềm ẩn rủi ro"],
    "unsecured_loans": ["Dư nợ cấp tín dụng không có tài sản bảo đảm"],
    "large_customer_loans": ["Dư nợ nhóm khách hàng có dư nợ ≥ 1.000 tỷ đồng"],
    "top100_customer_loans": ["Dư nợ 100 khách hàng lớn nhất và người liên quan (nội bảng)"],
    "agri_sector_loans": ["Dư nợ ngành nông nghiệp, lâm nghiệp, thủy sản (lĩnh vực ưu tiên)"],
    "investment_securities": ["Chứng khoán đầu tư"],
    "cash_fx_gold": ["Tiền mặt, chứng từ có giá trị ngoại tệ, kim loại quý"],
    "deposits_at_sbv": ["Tiền gửi tại Ngân hàng Nhà nước"],
    "interbank_assets": ["Tiền gửi và cho vay các TCTD khác (tài sản)"],
    "net_cash_outflow_30d": ["Dòng tiền ra ròng trong 30 ngày", "Dòng tiền ra ròng trong 30 ngày (ngoại tệ)"],
    "operational_risk_capital": ["Tổng vốn yêu cầu cho rủi ro hoạt động"],
    "market_risk_capital": ["Tổng vốn yêu cầu cho rủi ro thị trường"],
    "rate_sensitive_assets": ["Tổng giá trị tài sản nhạy cảm với lãi suất"],
    "rate_sensitive_liabilities": ["Nợ phải trả nhạy cảm với lãi suất"],
    "toi": ["Tổng thu nhập hoạt động (TOI)"],
    "operating_expense": ["Chi phí hoạt động"],
    "credit_provision_expense": ["Chi phí dự phòng rủi ro tín dụng"],
    "profit_before_tax": ["Lợi nhuận trước thuế"],
    "profit_after_tax": ["Lợi nhuận sau thuế"],
    "net_interest_income": ["Thu nhập lãi thuần (NII)"],
    "interest_income": ["Thu nhập lãi và các khoản thu nhập tương tự (gộp)"],
    "accrued_interest": ["Các khoản lãi và phí phải thu (lãi dự thu)"],
    "car_consolidated": ["Tỷ lệ an toàn vốn (CAR) hợp nhất"],
    "car_solo": ["Tỷ lệ an toàn vốn tối thiểu (CAR) (riêng lẻ)"],
    "car_tier1": ["Tỷ lệ an toàn vốn cấp 1"],
    "ldr": ["Tỷ lệ dư nợ cho vay so với tổng tiền gửi (LDR)"],
    "npl_ratio": ["Tỷ lệ nợ xấu"],
    "group2_ratio": ["Tỷ lệ nợ Nhóm 2 so với tổng nợ"],
    "group5_ratio": ["Tỷ lệ nợ nhóm 5 (có khả năng mất vốn) / dư nợ"],
    "bad_offbalance_ratio": ["Tỷ lệ nợ và cam kết ngoại bảng nhóm 3-5 / tổng (1-5)"],
    "st_funding_for_mlt_loans": ["Tỷ lệ nguồn vốn ngắn hạn được sử dụng để cho vay trung và dài hạn"],
    "llr_coverage": ["Tỷ lệ bao phủ nợ xấu (LLR)"],
    "liquidity_reserve_ratio": ["Tỷ lệ dự trữ thanh khoản"],
    "avg_liquid_asset_ratio": ["Tỷ lệ tài sản thanh khoản cao bình quân / tổng tài sản bình quân"],
    "loan_to_total_funding": ["Tỷ lệ cho vay trên tổng nguồn vốn"],
    "solvency_30d_vnd": ["Tỷ lệ khả năng chi trả trong 30 ngày", "Tỷ lệ khả năng chi trả trong 30 ngày (VND)",
                         "Tỷ lệ khả năng chi trả 30 ngày (VND)"],
    "solvency_30d_fx": ["Tỷ lệ khả năng chi trả 30 ngày (ngoại tệ)", "Tỷ lệ khả năng chi trả trong 30 ngày (ngoại tệ)"],
    "govbond_ratio": ["Tỷ lệ mua, đầu tư trái phiếu Chính phủ, trái phiếu được Chính phủ bảo lãnh"],
    "equity_to_assets": ["Tỷ lệ vốn chủ sở hữu / tổng tài sản"],
    "capital_contribution_ratio": ["Tỷ lệ góp vốn, mua cổ phần / VĐL và quỹ"],
    "mlt_loan_ratio": ["Tỷ lệ dư nợ trung-dài hạn / tổng dư nợ"],
    "real_estate_loan_ratio": ["Tỷ lệ dư nợ đầu tư, kinh doanh bất động sản"],
    "largest_customer_group_ratio": ["Tỷ lệ dư nợ nhóm khách hàng lớn nhất / dư nợ cho vay"],
    "roa": ["Tỷ suất sinh lời tổng tài sản (ROA)"],
    "roe": ["Tỷ suất sinh lời vốn chủ sở hữu (ROE)"],
    "nim": ["Tỷ lệ thu nhập lãi cận biên (NIM)"],
    "cir": ["Tỷ lệ chi phí / thu nhập (CIR)"],
    "casa": ["Tỷ lệ tiền gửi không kỳ hạn (CASA)"],
    "credit_growth_yoy": ["Tăng trưởng dư nợ tín dụng (so cùng kỳ)"],
    "asset_growth_yoy": ["Tăng trưởng tổng tài sản (so cùng kỳ)"],
    "fx_position_ratio": ["Tỷ lệ trạng thái ngoại tệ trên vốn tự có"],
    "rate_sensitive_gap_ratio": ["Tỷ lệ chênh lệch tài sản - nợ nhạy cảm lãi suất / vốn chủ sở hữu"],
    "securities_provision_ratio": ["Tỷ lệ dự phòng RR chứng khoán KD, đầu tư / số dư CK"],
    "accrued_interest_days": ["Số ngày lãi phải thu"],
}
