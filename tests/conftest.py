import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from suite.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def wide(spark):
    """Four banks, eight quarters, from healthy (A) to breaching (D)."""
    level = {"A": (14.0, 70.0, 1.2, 18.0, 1.4), "B": (11.0, 80.0, 2.5, 13.0, 0.9), "C": (9.5, 84.0, 3.5, 11.0, 0.4), "D": (6.5, 92.0, 6.0, 8.0, -0.3)}
    rows = []
    for b, (car, ldr, npl, res, roa) in level.items():
        for i in range(8):
            y, q = 2023 + i // 4, i % 4 + 1
            end = dt.date(y + (q == 4), 1 if q == 4 else q * 3 + 1, 1) - dt.timedelta(days=1)
            rows.append((b, b, f"{y}Q{q}", end, car, ldr, npl, res, roa, 100000.0 + 1000 * i, 9000.0 + 50 * i, 70000.0 + 800 * i, 85000.0 + 600 * i, 25 + 0.5 * i))
    return spark.createDataFrame(rows, "bank_id string, bank_name string, period string, period_ts date, car_solo double, ldr double, npl_ratio double, "
                                       "liquidity_reserve_ratio double, roa double, total_assets double, equity double, customer_loans double, "
                                       "deposits double, st_funding_for_mlt_loans double")


@pytest.fixture(scope="session")
def inst(spark):
    return spark.createDataFrame([(b, "nhtm_co_phan", False, None) for b in "ABCD"], "bank_id string, type string, special_control boolean, reason string")
