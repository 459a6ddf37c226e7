import pytest

from prudens.operators.rating import Criterion, higher_is_better
from prudens.plans.rating_run import run_rating, store_rating
from prudens.sources.versions import read_version

DDL = "object_id string, period string, version int, status string, is_active int, type_code string, attributes map<string,string>, data map<string,double>"
OK, WAIT = "DA_PHE_DUYET", "CHO_DUYET"
X = {"ma_bien": "X"}
CRITERIA = [Criterion("1", "1", "C", X, (("X", True),), None, {"BIG": (100, higher_is_better(15, 12, 8, 5))}), Criterion("C_DT", "C_DT", "C", None, (), None, {"ALL": (100, None)})]
WEIGHTS = [("C", 100.0, 80.0)]


@pytest.fixture()
def objects(spark):
    return spark.createDataFrame([("a", "BIG", {"k": "v"}), ("b", "BIG", None), ("n", "OTHER", None)], "object_id string, type_code string, attributes map<string,string>")


def inputs(spark, *rows):
    return spark.createDataFrame([(o, p, v, s, act, t, None, d) for o, p, v, s, act, t, d in rows], DDL)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_run_rates_the_latest_approved_version_and_reports_the_rest(spark, objects):
    got = run_rating(inputs(
        spark, ("a", "2024-01", 1, OK, 1, None, {"X": 4.0}), ("a", "2024-01", 2, OK, 1, None, {"X": 16.0}), ("a", "2024-01", 3, WAIT, 1, None, {"X": 1.0}),
        ("a", "2024-02", 1, OK, 1, None, {"X": 9.0}), ("a", "2024-02", 2, OK, 0, None, {"X": 1.0}), ("b", "2024-01", 1, OK, 1, None, {"X": 9.0}),
        ("b", "2024-02", 1, OK, 1, None, None), ("b", "2024-03", 1, WAIT, 1, None, {"X": 9.0}), ("gone", "2024-01", 1, OK, 1, "BIG", {"X": 13.0}),
        (None, "2024-01", 1, OK, 1, "BIG", {"X": 13.0}), ("b", "2024-04", 1, OK, 0, "BIG", {"X": 13.0})), objects, CRITERIA, WEIGHTS)
    # 80 % of the band's points and 20 % of a clean record's five
    assert rows(got.results, "object_id", "period", "version", "total_score", "final_grade", "rank_text", "previous") == [
        ("a", "2024-01", 2, 5.0, "A", "1/3", None), ("a", "2024-02", 1, 3.4, "C", "1/1", 5.0), ("b", "2024-01", 1, 3.4, "C", "3/3", None), ("gone", "2024-01", 1, 4.2, "B", "2/3", None)]
    assert rows(got.errors, "object_id", "period", "error", "missing") == [("b", "2024-02", "MISSING_INPUT", "X"), ("b", "2024-03", "NO_APPROVED_INPUT", None)]
    assert tuple(got.summary.first()) == (6, 4, 2)
    assert {r["object_id"] for r in got.criteria.where("code = '1'").collect()} == {"a", "b", "gone"}


def test_losses_and_one_period(spark, objects):
    i = inputs(spark, *[("a", f"2024-{m:02d}", 1, OK, 1, None, {"X": 16.0, "CAR": 3.0 if m > 6 else 9.0}) for m in range(1, 13)])
    losses = spark.createDataFrame([("a", "2024-12", -60.0, 100.0)], "object_id string, period string, retained double, capital double")
    got = run_rating(i, objects, CRITERIA, WEIGHTS, losses=losses, period="2024-12").results.collect()
    assert [(r["original_grade"], r["final_grade"], r["reasons"]) for r in got] == [("A", "E", "losses above 50% of capital; CAR below 4% in 6 running months")]


def test_nothing_to_rate(spark, objects):
    got = run_rating(inputs(spark), objects, CRITERIA, WEIGHTS)
    assert got.results.count() == got.errors.count() == 0 and tuple(got.summary.first()) == (0, 0, 0)


def test_later_runs_replace_results_and_failures_keep_them(spark, objects, tmp_path):
    root = str(tmp_path / "ratings")
    store_rating(run_rating(inputs(spark, ("a", "2024-01", 1, OK, 1, None, {"X": 16.0}), ("b", "2024-01", 1, OK, 1, None, {})), objects, CRITERIA, WEIGHTS), root)
    store_rating(run_rating(inputs(spark, ("a", "2024-01", 2, OK, 1, None, {}), ("b", "2024-01", 2, OK, 1, None, {"X": 9.0})), objects, CRITERIA, WEIGHTS), root)
    assert rows(read_version(spark, f"{root}/results"), "object_id", "total_score") == [("a", 5.0), ("b", 3.4)]
    assert rows(read_version(spark, f"{root}/status"), "object_id", "n_errors") == [("a", 1), ("b", 0)]
    assert read_version(spark, f"{root}/criteria").count() == 4
