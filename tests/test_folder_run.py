import csv
import threading

import numpy as np
import pytest

from prudens import config
from prudens.operators import cluster, ratios, rules, scoring
from prudens.plans import folder_run
from prudens.plans.folder_run import export_run, load_folder, read_export, run_folder
from prudens.sources.panel import SchemaMismatch
from prudens.sources.settings import deep_merge
from prudens.sources.sinks import write_sections

MODEL = deep_merge(config.MODEL, {"forest": {"n_estimators": 10}, "kmeans": {"k_max": 2, "n_init": 1}})
LABELS = [("Tổng tài sản", 100000.0), ("Tổng vốn chủ sở hữu", 9000.0), ("Tổng dư nợ cho vay khách hàng (gộp)", 70000.0), ("Tiền gửi của khách hàng", 85000.0),
          ("Tỷ lệ dự trữ thanh khoản", 14.0), ("Tỷ lệ tiền gửi không kỳ hạn (CASA)", 30.0), ("Chỉ tiêu lạ", 1.0)]
BANKS = "ABCDE"


def sheet(folder, bank, name, labels, periods, value):
    with open(folder / f"{bank}__{name}.csv", "w", encoding="utf-8", newline="") as out:
        w = csv.writer(out)
        w.writerow(["Báo cáo"])
        w.writerow(["STT", "Nhóm chỉ tiêu", "Đơn vị", *periods])
        for i, (label, v) in enumerate(labels):
            w.writerow([i + 1, label, "Tỷ đồng", *[value(v, k) for k in range(len(periods))]])


@pytest.fixture()
def folder(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    months = [f"T{m:02d}/2024" for m in range(1, 9)]
    for i, b in enumerate(BANKS):
        sheet(at, b, "Biểu Thang", LABELS, months, lambda v, k, i=i: round(v * (1 + 0.03 * i) + k * (1 + i), 2))
        sheet(at, b, "Biểu Quý", [("Tổng nợ xấu", 900.0)], ["Q1/2024", "Q2/2024"], lambda v, k, i=i: v * (1 + i) + k)
    (at / "Z__ghi chú.csv").write_text("x,y\n", encoding="utf-8")
    # a tidy panel whose name sorts last: it corrects one figure and brings a yearly metric
    rows = [("A", "2024-03", "2024-03-31", "monthly", "deposits", 12345.0), *[(b, "2023", "2023-12-31", "yearly", "rwa", 50000.0) for b in BANKS]]
    with open(at / "zz.csv", "w", encoding="utf-8", newline="") as out:
        csv.writer(out).writerows([["bank_id", "period", "period_ts", "frequency", "metric_name", "metric_value"], *rows])
    return at


def test_folder_to_panel_and_combined_table(spark, folder, tmp_path, monkeypatch):
    got = load_folder(spark, str(folder), str(tmp_path / "cache"))
    assert got.base == "monthly" and set(got.wide) == {"monthly", "quarterly", "yearly", "combined"}
    assert got.metrics["quarterly"] == ["npl_amount"] and got.metrics["yearly"] == ["rwa"]
    assert got.panel.count() == 5 * (6 * 8 + 2 + 1)
    c = {(r["bank_id"], r["period"]): r for r in got.wide["combined"].collect()}
    assert len(c) == 40 and c["A", "2024-03"]["deposits"] == 12345.0
    assert [c["B", p]["npl_amount"] for p in ("2024-02", "2024-03", "2024-06", "2024-08")] == [None, 1800.0, 1801.0, 1801.0]
    assert c["C", "2024-08"]["rwa"] == 50000.0 and c["C", "2024-08"]["_from_rwa"] == "yearly"
    assert [tuple(r) for r in got.unmapped.collect()] == [("Chỉ tiêu lạ", 5)] and [tuple(r) for r in got.rejected.collect()] == [("Z.csv", "ghi chú", "no header")]
    listed = {r["file"]: (r["rows"], r["frequencies"]) for r in got.files.collect()}
    assert listed == {**{f"{b}.csv": (50 - (b == "A"), "monthly,quarterly") for b in BANKS}, "Z.csv": (0, ""), "zz.csv": (6, "monthly,yearly")}
    # nothing changed: no report is read again
    monkeypatch.setattr(folder_run, "read_folder", lambda *a: pytest.fail("read again"))
    again = load_folder(spark, str(folder), str(tmp_path / "cache"))
    assert again.signature == got.signature and again.panel.count() == got.panel.count() and again.unmapped.count() == 1


def test_folder_to_export(spark, folder, tmp_path, inst):
    log, root = str(tmp_path / "log"), str(tmp_path / "out")
    labels = spark.createDataFrame([("rule", "false_positive", "ldr"), ("rule", "confirmed_anomaly", "ldr")], "source string, label string, metric string")
    tuned = {"applied": True, "forest": {"contamination": 0.2}}
    run = run_folder(spark, str(folder), inst, str(tmp_path / "cache"), "combined", MODEL, tuned, labels, log)
    names = export_run(run, root)
    out = read_export(spark, root, "combined")
    assert set(out) == set(names) and {"provenance", "rule_findings", "ews_latest", "heatmap", "cluster_profiles"} <= set(names)
    assert out["scores"].count() == run.features.count() == 40 and out["ranking"].count() == 5 and out["anomalies"].where("anomaly_label = 1").count() == 8
    assert out["rule_findings"].count() == run.result.findings.count() and out["stress"].count() == 40 * len(config.SCENARIOS)
    assert out["heatmap"].count() == 5 and len(out["heatmap"].columns) == 9
    assert {r["metric"]: r["sources"] for r in out["provenance"].collect()}["npl_amount"] == "quarterly"
    record = spark.read.parquet(log).collect()
    assert [(r["n_records_panel"], r["n_banks"], r["n_periods"], r["feedback_fp_rate"], r["frequency"], r["data_version"]) for r in record] == [(255, 5, 8, 0.5, "combined", run.load.signature)]


def test_absent_frequency_and_faulty_panels(spark, folder, tmp_path, inst):
    cache, root = str(tmp_path / "cache"), str(tmp_path / "out")
    run = run_folder(spark, str(folder), inst, cache, "daily", MODEL)
    assert run.result is None and export_run(run, root) == [] and read_export(spark, root, "daily") == {}
    (folder / "zz.csv").write_text("a,b\n1,2\n")
    with pytest.raises(SchemaMismatch):
        load_folder(spark, str(folder), cache)
    empty = tmp_path / "empty"
    empty.mkdir()
    got = load_folder(spark, str(empty), cache)
    assert got.wide == {} and got.base is None and got.panel.count() == 0 and got.files.count() == 0


def test_nearest_centres_are_exact():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 6)), np.repeat(rng.normal(size=(3, 6)), 4, 0) + 1e6])
    # equal centres, centres a rounding apart, and points midway between two
    centres = np.concatenate([x[:4], x[:2], x[300:301], np.nextafter(x[300:301], np.inf), x[5:6] + 1, x[5:6] - 1])
    own, low = cluster._nearest(x, centres)
    far = cluster._gaps(x, centres)
    assert (own == far.argmin(1)).all() and (low == far.min(1)).all()
    x[0, 0] = np.nan
    assert (cluster._nearest(x, centres)[0] == cluster._gaps(x, centres).argmin(1)).all()


def test_one_fit_and_one_scoring_pass(spark, wide, inst, monkeypatch):
    def refit(*a, **k):
        raise AssertionError("the chosen k was fitted with the board")

    # four banks are clustered with k = 2 or 3
    monkeypatch.setattr(cluster, "best_fit", refit)
    labels, _, board = cluster.cluster_banks(wide, ["car_solo", "ldr", "npl_ratio"])
    assert board.count() == 2 and labels.count() == 4
    staged = []
    monkeypatch.setattr(scoring, "stage", lambda df, name: staged.append(name) or df)
    f = ratios.derive_ratios(wide)
    scoring.risk_scores(f, rules.evaluate_rules(f, inst), None)
    assert staged == ["composite"]


def test_sections_are_written_side_by_side(tmp_path):
    both = threading.Barrier(2, timeout=20)

    class Table:
        """A table whose write ends only when another is being written."""
        write = property(lambda self: self)
        mode = format = lambda self, _: self
        save = lambda self, _: both.wait()

    assert write_sections({"a": Table(), "b": Table()}, f"{tmp_path}", "parquet") == [f"{tmp_path}/a", f"{tmp_path}/b"]
