import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prudens import config
from prudens.functions import plaintext
from prudens.functions.periods import frequency_from_sheet, parse_period
from prudens.functions.reshape import to_long
from prudens.functions.ranks import Positions, average_rank_pct, group_quantiles
from prudens.functions.text import normalize_label
from prudens.operators import anomaly, apart, asof, crosssection, ews, ratios, rating, redflags, rules, scoring, stress, textlimits, trends, tuning, validation
from prudens.sources import settings

ID = "bank_id string, bank_name string, period string, period_ts date"
DAY = dt.date(2024, 3, 31)


def one(spark, **metrics):
    cols = ", ".join(f"{k} double" for k in metrics)
    return spark.createDataFrame([("A", "A", "2024-03", DAY, *[None if v is None else float(v) for v in metrics.values()])], f"{ID}, {cols}")


def months(spark, **series):
    n = len(next(iter(series.values())))
    rows = [("A", "A", f"2024-{i + 1:02d}", dt.date(2024, i + 1, 28), *[None if s[i] is None else float(s[i]) for s in series.values()]) for i in range(n)]
    return spark.createDataFrame(rows, f"{ID}, " + ", ".join(f"{k} double" for k in series))


def test_exact_positions_match_numpy_on_skewed_values(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.zeros(700), rng.normal(size=900).round(2), rng.normal(size=400) * 1e6])
    df = spark.createDataFrame([("g", float(v), i) for i, v in enumerate(values)] + [("g", None, -1), ("h", 2.0, -2)], "k string, v double, i int").repartition(5)
    q = group_quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.99}).where("k = 'g'").first()
    assert np.allclose([q["a"], q["b"], q["c"]], np.quantile(values, [0.01, 0.5, 0.99]))
    pos = Positions(df, ["k"], "v", ["i"], 7)
    got = {r["v"]: r["p"] for r in pos.rows.where("k = 'g'").select("v", average_rank_pct().alias("p")).collect()}
    assert np.allclose(pos.quantiles({"b": 0.5}).where("k = 'g'").first()["b"], np.median(values))
    assert pos.source.select("_part").distinct().count() > 1 and pos.nulls.count() == 1
    for v in (0.0, float(np.max(values)), float(np.min(values))):
        assert got[v] == pytest.approx(((values < v).sum() + ((values == v).sum() + 1) / 2) / len(values) * 100)


def test_ratio_needs_a_positive_divisor_and_respects_ceiling(spark):
    r = ratios.derive_ratios(one(spark, customer_loans=100, deposits=0)).first()
    assert r["ldr"] is None
    dust = one(spark, customer_loans=9994.57, deposits=0.01)
    assert ratios.derive_ratios(dust).first()["ldr"] is None
    assert [g["metric"] for g in ratios.ratio_gaps(dust).collect()] == ["ldr"]
    kept = ratios.derive_ratios(one(spark, customer_loans=100, deposits=50, ldr=1995)).first()
    assert kept["ldr"] == 1995.0
    assert ratios.derive_ratios(one(spark, equity=-1400, total_assets=1000)).first()["equity_to_assets"] == -140.0


def test_sparse_quarterly_growth_is_carried(spark):
    f = months(spark, group2_ratio=[None, None, 4, None, None, 5, None, None, 5, None, None, 6])
    t = {r["period"]: r for r in trends.trend_features(to_long(f, config.ID_COLS, ["group2_ratio"])).collect()}
    assert t["2024-06"]["qoq"] == pytest.approx(25.0) and t["2024-07"]["qoq"] == 0.0


def test_asof_takes_the_row_and_never_looks_ahead(spark):
    base = months(spark, ldr=[70, 71, 72, 73])
    src = spark.createDataFrame([("A", dt.date(2024, 2, 28), 3.0, None), ("A", dt.date(2024, 4, 28), 4.0, 9.0), ("A", dt.date(2023, 1, 1), 1.0, 1.0)],
                                "bank_id string, period_ts date, npl double, x double")
    got = {r["period"]: (r["_asof_npl"], r["_asof_x"]) for r in asof.asof_backward(base, src, ["npl", "x"], 130).collect()}
    assert got == {"2024-01": (None, None), "2024-02": (3.0, None), "2024-03": (3.0, None), "2024-04": (4.0, 9.0)}


def test_tiers_are_exclusive_and_by_type(spark, inst):
    for value, kind in [(7.9, "VIOLATION"), (8.2, "WARNING"), (9.0, "WATCH")]:
        got = rules.evaluate_tiered(one(spark, car_solo=value), inst).where("rule_id = 'QD682_CAR_SOLO'").collect()
        assert [r["finding_type"] for r in got] == [kind]
    assert rules.evaluate_tiered(one(spark, car_solo=9.5), inst).where("rule_id = 'QD682_CAR_SOLO'").count() == 0
    excluded = spark.createDataFrame([("A", "nhtm_co_phan", True, "x")], "bank_id string, type string, special_control boolean, reason string")
    every = rules.evaluate_rules(one(spark, car_solo=1.0), excluded)
    assert [r["finding_type"] for r in every.where("rule_id like 'SPECIAL%' or rule_id = 'QD682_CAR_SOLO'").collect()] == ["SPECIAL_CONTROL"]
    nobody = inst.where("bank_id = 'Z'")
    assert rules.unclassified(one(spark, car_solo=9.0), nobody).count() == 1


def test_misordered_tiers_and_default_tiers(spark):
    assert rules.misordered_tiers(spark).count() == 0
    bad = {**config.RULE_TIERS, "QD682_LDR": {"nhtm_co_phan": (83.0, 80.0, 85.0)}}
    assert [r["rule_id"] for r in rules.misordered_tiers(spark, tiers=bad).collect()] == ["QD682_LDR"]
    assert rules.rule_appendix(spark).count() == 21


def test_worst_severity_ignores_gaps_when_others_exist(spark):
    rows = [("A", "p", "DATA_GAP"), ("A", "p", "INFO"), ("B", "p", "DATA_GAP")]
    df = spark.createDataFrame(rows, "bank_id string, period string, severity string").selectExpr("*", "date'2024-01-01' as period_ts", "bank_id as bank_name")
    assert {r["bank_id"]: r["worst_severity"] for r in rules.summarize(df).collect()} == {"A": "INFO", "B": "DATA_GAP"}


def test_rising_needs_three_reported_values(spark):
    f = months(spark, group2_ratio=[1, None, 2, None, 3, None])
    hits = redflags.red_flags(f, ["NPL_GROUP2_MIGRATION"]).collect()
    assert [h["period"] for h in hits] == ["2024-05"]


def test_missing_periods_between_first_and_last(spark):
    rows = [("A", "monthly", f"2024-{m:02d}", dt.date(2024, m, 28), "x") for m in (1, 2, 5)]
    p = spark.createDataFrame(rows, "bank_id string, frequency string, period string, period_ts date, metric_name string")
    assert sorted(r["period"] for r in validation.missing_periods(p).collect()) == ["2024-03", "2024-04"]
    assert validation.short_history(p.where("period <> '2024-05'")).count() == 1


def test_stress_arithmetic_and_breaking_point(spark):
    f = one(spark, own_capital_solo=100, car_solo=10, customer_loans=500, npl_ratio=2, deposits=600)
    inp = stress.stress_inputs(f)
    assert inp.first()["rwa"] == pytest.approx(1000.0)
    sc = stress.scenario_table(spark, [("x", "x", 2.0, 0.0, 0.5, 0.0, 0.0, 0.0), ("y", "y", 10.0, 0.2, 1.0, 0.0, 0.0, 0.0)])
    got = {r["scenario_id"]: r for r in stress.run_scenarios(inp, sc).collect()}
    assert got["x"]["stressed_car"] == 9.5 and got["x"]["passes_capital"]
    assert got["y"]["capital_shortfall"] == pytest.approx(46.0)
    assert stress.breaking_points(inp, {"lgd": 0.5}).first()["breaking_npl_pp"] == 8.0


def test_ews_projects_a_falling_ratio_and_drops_garbage(spark):
    f = months(spark, car_solo=[11.0 - 0.4 * i for i in range(6)], ldr=[1995] * 6)
    t = ews.ews_table(f).orderBy("period_ts").collect()
    assert t[-1]["ews_score"] > t[2]["ews_score"] and t[-1]["projected_periods_to_breach"] is not None
    assert all(r["n_breached"] == 0 and r["n_data_gap"] >= 1 for r in t)


def test_missing_domain_is_null_and_override_is_critical(spark, wide, inst):
    f = ratios.derive_ratios(wide)
    s = scoring.risk_scores(f, rules.evaluate_rules(f, inst), None)
    rows = s.collect()
    assert len(rows) == 32 and all(r["final_risk_score"] >= r["rule_based_floor"] for r in rows)
    d = [r for r in rows if r["bank_id"] == "D"]
    assert all(r["risk_level"] == "CRITICAL" and r["final_risk_score"] >= 90 for r in d)
    only = one(spark, car_solo=14)
    dom = scoring.domain_scores(scoring.score_inputs(only), scoring.rule_violation_score(rules.evaluate_flat(only)),
                                scoring.flag_clusters(redflags.red_flags(only))).first()
    assert dom["credit_risk_score"] is None or dom["credit_risk_score"] > 0
    assert dom["liquidity_risk_score"] is None and dom["fraud_risk_proxy_score"] is None


def test_period_baseline_is_zero_by_construction(wide):
    long = to_long(wide, config.ID_COLS, ["npl_ratio", "ldr", "car_solo"])
    r = crosssection.systemic_stress(long, baseline="period").agg(F.max(F.abs("systemic_stress_index"))).first()[0]
    assert r == 0.0


def test_forest_finds_the_outlier_and_is_deterministic(spark):
    rng = np.random.default_rng(0)
    rows = [(f"B{i:03d}", f"B{i:03d}", "2024-03", DAY, *(rng.normal(size=2) + (30 if i == 7 else 0)).tolist()) for i in range(200)]
    f = spark.createDataFrame(rows, f"{ID}, x double, y double")
    model = settings.deep_merge(config.MODEL, {"forest": {"n_estimators": 40, "contamination": 0.05}})
    a = anomaly.isolation_forest(f, ["x", "y"], model).orderBy("bank_id").collect()
    b = anomaly.isolation_forest(f, ["x", "y"], model).orderBy("bank_id").collect()
    assert a == b and [r["bank_id"] for r in a if r["anomaly_rank"] == 1] == ["B007"]
    assert sum(r["anomaly_label"] for r in a) == pytest.approx(10, abs=1)


def test_tuned_overlay_applies_and_resets():
    tuned = tuning.tuned_overlay({"contamination": 0.05})
    m = settings.effective_model(config.MODEL, tuned)
    assert m["forest"]["contamination"] == 0.05 and m["forest"]["n_estimators"] == 300
    assert settings.effective_model(config.MODEL, tuning.tuned_overlay())["forest"] == config.MODEL["forest"]


def test_period_labels(spark):
    rows = [("T03/2024", "monthly"), ("q2-2024", "quarterly"), ("Năm 2024", "yearly"), ("31/02/2024", "daily"), ("29.02.2024", "daily"), ("x", "monthly")]
    df = spark.createDataFrame(rows, "l string, f string").select(parse_period(F.col("l"), F.col("f")).alias("p"), normalize_label(F.col("l")).alias("n"))
    assert [r["p"]["period"] for r in df.collect()] == ["2024-03", "2024Q2", "2024", None, "2024-02-29", None]
    s = spark.createDataFrame([("Biểu Quý I",), ("số liệu năm",), ("khác",)], "s string").select(frequency_from_sheet(F.col("s")).alias("f"))
    assert [r["f"] for r in s.collect()] == ["quarterly", "yearly", None]


def test_limits_from_text(spark):
    text = "Tỷ lệ an toàn vốn tối thiểu không thấp hơn 8%. Nợ xấu 3,5%;\nKhông liên quan."
    got = textlimits.candidate_limits(spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")).orderBy("pos").collect()
    assert [(r["candidate_metric"], r["candidate_threshold"], r["confidence"], r["status"]) for r in got] == [
        ("car_solo", 8.0, 0.9, "CANDIDATE_OK"), ("npl_ratio", 3.5, 0.75, "REVIEW_REQUIRED")]


def test_texts_are_read_in_batches_like_labels(spark, monkeypatch):
    texts = ["  Tỷ lệ\n\n an  toàn vốn ", "Ty\u0301 le\u0323 an\u00a0toan von", "\u212aha nang; TỶ LỆ\tAN TOÀN VỐN.\u0301 x", "\u3000\u2028 điều. Điều ĐIỀU\x85", "", None, " \n", "ΑΣ İ \x00\x7f \U0001f600\ufe0f é\u0301 \u0301 1",
             "Ngân hàng. Thông tư;\n\n Nợ xấu 3,5% " + "x" * 60, "gop von, mua co phan 7%;\nnguồn vốn ngắn hạn."]
    pages = spark.createDataFrame([(i % 4, i, t) for i, t in enumerate(texts)], "doc_id int, page int, text string")
    labels = [r.n for r in pages.coalesce(1).select(normalize_label(F.col("text")).alias("n")).collect()]
    for size in (10, 2_000_000):
        monkeypatch.setattr(plaintext, "SLICE", size)
        forms, raw, chars = (list(x) for x in zip(*[(f, r, c) for at, n in plaintext.slices(pa.array(texts)) for f, r, c in zip(*(y.tolist() for y in plaintext.plain(pa.array(texts[at:at + n]))))]))
        assert ["".join(c if c.isascii() and c > "\0" else "\x7f" for c in n) for n in labels] == [f.strip(" ") for f in forms]
    assert raw == [len(t or "") for t in texts] and chars == [len((t or "").strip()) for t in texts]
    # sentences and page marks as the expressions on one label give them
    found = textlimits.candidate_limits(pages).select("doc_id", "page", "pos", "extracted_text").collect()
    split = pages.select("doc_id", "page", F.posexplode(F.split("text", textlimits.SENTENCE_END)).alias("pos", "c")).where(normalize_label(F.col("c")).rlike(textlimits._ANY_KEYWORD))
    assert sorted(tuple(r)[:3] for r in found) == sorted(tuple(r)[:3] for r in split.collect()) and len(found) == 4
    marks = textlimits.text_quality(pages)
    assert {r.doc_id: (r.n_pages, r.pages_with_text, r.total_chars) for r in marks.collect()} == {
        d: (len(range(d, 10, 4)), sum(chars[i] > 0 for i in range(d, 10, 4)), sum(chars[d::4])) for d in range(4)}
    assert "translate(" not in marks._jdf.queryExecution().optimizedPlan().toString()


def test_institution_types_from_config(spark):
    got = settings.institution_types(spark, {"banks": {"A": {"type": "t"}}, "special_control": [{"bank_id": "S"}]}).orderBy("bank_id").collect()
    assert [(r["bank_id"], r["type"], r["special_control"]) for r in got] == [("A", "t", False), ("S", None, True)]


def test_formula_errors_and_bands(spark):
    bad = rating.Criterion("x", "x", "C", {"phep_toan": "CHIA", "tham_so": [{"ma_bien": "a"}]}, (), None, {"ALL": (50, rating.higher_is_better(4, 3, 2, 1))})
    assert sorted(r["error"] for r in rating.formula_errors(spark, [bad]).collect()) == ["UNDECLARED_VARIABLE", "WRONG_ARITY"]
    with pytest.raises(rating.FormulaError):
        rating.compile_formula(bad.formula, lambda n: F.lit(1.0))


def test_quantiles_by_counting_equal_those_of_sorted_rows(spark, monkeypatch):
    from prudens.functions import ranks
    df = spark.range(4000).selectExpr("case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' end as k", "case when id % 17 = 0 then null when id % 5 = 0 then 0D when id % 1001 = 0 then -1e300"
                                      " when id % 11 = 0 then double('inf') else (hash(id) % 10000) * pow(10D, id % 9 - 4) end as v").union(spark.sql("select 'none', cast(null as double) union all select 'one', 5D"))
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.8, "first": 0.0}
    sort = lambda rows: sorted(map(str, rows))
    sorted_rows = sort(Positions(df, ["k"], "v").quantiles(probs).collect())
    monkeypatch.setattr(ranks, "Positions", None)  # no row is range-partitioned
    for exact in (20_000, 3):
        assert sort(ranks.group_quantiles(df, ["k"], "v", probs, exact).collect()) == sorted_rows


def test_ews_windows_read_each_value_once(spark):
    series = {"F": [90.0] * 8, "U": [70.0, 71.0, 73.0, 72.0, 76.0, 75.0, 80.0, 88.0]}
    f = spark.createDataFrame([(b, b, f"2024-{i + 1:02d}", dt.date(2024, i + 1, 1), x) for b, xs in series.items() for i, x in enumerate(xs)], "bank_id string, bank_name string, period string, period_ts date, ldr double")
    out = ews.metric_signals(f)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regr_slope" not in plan  # a moving frame was evaluated anew for each row and slope
    last = {r["bank_id"]: r for r in out.where("period = '2024-08'").collect()}
    assert (last["F"]["trend"], last["F"]["acceleration"], last["F"]["volatility"]) == (0.0, 0.0, 0.0)
    xs, (_, _, direction, lim, buffer, *_rest) = series["U"][-6:], next(m for m in config.EWS_METRICS if m[0] == "ldr")
    mean = sum(xs) / 6
    slope = sum((i - 2.5) * x for i, x in enumerate(xs)) / 17.5
    sd = (sum((x - mean) ** 2 for x in xs) / 6) ** 0.5
    if direction == "higher_safer":
        slope = -slope
    assert abs(last["U"]["trend"] - min(max(slope * 6 / max(buffer, sd), 0), 1)) < 1e-9


def test_staged_fixtures_write_only_what_is_read(spark, tmp_path):
    from suite.fixtures import Fixtures
    spark.sql("""select cast(id as bigint) as l_orderkey, id % 3 as l_suppkey, cast(id % 7 + 1 as int) as l_linenumber, 10D + id as l_quantity, 1000D + id as l_extendedprice, 0.05D as l_discount, 0.02D as l_tax,
      'R' as l_returnflag, 'F' as l_linestatus, timestamp_ntz'1995-01-15' as l_shipdate from range(30)""").write.parquet(str(tmp_path / "lineitem.parquet"))
    fx = Fixtures(spark, str(tmp_path)).staged
    assert fx.features.count() == 3 and "fx_panel" not in fx._made and fx.staged is fx
    panel = fx.view("fx_panel")
    assert panel.count() > 0 and fx.view("fx_panel") is panel and {"wide_m", "fx_panel"} <= set(fx._made)


def test_forests_of_a_large_share_score_like_their_written_trees(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(f"B{i % 30:02d}", f"P{i // 30}", anomaly.ONE, [float(v) for v in rng.normal(size=3).round(2)]) for i in range(900)], "bank_id string, period string, `group` string, x array<double>").repartition(3)
    specs = spark.createDataFrame([(anomaly.ONE, 0, 42, 675, 900), (anomaly.ONE, 1, 43, 900, 900)], anomaly.SPEC_DDL)
    trees = anomaly.grow_forests(rows, specs, 130).cache()
    key = lambda r: (r["bank_id"], r["period"], r["forest"])
    was, now = ({key(r): (r["raw_30"], r["raw_130"]) for r in df.collect()} for df in (anomaly.score_forests(rows, trees, specs, [30, 130]), anomaly.grow_and_score(rows, specs, 130, [30, 130])))
    trees.unpersist()
    assert len(was) == 1800 and was.keys() == now.keys()
    assert all(a == pytest.approx(now[k]) for k, a in was.items())


def test_a_tree_reads_a_column_for_each_node():
    """The tree is the one that the extremes of all columns give; where the drawn column doesn't vary, the next drawn one is taken."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 9)).round(1)
    x[:, ::2], x[:90] = np.where(rng.random((700, 5)) < 0.9, 0.5, x[:, ::2]), x[0]
    limit = 10
    tree, leaf = anomaly.grow(x, np.arange(700), np.random.default_rng([7, 1]), limit)
    draw, nodes, at = np.random.default_rng([7, 1]), [np.arange(700)], 0
    for depth in range(limit):
        lo, hi = (np.array([f(x[r], axis=0) for r in nodes]) for f in (np.min, np.max))
        f = (draw.random(lo.shape) * (hi > lo)).argmax(1)
        a, b = (v[np.arange(len(f)), f] for v in (lo, hi))
        c, after = np.maximum(a + draw.random(len(f)) * (b - a), np.nextafter(a, np.inf)), []
        for i, r in enumerate(nodes):
            assert tree[0][at + i] == (f[i] if b[i] > a[i] else -1) and (tree[0][at + i] < 0 or tree[1][at + i] == c[i])
            after += [r[x[r, f[i]] < c[i]], r[x[r, f[i]] >= c[i]]] if b[i] > a[i] else []
        nodes, at = after, at + len(nodes)
        if not nodes:
            break
    assert np.array_equal(tree[4][leaf], anomaly.path_lengths(x, tree))


def test_grid_holds_forests_that_no_task_takes(spark, monkeypatch):
    """Sample sizes beyond a task's rows were left out of the board."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4)).round(2)
    x[:, 0], x[:5] = np.where(rng.random(600) < 0.5, 0.0, x[:, 0]), x[:5] * 6
    wide = spark.createDataFrame([(f"B{i % 30:02d}", "b", f"P{i // 30}", *map(float, v)) for i, v in enumerate(x)], "bank_id string, bank_name string, period string, a double, b double, c double, d double").withColumn("period_ts", F.lit("2024-01-31").cast("date"))
    space, model = {"n_estimators": [20, 60], "max_samples": ["auto", 0.75], "contamination": [0.02, 0.05]}, config.MODEL | {"winsorize": None}
    whole = {(r["contamination"], r["n_estimators"], r["max_samples"]): r for r in tuning.tune_forest(wide, list("abcd"), space, model=model)[0].collect()}
    monkeypatch.setattr(anomaly, "MAX_TREE_SAMPLES", 300)
    monkeypatch.setattr(apart, "TASK_ROWS", 100)
    monkeypatch.setattr(apart, "ROUND_ROWS", 600 * 70)
    board = {(r["contamination"], r["n_estimators"], r["max_samples"]): r for r in tuning.tune_forest(wide, list("abcd"), space, model=model)[0].collect()}
    assert len(board) == 8 and board.keys() == whole.keys()
    assert all(abs(r["anomaly_rate_pct"] - whole[k]["anomaly_rate_pct"]) < 0.2 and abs(r["separation"] - whole[k]["separation"]) < 0.6 for k, r in board.items())


def test_forests_apart_score_like_those_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3)).round(2)
    x[:300] = 0.25  # a leaf of more rows than a task takes
    rows = spark.createDataFrame([(f"B{i % 30:02d}", f"P{i // 30}", anomaly.ONE, [float(v) for v in p]) for i, p in enumerate(x)], "bank_id string, period string, `group` string, x array<double>").repartition(3).cache()
    specs = [(anomaly.ONE, 0, 42, 675, 900), (anomaly.ONE, 3, 43, 900, 900)]
    one = anomaly.grow_and_score(rows, spark.createDataFrame(specs, anomaly.SPEC_DDL), 150, [50, 150])
    monkeypatch.setattr(apart, "TASK_ROWS", 120)
    tops = [apart.Top(f, t, s, n, 10) for _, f, s, n, _ in specs for t in range(3)]
    based = rows.withColumn("base", F.xxhash64("bank_id", "period"))
    apart.sample_ends(based, tops, 900)
    base = np.array([r["base"] for r in based.select("base").collect()])
    assert [int((apart.drawn(base, t.seed, t.tree) <= np.uint64(t.last)).sum()) for t in tops] == [675] * 3 + [900] * 3
    apart.grow_tops(based, tops, 3)
    assert all(max(t.feature) >= 0 and t.final and not t.asks for t in tops)
    monkeypatch.setattr(apart, "ROUND_ROWS", 900 * 80)  # four turns
    key = lambda r: (r["bank_id"], r["period"], r["forest"])
    was, now = ({key(r): (r["raw_50"], r["raw_150"]) for r in df.collect()} for df in (one, apart.grow_and_score(rows, specs, 150, [50, 150])))
    assert len(now) == 1800 and was.keys() == now.keys()
    keys = list(was)
    for i in (0, 1):
        a, b = (np.array([d[k][i] for k in keys]) for d in (was, now))
        assert np.corrcoef(a, b)[0, 1] > 0.98 and abs(a.mean() - b.mean()) < 0.01
    rows.unpersist()


def test_staged_features_and_monthly_table_are_one_table(spark, tmp_path, monkeypatch):
    """Both were aggregated from the lines and written; now the monthly table is read from the features, reported ratios included."""
    from prudens.plans import staging
    from suite.fixtures import Fixtures
    spark.sql("""select cast(id as bigint) as l_orderkey, id % 5 as l_suppkey, cast(id % 7 + 1 as int) as l_linenumber, 10D + id as l_quantity, 1000D + id * id as l_extendedprice, 0.05D as l_discount, 0.02D as l_tax,
      if(id % 2 = 0, 'R', 'N') as l_returnflag, 'F' as l_linestatus, timestamp_ntz'1995-01-15' + make_dt_interval(cast(id as int) % 200) as l_shipdate from range(90)""").write.parquet(str(tmp_path / "lineitem.parquet"))
    names, write = [], staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, name: names.append(name) or write(df, name))
    fx = Fixtures(spark, str(tmp_path))
    staged = fx.staged
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(staged.features) == rows(fx.features) and staged.features.columns == fx.features.columns
    wide = staged.view("wide_m")
    assert rows(wide) == rows(fx.view("wide_m")) and wide.columns == fx.view("wide_m").columns and wide.where("ldr is not null").count() > 0
    assert names == ["features"]


def test_a_staged_table_gives_its_shuffles_back(spark):
    import time
    from prudens.plans import staging
    before = spark.conf.get(staging.CLEANUP, None)

    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    had = shuffled()
    table = staging.stage(spark.range(5000).repartition(3, "id"), "t")
    for _ in range(50):  # files go in the background
        if not shuffled() - had:
            break
        time.sleep(0.2)
    assert not shuffled() - had and table.count() == 5000 and spark.conf.get(staging.CLEANUP, None) == before
