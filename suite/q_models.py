"""Anomaly detection, clustering, tuning, feedback, run log, reconciliation, text limits."""
from __future__ import annotations

from pyspark.sql import functions as F

from prudens import config
from prudens.functions.numeric import half_up
from prudens.functions.tables import literal_table
from prudens.operators import anomaly, cluster, feedback, matrix, textlimits, tuning
from prudens.plans.staging import stage
from prudens.sources.settings import effective_model
from suite.oracle import fragment, r, unpivot, values
from suite.q_features import RATIO_SQL, WIDE
from suite.q_findings import ALL_METRICS, findings_frame, validation_frame
from suite.q_scores import clusters_frame, labels_frame
from suite.registry import query

COLS = [c for c in WIDE if c != "ldr"] + list(RATIO_SQL)

# ------------------------------------------------------------- matrix
fragment("mx_every", unpivot("feat", "bank_id, bank_name, period, period_ts", COLS))
fragment("mx_long", "select * from mx_every where metric in (select metric from mx_every group by metric having avg(case when value is not null then 1.0::double else 0.0::double end) >= 0.3)")
fragment("mx_par", "select metric, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi, median(value) as med from mx_long group by metric")
fragment("mx_imp", "select l.bank_id, l.period, metric, case when value is null then med else least(greatest(value, lo), hi) end as x from mx_long l join mx_par using (metric)")
fragment("mx_scaled", "select i.bank_id, i.period, metric, (x - mu) / coalesce(nullif(sd, 0), 1) as z from mx_imp i join (select metric, avg(x) as mu, stddev_pop(x) as sd from mx_imp group by metric) using (metric)")


def _params(fx):
    return matrix.fit_matrix(fx.staged.features, COLS, config.MODEL["winsorize"])


@query("model_matrix_columns", "N01", "select metric, " + r("avg(case when value is not null then 1.0::double else 0.0::double end)") + " as non_null_share from mx_long group by metric having avg(case when value is not null then 1.0::double else 0.0::double end) >= 0.3")
def _cols(fx):
    from prudens.functions.reshape import to_long
    kept = [p.name for p in _params(fx)]
    return to_long(fx.features, [], kept).groupBy("metric").agg(half_up(F.avg(F.col("value").isNotNull().cast("double")), 4).alias("non_null_share"))


def _long(fx, expr):
    from prudens.functions.reshape import to_long
    params = _params(fx)
    wide = fx.staged.features.selectExpr("bank_id", "period", *[f"{expr(p)} as {p.name}" for p in params])
    return to_long(wide, ["bank_id", "period"], [p.name for p in params])


@query("model_winsorise_impute", "N02 N03", f"select bank_id, period, metric, {r('x')} as value from mx_imp")
def _imp(fx):
    return _long(fx, lambda p: p.imputed()).withColumn("value", half_up("value", 4))


@query("model_scale", "N04", f"select bank_id, period, metric, {r('z')} as value from mx_scaled")
def _scale(fx):
    return _long(fx, lambda p: p.scaled()).withColumn("value", half_up("value", 4))


_TZ = "floor(abs(z) * 10 + 0.5)"
@query("model_top_features", "N07", f"""
select bank_id, period, string_agg(metric || '(' || case when z < 0 then '-' else '+' end || cast(cast(floor({_TZ} / 10) as bigint) as varchar) || '.' || cast(cast({_TZ} as bigint) % 10 as varchar) || ')', '; ' order by k) as top_features
from (select *, row_number() over (partition by bank_id, period order by floor(abs(z) * 1e6 + 0.5) desc, list_position([{', '.join(repr(c) for c in COLS)}], metric)) as k from mx_scaled) where k <= 6 group by bank_id, period""")
def _top(fx):
    params = _params(fx)
    m = matrix.scaled_matrix(fx.staged.features, params)
    return anomaly.top_features(m, [p.name for p in params], 6).select("bank_id", "period", "top_features")


def _rows(fx):
    """The scaled matrix as arrays, and the size of the table."""
    params = _params(fx)
    return anomaly.as_arrays(matrix.scaled_matrix(fx.staged.features, params), [p.name for p in params]), fx.staged.features.count()


@query("isolation_forest_nodes", "N05")
def _forest(fx):
    rows, n = _rows(fx)
    specs = literal_table(fx.spark, anomaly.SPEC_DDL, [(anomaly.ONE, 0, 42, anomaly.sample_size("auto", n), n)])
    return anomaly.grow_forests(rows, specs, config.MODEL["forest"]["n_estimators"]).select("tree", F.size("feature").alias("n_nodes"))


@query("isolation_forest_scores", "N06")
def _scores(fx):
    return anomaly.isolation_forest(fx.features, COLS)


# a forest that both engines know: (tree, node, column, cut, left, right, rows in the leaf, depth), cuts in original units
FIXED_TREES = [(0, 0, "ldr", 100.0, 1, 2, 0, 0), (0, 1, "npl_ratio", 2.5, 3, 4, 0, 1), (0, 2, None, 0.0, -1, -1, 30, 1), (0, 3, None, 0.0, -1, -1, 200, 2), (0, 4, None, 0.0, -1, -1, 26, 2),
               (1, 0, "cir", 12.0, 1, 2, 0, 0), (1, 1, None, 0.0, -1, -1, 2, 1), (1, 2, "roa", 0.1, 3, 4, 0, 1), (1, 3, None, 0.0, -1, -1, 1, 2), (1, 4, None, 0.0, -1, -1, 253, 2)]
FIXED_COLS = ["ldr", "npl_ratio", "cir", "roa"]
_NORM = "(case when {n} > 2 then 2 * (ln({n} - 1.0::double) + 0.57721566490153286::double) - 2 * ({n} - 1.0::double) / {n} when {n} = 2 then 1 else 0 end)"


def _leaf(tree: int, node: int) -> str:
    _, _, col, cut, left, right, size, depth = next(t for t in FIXED_TREES if t[:2] == (tree, node))
    return f"({depth} + {_NORM.format(n=size)})" if col is None else f"case when {col} < {cut} then {_leaf(tree, left)} else {_leaf(tree, right)} end"


fragment("fixed_raw", f"select bank_id, period, round(power(2.0::double, -(({_leaf(0, 0)}) + ({_leaf(1, 0)})) / 2 / {_NORM.format(n=256)}), 9) as raw from feat where " + " and ".join(f"{c} is not null" for c in FIXED_COLS))


@query("isolation_forest_fixed", "N06", f"""select bank_id, period, {r('raw')} as raw, {r('case when hi > lo then (raw - lo) / (hi - lo) * 100 else 0 end', 2)} as anomaly_score, cast(raw > cut as int) as anomaly_label,
  cast(floor((select count(*) from fixed_raw b where b.raw > a.raw) + ((select count(*) from fixed_raw b where b.raw = a.raw) + 1) / 2.0::double) as bigint) as anomaly_rank
from fixed_raw a, (select min(raw) as lo, max(raw) as hi, quantile_cont(raw, 0.92) as cut from fixed_raw)""")
def _fixed(fx):
    """Scores, labels and ranks under trees that SQL knows too."""
    trees = []
    for tree in (0, 1):
        nodes = [t for t in FIXED_TREES if t[0] == tree]
        lengths = [float(t[7] + anomaly.path_norm(t[6])) for t in nodes]
        trees.append((anomaly.ONE, 0, 256, tree, [-1 if t[2] is None else FIXED_COLS.index(t[2]) for t in nodes], [t[3] for t in nodes], [t[4] for t in nodes], [t[5] for t in nodes], lengths))
    known = fx.staged.features.where(" and ".join(f"{c} is not null" for c in FIXED_COLS))
    rows = anomaly.as_arrays(known, FIXED_COLS)
    specs = literal_table(fx.spark, anomaly.SPEC_DDL, [(anomaly.ONE, 0, 0, 256, 1000)])
    scored = anomaly.score_forests(rows, fx.spark.createDataFrame(trees, anomaly.TREES_DDL), specs, [2]).select("bank_id", "period", F.round("raw_2", 9).alias("raw"))
    return anomaly.normalise_scores(scored.withColumn("shown", half_up("raw", 4)), "raw", 0.08).withColumnRenamed("shown", "raw")


@query("peer_group_forest", "N08")
def _peer(fx):
    f = fx.features.join(clusters_frame(fx).select("bank_id", "cluster_id"), "bank_id")
    return anomaly.peer_group_forest(f, "cluster_id", COLS)


@query("peer_group_matrix", "N08", """
select bank_id, period, peer, cast(sum(floor((x - mu) / coalesce(nullif(sd, 0), 1) * 10000 + 0.5)) as bigint) as total_z, count(*) as n_columns from (select *, avg(x) over g as mu, stddev_pop(x) over g as sd from (
  select *, case when value is null then med else least(greatest(value, lo), hi) end as x from (select l.*, peer from mx_every l join fx_inst using (bank_id))
  join (select peer, metric, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi, median(value) as med from mx_every join fx_inst using (bank_id) group by peer, metric
        having avg(case when value is not null then 1.0::double else 0.0::double end) >= 0.3) using (peer, metric)) window g as (partition by peer, metric))
group by bank_id, period, peer""")
def _peer_matrix(fx):
    """Each group's own winsorising, medians and scale, in ten-thousandths summed over a row."""
    f = stage(fx.features.select(*config.ID_COLS, *COLS).join(clusters_frame(fx).select("bank_id", F.col("cluster_id").alias("peer")), "bank_id"), "peers")
    total = F.aggregate("x", F.lit(0).cast("long"), lambda t, v: t + F.floor(v * 10000 + 0.5))
    return matrix.grouped_matrix(f, "peer", COLS, config.MODEL).select("bank_id", "period", "peer", total.alias("total_z"), F.size("x").cast("long").alias("n_columns"))


# ------------------------------------------------------------- clustering
fragment("feat_last", "select * from feat where (bank_id, period_ts) in (select bank_id, max(period_ts) from feat group by bank_id)")


@query("latest_snapshot", "K01", f"select bank_id, period, {r('ldr')} as ldr from feat_last")
def _snap(fx):
    return cluster.latest_snapshot(fx.features).select("bank_id", "period", half_up("ldr", 4).alias("ldr"))


fragment("km_every", unpivot("feat_last", "bank_id", COLS))
fragment("km_long", "select * from km_every where metric in (select metric from km_every group by metric having avg(case when value is not null then 1.0::double else 0.0::double end) >= 0.3)")
fragment("km_z", "select bank_id, metric, (x - mu) / coalesce(nullif(sd, 0), 1) as z from (select bank_id, metric, coalesce(value, med) as x from km_long join (select metric, median(value) as med from km_long group by metric) using (metric)) join (select metric, avg(x) as mu, stddev_pop(x) as sd from (select metric, coalesce(value, med) as x from km_long join (select metric, median(value) as med from km_long group by metric) using (metric)) group by metric) using (metric)")


def _km_matrix(fx):
    snap = stage(cluster.latest_snapshot(fx.features.select(*config.ID_COLS, *COLS)), "snapshot")
    params = matrix.fit_matrix(snap, COLS, None)
    return matrix.scaled_matrix(snap, params), [p.name for p in params]


@query("cluster_matrix", "K02", f"select bank_id, metric, {r('z')} as value from km_z")
def _kmx(fx):
    from prudens.functions.reshape import to_long
    m, cols = _km_matrix(fx)
    return to_long(m, ["bank_id"], cols).withColumn("value", half_up("value", 4))


def _points(fx):
    return stage(cluster.as_points(*_km_matrix(fx)), "points")


def _clustered(fx):
    points, p = _points(fx), config.MODEL["kmeans"]
    return cluster.assign(points, cluster.best_fit(points, 3, 42, p["n_init"], p["max_iter"]).centres)


@query("kmeans_labels", "K03")
def _kml(fx):
    return _clustered(fx).select("bank_id", "cluster_id")


@query("kmeans_fixed_centres", "K03", """select bank_id, arg_min(cluster_id, (floor(sq * 1e6 + 0.5), cluster_id)) as cluster_id from (
  select z.bank_id, c.cluster_id, sum((z.z - c.c) * (z.z - c.c)) as sq from km_z z join km_cent c using (metric) group by all) group by bank_id""")
def _fixed_centres(fx):
    """One assignment to the means of given groups, which SQL can follow."""
    m, cols = _km_matrix(fx)
    lab = m.join(clusters_frame(fx).select("bank_id", "cluster_id"), "bank_id")
    found = lab.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in cols]).orderBy("cluster_id").collect()  # a row for each group
    out = cluster.assign(cluster.as_points(m, cols), [[r[c] for c in cols] for r in found])
    return out.select("bank_id", F.element_at(F.lit([r["cluster_id"] for r in found]), F.col("cluster_id") + 1).alias("cluster_id"))


@query("kmeans_silhouette", "K04", """
select bank_id, cluster_id, """ + r("case when n < 2 then 0 when a < b then 1 - a / b when a > b then b / a - 1 else 0 end") + """ as silhouette from (
  select bank_id, cluster_id, any_value(own_n) as n, max(case when other = cluster_id then d * k / (k - 1) end) as a, min(case when other <> cluster_id then d end) as b from (
    select x.bank_id, x.cluster_id, y.cluster_id as other, any_value(x.n) as own_n, count(distinct y.bank_id) as k, sum((x.z - y.z) * (x.z - y.z)) / count(distinct y.bank_id) as d
    from (select *, count(*) over (partition by cluster_id, metric) as n from km_lab) x join km_lab y on x.metric = y.metric group by x.bank_id, x.cluster_id, y.cluster_id)
  group by bank_id, cluster_id)""")
def _sil(fx):
    """Each bank's silhouette under given groups; the oracle compares all pairs."""
    points = _points(fx).join(clusters_frame(fx).select("bank_id", "cluster_id"), "bank_id")
    return cluster.silhouettes(points).select("bank_id", "cluster_id", half_up("silhouette", 4).alias("silhouette"))


fragment("km_lab", "select bank_id, metric, z, peer as cluster_id from km_z join fx_inst using (bank_id)")
fragment("km_cent", "select cluster_id, metric, avg(z) as c, count(*) as n from km_lab group by cluster_id, metric")
fragment("km_dist", "select bank_id, cluster_id, sum((z - c) * (z - c)) as sq from km_lab join km_cent using (cluster_id, metric) group by bank_id, cluster_id")


fragment("km_spread", "select cluster_id, avg(sqrt(sq)) as s from km_dist group by cluster_id")
fragment("km_gap", "select a.cluster_id as i, b.cluster_id as j, sqrt(sum((a.c - b.c) * (a.c - b.c))) as d from km_cent a join km_cent b on a.metric = b.metric and a.cluster_id <> b.cluster_id group by 1, 2")


def _labelled(fx):
    m, cols = _km_matrix(fx)
    return m.join(clusters_frame(fx).select("bank_id", "cluster_id"), "bank_id"), cols


@query("cluster_davies_bouldin", "K05", "select " + r("avg(m)") + " as davies_bouldin from (select i, max((x.s + y.s) / d) as m from km_gap join km_spread x on x.cluster_id = i join km_spread y on y.cluster_id = j group by i)")
def _db(fx):
    return cluster.davies_bouldin(*_labelled(fx)).withColumn("davies_bouldin", half_up("davies_bouldin", 4))


@query("cluster_calinski_harabasz", "K06", "select " + r("(b / (k - 1)) / (w / (n - k))") + " as calinski_harabasz from (select sum(n * (c - m) * (c - m)) as b, count(distinct cluster_id) as k from km_cent join (select metric, avg(z) as m from km_lab group by metric) using (metric)), (select sum(sq) as w, count(*) as n from km_dist)")
def _ch(fx):
    return cluster.calinski_harabasz(*_labelled(fx)).withColumn("calinski_harabasz", half_up("calinski_harabasz", 4))


@query("kmeans_k_selection", "K07")
def _selk(fx):
    board, _ = tuning.tune_kmeans(fx.features, COLS)
    return board


PROF = [c for c in config.CLUSTER_PROFILE_METRICS]
fragment("prof", "select peer as cluster_id, count(*) as n_banks, " + ", ".join(f"avg({c}) as {c}" for c in PROF) + " from feat_last join fx_inst using (bank_id) group by peer")


def _prof(fx):
    return cluster.profiles(cluster.latest_snapshot(fx.features), clusters_frame(fx), PROF)


@query("cluster_profiles", "K08", "select cluster_id, n_banks, " + ", ".join(f"{r(c)} as {c}" for c in PROF) + " from prof")
def _profiles(fx):
    return _prof(fx).select("cluster_id", "n_banks", *[half_up(c, 4).alias(c) for c in PROF])


_NORMS = [f"(case when hi_{m} <> lo_{m} then " + (f"({m} - lo_{m}) / (hi_{m} - lo_{m})" if s > 0 else f"1 - ({m} - lo_{m}) / (hi_{m} - lo_{m})") + " else 0 end)" for m, s in config.CLUSTER_PROFILE_METRICS.items()]
fragment("prof_risk", "select cluster_id, " + r("(" + " + ".join(_NORMS) + ") / nullif(" + " + ".join(f"cast(coalesce(hi_{m} <> lo_{m}, false) as int)" for m in PROF) + ", 0) * 100", 1)
         + " as cluster_risk_score from prof, (select " + ", ".join(f"min({m}) as lo_{m}, max({m}) as hi_{m}" for m in PROF) + " from prof)")


@query("cluster_risk_score", "K09", "select * from prof_risk")
def _risk(fx):
    return cluster.composite_risk(_prof(fx)).select("cluster_id", "cluster_risk_score")


_TAGS = ", ".join("case when " + " or ".join([f"{m} >= h_{m}" for m in hi if m in PROF] + [f"{m} <= l_{m}" for m in lo if m in PROF]) + f" then '{t}' end" for t, hi, lo in cluster.RISK_TAGS)


@query("cluster_risk_label", "K10", f"select cluster_id, case when concat_ws(', ', {_TAGS}) = '' then '{cluster.SAFE_TAG}' else concat_ws(', ', {_TAGS}) end as cluster_risk_label from prof, (select "
       + ", ".join(f"quantile_cont({m}, 0.66) as h_{m}, quantile_cont({m}, 0.34) as l_{m}" for m in PROF) + " from prof)")
def _lab(fx):
    return cluster.risk_labels(_prof(fx)).select("cluster_id", "cluster_risk_label")


@query("cluster_projection", "K11")
def _pca(fx):
    return cluster.project_2d(_clustered(fx).drop("cluster_id"))


@query("cluster_stability", "K12", "select " + r("avg(case when peer = peer2 then 1.0::double else 0.0::double end)") + " as stability, count(*) as n_common from (select bank_id, peer, case when cast(substr(bank_id, 2) as int) % 4 = 0 then (peer + 1) % 3 else peer end as peer2 from fx_inst)")
def _stab(fx):
    before = clusters_frame(fx)
    after = before.select("bank_id", F.when(F.substring("bank_id", 2, 6).cast("int") % 4 == 0, (F.col("cluster_id") + 1) % 3).otherwise(F.col("cluster_id")).alias("cluster_id"))
    return cluster.assignment_stability(before, after)


# ------------------------------------------------------------- feedback and tuning
fragment("fb_known", "select * from fx_feedback where label in ('confirmed_anomaly', 'false_positive')")
_RATE = "count(*) as n_labelled, count(*) filter (label = 'false_positive') as n_false, " + r("count(*) filter (label = 'false_positive') / count(*)::double") + " as fp_rate"
fragment("fp_stats", f"""
select 'overall' as scope, cast(null as varchar) as key, {_RATE} from fb_known union all select 'source', source, {_RATE} from fb_known group by source
union all select 'metric', metric, {_RATE} from fb_known where metric is not null group by metric""")


@query("feedback_fp_stats", "B01", "select * from fp_stats")
def _fp(fx):
    return feedback.false_positive_stats(fx.view("fx_feedback"))


@query("feedback_suggestions", "B02", f"""
select target, current, suggested from (
  select 'forest.contamination' as target, '0.08' as current, case when fp_rate >= 0.4 then '0.06' when fp_rate <= 0.1 then '0.1' end as suggested from fp_stats where scope = 'overall'
  union all select 'rule_severity:' || ids, 'as configured', 'review / soften (non-legal)' from fp_stats join (select metric, string_agg(rule_id, ',' order by rule_id) as ids
     from (select rule_id, metric from flat_rule where not (severity = 'CRITICAL' and status = 'ACTIVE') union all select rule_id, metric from tier_rule where not (severity = 'CRITICAL' and status = 'ACTIVE')) group by metric) on key = metric where scope = 'metric' and fp_rate >= 0.5
  union all select 'legal_rules', (select string_agg(rule_id, ',' order by rule_id) from (select rule_id from flat_rule where severity = 'CRITICAL' and status = 'ACTIVE' union all select rule_id from tier_rule where severity = 'CRITICAL' and status = 'ACTIVE')), 'never changed automatically' from fp_stats where scope = 'overall')
where suggested is not null""")
def _sug(fx):
    return feedback.suggestions(fx.view("fx_feedback")).select("target", "current", "suggested")


@query("forest_grid_search", "B03")
def _grid(fx):
    return tuning.tune_forest(fx.features, COLS, feedback=fx.view("fx_feedback"))[0]


# three score columns play three seeds; all contaminations of the default grid
_SEEDS = {0: "round(ldr, 6)", 1: "round(ldr + npl_ratio, 6)", 2: "round(ldr * 2 - cir, 6)"}
fragment("grid_score", " union all ".join(f"select bank_id, period, {i} as seed, {e} as raw from feat where ldr is not null and npl_ratio is not null and cir is not null" for i, e in _SEEDS.items()))
fragment("grid_cell", "select c, seed, bank_id, period, raw, cast(raw > cut as int) as f from grid_score join (" + " union all ".join(
    f"select seed, {c}::double as c, quantile_cont(raw, {1 - c}) as cut from grid_score group by seed" for c in tuning.FOREST_GRID["contamination"]) + ") using (seed)")


@query("forest_grid_fixed", "B03 B04", f"""
select contamination, 100 as n_estimators, 'auto' as max_samples, {r('rate', 2)} as anomaly_rate_pct, {r('stability')} as stability, {r('separation')} as separation, {r('2 * tp / nullif(2 * tp + fp + fn, 0)::double')} as feedback_f1, feedback_n
from (select c as contamination, avg(f0) * 100 as rate, (avg(cast(f0 = f1 as int)) + avg(cast(f0 = f2 as int)) + avg(cast(f1 = f2 as int))) / 3 as stability, (avg(s) filter (f0 = 1) - avg(s) filter (f0 = 0)) / stddev_pop(s) as separation,
    count(truth) as feedback_n, count(*) filter (f0 = 1 and truth = 1) as tp, count(*) filter (f0 = 1 and truth = 0) as fp, count(*) filter (f0 = 0 and truth = 1) as fn
  from (select c, bank_id, period, max(raw) filter (seed = 0) as s, max(f) filter (seed = 0) as f0, max(f) filter (seed = 1) as f1, max(f) filter (seed = 2) as f2 from grid_cell group by c, bank_id, period) left join fb_truth using (bank_id, period) group by c)""")
def _grid_fixed(fx):
    """The one-sweep measures over scores that SQL knows too."""
    f = fx.staged.features.where("ldr is not null and npl_ratio is not null and cir is not null")
    cells = ", ".join(f"struct(int({i}) as seed, {e} as raw)" for i, e in _SEEDS.items())
    scored = f.selectExpr("bank_id", "period", "'auto' as samples", "100 as trees", f"inline(array({cells}))")
    out = tuning.forest_measures(scored, tuning.FOREST_GRID["contamination"], tuning.feedback_labels(fx.view("fx_feedback")))
    return out.select("contamination", "n_estimators", "max_samples", half_up("anomaly_rate_pct", 2).alias("anomaly_rate_pct"), *[half_up(c, 4).alias(c) for c in ("stability", "separation", "feedback_f1")], "feedback_n")


fragment("fl3", "select bank_id, period, ldr, cast(ldr > 130 as int) as f0, cast(ldr > 120 as int) as f1, cast(npl_ratio > 3.5 as int) as f2 from feat where ldr is not null")
fragment("fb_truth", "select bank_id, period, cast(arg_max(label, (feedback_ts, event_id)) = 'confirmed_anomaly' as int) as truth from fb_known where source = 'anomaly' group by bank_id, period")


@query("tuning_measures", "B04", f"""
select {r('stability')} as stability, {r('separation')} as separation, {r('2 * tp / nullif(2 * tp + fp + fn, 0)::double')} as feedback_f1, feedback_n
from (select (avg(cast(f0 = f1 as int)) + avg(cast(f0 = f2 as int)) + avg(cast(f1 = f2 as int))) / 3 as stability, (avg(ldr) filter (f0 = 1) - avg(ldr) filter (f0 = 0)) / stddev_pop(ldr) as separation from fl3),
  (select count(*) as feedback_n, count(*) filter (f0 = 1 and truth = 1) as tp, count(*) filter (f0 = 1 and truth = 0) as fp, count(*) filter (f0 = 0 and truth = 1) as fn from fl3 join fb_truth using (bank_id, period))""")
def _measures(fx):
    flags = fx.features.where("ldr is not null").selectExpr("bank_id", "period", "ldr", "int(ldr > 130) as f0", "int(ldr > 120) as f1", "int(npl_ratio > 3.5D) as f2")
    parts = tuning.label_agreement(flags, ["f0", "f1", "f2"]).crossJoin(tuning.score_separation(flags, "ldr", "f0")).crossJoin(
        tuning.feedback_f1(flags, tuning.feedback_labels(fx.view("fx_feedback")), "f0"))
    return parts.select(*[half_up(c, 4).alias(c) for c in ("stability", "separation", "feedback_f1")], "feedback_n")


@query("kmeans_grid_search", "B05")
def _kgrid(fx):
    return tuning.tune_kmeans(fx.features, COLS, {"n_init": [1, 5, 10]}, "calinski_harabasz")[0]


@query("tuned_parameters_applied", "B06")
def _tuned(fx):
    """Scores under the tuned overlay: fewer labels than the base contamination gives."""
    model = effective_model(config.MODEL, tuning.tuned_overlay({"contamination": 0.03, "n_estimators": 200}))
    out = anomaly.isolation_forest(fx.features, COLS, model)
    return out.groupBy("anomaly_label").agg(F.count(F.lit(1)).alias("n"))


_MISSING = " + ".join(f"(case when {m} is null then 1 else 0 end)" for m in ALL_METRICS)


@query("run_record", "B07", f"""
select * from (select count(*) as n_records_panel from fx_panel), (select count(distinct bank_id) as n_banks, count(distinct period) as n_periods, {r(f'avg(({_MISSING}) / {len(ALL_METRICS)}.0::double) * 100', 2)} as missing_data_pct from feat),
  (select count(*) filter (severity = 'CRITICAL') as n_critical, count(*) filter (severity = 'HIGH') as n_high, count(*) filter (severity = 'MEDIUM') as n_medium, count(*) filter (severity = 'DATA_GAP') as n_data_gap from finding),
  (select {r('avg(cast(anomaly_label as double)) * 100', 2)} as anomaly_rate_pct from std_label), (select {r('(select count(*) from validation) / count(*)::double')} as validation_error_rate from feat)""")
def _record(fx):
    fx = fx.staged
    return feedback.run_record(fx.view("fx_panel"), fx.features, ALL_METRICS, findings_frame(fx), labels_frame(fx), validation_frame(fx)).drop("model_version", "config_version")


@query("dataset_reconciliation", "B08", """
select 'panel' as dataset, n_baseline, n_computed, only_baseline, only_computed, """ + r("least(n_baseline, n_computed) / greatest(n_baseline, n_computed)::double * 100", 2) + """ as match_rate_pct from
(select count(*) as n_baseline from fx_panel), (select count(*) as n_computed from panel_last),
(select count(*) as only_baseline from (select bank_id, period, metric_name, load_order from fx_panel except all select bank_id, period, metric_name, load_order from panel_last)),
(select count(*) as only_computed from (select bank_id, period, metric_name, load_order from panel_last except all select bank_id, period, metric_name, load_order from fx_panel))""")
def _recon(fx):
    from prudens.sources.panel import dedup_last
    p = fx.view("fx_panel").select("bank_id", "period", "metric_name", "load_order", "frequency")
    key = ["bank_id", "period", "metric_name", "load_order"]
    return feedback.reconcile({"panel": p.select(*key)}, {"panel": dedup_last(p).select(*key)})


# ------------------------------------------------------------- text limits
# documents carry no Vietnamese limits, so the given prose is interleaved with limit sentences
_SENT = ["Tỷ lệ an toàn vốn tối thiểu không thấp hơn 8%.", "Dư nợ cho vay so với tổng tiền gửi tối đa 85 %;", "Nợ xấu ở mức 3,5% tổng dư nợ.", "Góp vốn, mua cổ phần không vượt quá 40%.",
         "Ngân hàng và tổ chức tín dụng thực hiện theo thông tư.", "Báo cáo VAMC hằng quý.", "Tỷ lệ dự trữ thanh khoản tối thiểu là 10%."]
_TXT = "concat(text, '. ', case doc_id % 7 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_SENT)) + " end, chr(10), ' ', case (doc_id + 3) % 7 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_SENT)) + " end)"
# two whole pages of each document; every fiftieth has ten pages, and every 97th is blank throughout
_PAGES = (f"select doc_id, cast(1 as int) as page, case when doc_id % 97 = 1 then concat(chr(10), ' ', chr(9)) else {_TXT} end as text from {{d}} union all select doc_id, 2, case when doc_id % 5 = 0 or doc_id % 97 = 1 then '' else text end from {{d}} "
          f"union all select doc_id, 3 + k, case when doc_id % 97 = 1 then '' when k = 7 then {_TXT} else concat(' ', chr(10)) end from {{d}} cross join (select * from (values (0), (1), (2), (3), (4), (5), (6), (7)) as t(k)) where doc_id % 50 = 0")
fragment("limit_kw", values([(i, *k) for i, k in enumerate(config.LIMIT_KEYWORDS)], "ord, kw, metric, rule_id"))
_VN = "trim(regexp_replace(lower(strip_accents(replace(replace({}, 'đ', 'd'), 'Đ', 'D'))), '\\s+', ' ', 'g'))"
fragment("lim_pages", _PAGES.format(d="documents"))
fragment("lim_cand", f"""
select doc_id, page, regexp_replace(chunk, '^\\s+|\\s+$', '', 'g') as extracted_text, metric as candidate_metric, candidate_threshold, c / 100.0::double as confidence, rule_id as suggested_rule_id, case when c < 80 then 'REVIEW_REQUIRED' else 'CANDIDATE_OK' end as status
from (select *, least(55 + case when candidate_threshold is not null then 20 else 0 end + case when {' or '.join(f"contains(n, '{w}')" for w in config.LIMIT_BOUND_WORDS)} then 15 else 0 end, 95) as c,
  from (select doc_id, page, chunk, n, try_cast(replace(regexp_extract(chunk, '(\\d{{1,3}}(?:[.,]\\d{{1,2}})?)\\s*%', 1), ',', '.') as double) as candidate_threshold, arg_min(metric, ord) as metric, arg_min(rule_id, ord) as rule_id
    from (select *, {_VN.format('chunk')} as n, row_number() over () as id from (select doc_id, page, unnest(string_split_regex(regexp_replace(text, '([.\\n;])\\s+', '\\1' || chr(1), 'g'), chr(1))) as chunk from lim_pages)) join limit_kw on contains(n, kw) group by id, doc_id, page, chunk, n))""")


def pages_fixture(fx):
    return fx.spark.sql(_PAGES.format(d="{d}"), d=fx.table("documents"))


@query("text_candidate_limits", "B09", "select * from lim_cand")
def _cand(fx):
    return textlimits.candidate_limits(pages_fixture(fx)).drop("pos")


_COMMON = " + ".join(f"len(regexp_extract_all({_VN.format('text')}, '{w}'))" for w in config.COMMON_LEGAL_WORDS)
fragment("lim_doc", f"""
select doc_id, count(*) as n_pages, count(*) filter (chars > 0) as pages_with_text, cast(sum(chars) as bigint) as total_chars, sum(chars) > 0 and (sum(length(text)) < 50 or (not bool_or(hit) and sum(common) < 2)) as garbled
from (select *, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as chars, {' or '.join(f"contains({_VN.format('text')}, '{k[0]}')" for k in config.LIMIT_KEYWORDS)} as hit, {_COMMON} as common from lim_pages) group by doc_id""")


@query("text_file_status", "B10", """
select d.doc_id, n_pages, pages_with_text, total_chars, garbled, case when total_chars = 0 then 'LOW_CONFIDENCE_NO_TEXT' when garbled then 'LOW_CONFIDENCE_GARBLED' else 'OK' end as status,
  case when total_chars = 0 or garbled then 0 else coalesce(n, 0) end as n_candidates from lim_doc d left join (select doc_id, count(*) as n from lim_cand group by doc_id) using (doc_id)""")
def _status(fx):
    return textlimits.file_status(pages_fixture(fx))
