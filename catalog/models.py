"""Reduction, models, stacking, the forecast run and its checks."""

from functools import reduce

from pyspark.sql import functions as F

from catalog.combination import CORR, both
from catalog.forecast import CRITERIA, KEY, PAIRS, PRED, SAW, SYM, components, forecasts, intervals
from catalog.ranking import BIG, panel_of
from catalog.registry import query
from oracle.base import INDICATORS, avg_rank, critic, long, r
from panelwise.operators import adaptive as A
from panelwise.operators import evaluate as E
from panelwise.operators import features as X
from panelwise.operators import models as M
from panelwise.operators import moment_fits as K
from panelwise.operators import reduce as L
from panelwise.operators import stability as H
from panelwise.operators import stacking as S
from panelwise.operators.local_intervals import locally_weighted
from panelwise.operators.scaling import apply_yeo_johnson, fit_yeo_johnson, global_min_max, undo_yeo_johnson
from panelwise.operators.tube_fit import epsilon_insensitive
from panelwise.panel import to_long
from panelwise.plans import forecast as Q
from panelwise.plans import ranking as R
from panelwise.operators import combine as B
from panelwise.operators.critic import two_level_weights
from panelwise.session import settle
from panelwise.sources.tables import table

CLEAN = "WITH " + long(gaps=False)
BASE = ["last", "mean", "ewma"]


def scaled_components(spark, folder):
    """Criterion scores scaled per period, on the dense grid."""
    grid = components(spark, folder)
    return settle(X.saw_targets(grid, CRITERIA))


# ---------------------------------------------------------------- reduction


@query("variance_threshold", f"""{CLEAN}, u AS (SELECT indicator, (value - min(value) OVER g) / (max(value) OVER g - min(value) OVER g) AS v FROM obs WINDOW g AS (PARTITION BY indicator))
SELECT indicator AS feature, {r("var_pop(v)")} AS variance, var_pop(v) > 0.03 AS kept FROM u GROUP BY indicator""")
def variance_threshold(spark, folder):
    panel = panel_of(spark, folder, False)
    return L.variances(global_min_max(panel.data, panel.indicators), panel.indicators, threshold=0.03)


@query("standardised_features", f"""{CLEAN} SELECT entity, {BIG}, indicator, {r("(value - avg(value) OVER g) / CASE WHEN stddev_pop(value) OVER g = 0 THEN 1 ELSE stddev_pop(value) OVER g END")} AS value FROM obs WINDOW g AS (PARTITION BY indicator)""")
def standardised_features(spark, folder):
    panel = panel_of(spark, folder, False)
    return to_long(E.standardised(panel.data, panel.indicators), panel.indicators)


MI_F, MI_T = INDICATORS[:5], INDICATORS[5:]


def mi_sql(bins=8):
    def coded(name, items):
        levels = ", ".join(str(i / bins) for i in range(1, bins))
        return f"""{name}_e AS (SELECT indicator, quantile_cont(round(value, 9), [{levels}]) AS q FROM obs WHERE indicator IN ({", ".join(f"'{i}'" for i in items)}) GROUP BY indicator),
{name} AS (SELECT entity, period, indicator, len(list_filter(q, lambda x: round(value, 9) > x)) AS b FROM obs JOIN {name}_e USING (indicator))"""
    return f"""{CLEAN}, {coded("fa", MI_F)}, {coded("ta", MI_T)},
j AS (SELECT fa.indicator AS feature, ta.indicator AS target, fa.b AS a, ta.b AS b, count(*)::DOUBLE AS n FROM fa JOIN ta USING (entity, period) GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY feature, target) AS t, sum(n) OVER (PARTITION BY feature, target, a) AS na, sum(n) OVER (PARTITION BY feature, target, b) AS nb FROM j)
SELECT feature, target, {r("sum(n / t * ln(n * t / (na * nb)))")} AS mi FROM m GROUP BY feature, target"""


@query("mutual_information", mi_sql())
def mutual_information(spark, folder):
    panel = panel_of(spark, folder, False)
    return L.mutual_information(panel.data, MI_F, MI_T, ["entity", "period"])


@query("informative_features", f"""SELECT DISTINCT feature FROM ({mi_sql()}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY mi DESC, feature) <= 2""")
def informative_features(spark, folder):
    panel = panel_of(spark, folder, False)
    return L.informative(L.mutual_information(panel.data, MI_F, MI_T, ["entity", "period"]), 2)


@query("principal_components")
def principal_components(spark, folder):
    panel = panel_of(spark, folder, False)
    rows = settle(Q.standard_panel(panel.data, panel.indicators))
    loadings, names = L.principal_components(rows, panel.indicators)
    return L.project(rows, panel.indicators, loadings, names, ["entity", "period"])


@query("component_importance")
def component_importance(spark, folder):
    """Shares of variance of the components mapped back to the indicators."""
    panel = panel_of(spark, folder, False)
    rows = settle(Q.standard_panel(panel.data, panel.indicators))
    loadings, names = L.principal_components(rows, panel.indicators)
    scores = L.project(rows, panel.indicators, loadings, names, [])
    var = scores.agg(*[F.var_pop(n).alias(n) for n in names]).first()
    back = L.back_to_features(loadings, [var[n] for n in names], panel.indicators)
    return Q.importance_table(spark, back)


@query("least_squares_projection")
def least_squares_projection(spark, folder):
    panel = panel_of(spark, folder, False)
    rows = settle(Q.standard_panel(panel.data, panel.indicators))
    x, y = panel.indicators[:6], panel.indicators[6:]
    weights = L.partial_least_squares(rows, x, y, 3)
    return L.project(rows, x, weights, [f"t{i + 1}" for i in range(weights.shape[1])], ["entity", "period"])


@query("distinct_features")
def distinct_features(spark, folder):
    """Indicators left after dropping near-twins and inflated ones."""
    panel = panel_of(spark, folder, False)
    kept = L.keep_distinct(Q.standard_panel(panel.data, panel.indicators), panel.indicators)
    counts = panel.data.agg(*[F.count(c).alias(c) for c in panel.indicators])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(c in kept).alias("kept"), F.col(c).alias("n")) for c in panel.indicators])
    return counts.select(F.inline(cells))


@query("target_power_transform")
def target_power_transform(spark, folder):
    panel = panel_of(spark, folder, False)
    fit = fit_yeo_johnson(panel.data, "I12")
    z = apply_yeo_johnson(F.col("I12"), fit)
    return panel.data.select("entity", "period", z.alias("z"), undo_yeo_johnson(z, fit).alias("back"))


# ----------------------------------------------------------------- stacking

SCORE = f"""{PRED}, sc AS MATERIALIZED (SELECT component, model, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) AS r2 FROM k GROUP BY ALL),
sm AS MATERIALIZED (SELECT component, model, exp((r2 - max(r2) OVER g) / 0.1) / sum(exp((r2 - mx) / 0.1)) OVER g AS weight FROM (SELECT *, max(r2) OVER (PARTITION BY component) AS mx FROM sc) WINDOW g AS (PARTITION BY component)),
sh AS MATERIALIZED (SELECT component, model, (0.7 * weight + 0.3 * avg(weight) OVER (PARTITION BY model)) AS u FROM sm),
shw AS MATERIALIZED (SELECT component, model, u / sum(u) OVER (PARTITION BY component) AS weight FROM sh),
fs AS (SELECT model, greatest(avg(r2), 0) AS s FROM sc GROUP BY model),
fw AS MATERIALIZED (SELECT model, CASE WHEN sum(s) OVER () > 0 THEN s / sum(s) OVER () ELSE 1.0::DOUBLE / count(*) OVER () END AS weight FROM fs)"""


def scored(spark, folder):
    rows = forecasts(spark, folder)
    return rows, settle(E.metric_summary(rows, KEY).select("component", "model", "r2"))


@query("stack_softmax", f"{SCORE} SELECT component, model, {r('weight')} AS weight FROM sm")
def stack_softmax(spark, folder):
    return S.softmax_weights(scored(spark, folder)[1])


@query("stack_shared", f"{SCORE} SELECT component, model, {r('weight')} AS weight FROM shw")
def stack_shared(spark, folder):
    """Softmax weights shrunk towards each model's mean over the components."""
    return S.share_across_components(S.softmax_weights(scored(spark, folder)[1]))


@query("stack_fallback", f"{SCORE} SELECT model, {r('weight')} AS weight FROM fw")
def stack_fallback(spark, folder):
    return S.score_weights(scored(spark, folder)[1])


@query("stack_blend", f"""{SCORE}, b AS (SELECT component, model, 0.7 * sm.weight + 0.3 * shw.weight AS u FROM sm JOIN shw USING (component, model))
SELECT component, model, {r("u / sum(u) OVER (PARTITION BY component)")} AS weight FROM b""")
def stack_blend(spark, folder):
    """Old weights blended with new ones, gamma 0.3."""
    old = settle(S.softmax_weights(scored(spark, folder)[1]))
    return S.blend_weights(old, S.share_across_components(old))


@query("ensemble_forecasts", f"""{SCORE}, e AS (SELECT entity, period, component, max(y) AS y, sum(weight * yhat) / sum(weight) AS m, sum(weight * yhat * yhat) / sum(weight) AS q FROM pred JOIN sm USING (component, model) WHERE yhat IS NOT NULL GROUP BY ALL)
SELECT entity, {BIG}, component, {r("y")} AS y, {r("m")} AS yhat, {r("sqrt(greatest(round(q - m * m, 12), 0))", 5)} AS disagreement FROM e""")
def ensemble_forecasts(spark, folder):
    rows, scores = scored(spark, folder)
    out = S.ensemble(rows, settle(S.softmax_weights(scores)))
    # the spread of equal forecasts is 0 up to the last bits of the squares
    flat = F.sqrt(F.greatest(F.round(F.col("disagreement") * F.col("disagreement"), 12), F.lit(0.0)))
    return out.withColumn("disagreement", F.round(flat, 5))


@query("stack_ridge")
def stack_ridge(spark, folder):
    return S.ridge_weights(forecasts(spark, folder), BASE)


@query("stack_log_score")
def stack_log_score(spark, folder):
    return S.log_score_weights(forecasts(spark, folder), BASE)


@query("stack_weight_spread")
def stack_weight_spread(spark, folder):
    return S.weight_spread(forecasts(spark, folder), BASE, seed=3)


@query("stack_update")
def stack_update(spark, folder):
    """Weights of the early periods updated with the last one."""
    rows = forecasts(spark, folder)
    old = settle(S.ridge_weights(rows.where("period < 2001"), BASE))
    return S.update_weights(rows.where("period = 2001"), old, BASE)


@query("covariate_shift")
def covariate_shift(spark, folder):
    rows = Q.standard_panel(panel_of(spark, folder, False).data, INDICATORS)
    return S.shift_statistic(settle(rows.withColumn("late", (F.col("period") >= 2000).cast("int"))), INDICATORS, "late")


@query("shift_importance_weights")
def shift_importance_weights(spark, folder):
    rows = Q.standard_panel(panel_of(spark, folder, False).data, INDICATORS)
    out = S.importance_weights(settle(rows.withColumn("late", (F.col("period") >= 2000).cast("int"))), INDICATORS, "late")
    return out.select("entity", "period", "importance_weight")


# ------------------------------------------------------------------- models


def training(spark, folder):
    grid = scaled_components(spark, folder)
    return Q.feature_stage(grid, CRITERIA)


#: More folds than there are periods: every period after the first training ones is validated.
ALL_FOLDS = 1_000


def each_component(make):
    """``make(component)`` of every component, stacked under a ``component`` column."""
    parts = [make(c).withColumn("component", F.lit(c)) for c in CRITERIA]
    return reduce(lambda a, b: a.unionByName(b), parts)


def fitted(fit, spark, folder, **options):
    features, names = training(spark, folder)

    def one(c):
        model = fit(features.where(f"y_{c} IS NOT NULL"), names, f"y_{c}", **options)
        return model.predict(features).select("entity", "period", F.col(f"y_{c}").alias("y"), "yhat")

    return each_component(one)


@query("fit_bayesian_ridge")
def fit_bayesian_ridge(spark, folder):
    return fitted(M.bayesian_ridge, spark, folder)


@query("fit_elastic_net")
def fit_elastic_net(spark, folder):
    return fitted(M.elastic_net, spark, folder)


@query("elastic_net_grid")
def elastic_net_grid(spark, folder):
    """Walk-forward scores of a penalty grid."""
    features, names = training(spark, folder)
    return each_component(lambda c: M.elastic_net_cv(features, names, f"y_{c}", max_folds=ALL_FOLDS)[1])


@query("penalty_grid")
def penalty_grid(spark, folder):
    """Every setting of an elastic net on every walk-forward fold, from one pass for each component."""
    features, names = training(spark, folder)
    return each_component(lambda c: K.penalty_grid(features, names, f"y_{c}", max_folds=ALL_FOLDS))


@query("fit_multi_task")
def fit_multi_task(spark, folder):
    """Coefficients of one model of all components, with features kept or dropped for all of them."""
    features, names = training(spark, folder)
    return K.multi_task_elastic_net(features, names, [f"y_{c}" for c in CRITERIA])[1]


@query("fit_epsilon_insensitive")
def fit_epsilon_insensitive(spark, folder):
    """Next period's values by a kernel regression that leaves errors within a tube uncounted."""
    features, names = training(spark, folder)
    predictions = epsilon_insensitive(features, names, [f"y_{c}" for c in CRITERIA])[0]
    cells = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"y_{c}").alias("y"), F.col(f"yhat_y_{c}").alias("yhat")) for c in CRITERIA])
    return predictions.select("entity", "period", F.inline(cells))


@query("locally_weighted_intervals")
def locally_weighted_intervals(spark, folder):
    """Intervals of the last period's forecasts, from earlier residuals weighted by nearness of the period before."""
    rows = forecasts(spark, folder)
    before = scaled_components(spark, folder).select("entity", (F.col("period") + 1).alias("period"), *[F.col(c).alias(f"f_{c}") for c in CRITERIA])
    rows = settle(rows.join(before, ["entity", "period"]))
    last = F.col("period") == rows.agg(F.max("period")).first()[0]
    return locally_weighted(rows.where(~last), rows.where(last), [f"f_{c}" for c in CRITERIA], ["model", "component"])


@query("leave_one_entity_out_refits")
def leave_one_entity_out_refits(spark, folder):
    """Next period's value of each entity by a model of all other entities."""
    features, names = training(spark, folder)
    return each_component(lambda c: K.leave_one_entity_out(features, names, f"y_{c}"))


@query("fit_boosted_trees")
def fit_boosted_trees(spark, folder):
    return fitted(M.boosted_trees, spark, folder)


@query("fit_fourier_ridge")
def fit_fourier_ridge(spark, folder):
    return fitted(M.fourier_ridge, spark, folder)


@query("quantile_forest")
def quantile_forest(spark, folder):
    """Mean, median and a 90 % band of the next period's value from leaf distributions."""
    features, names = training(spark, folder)

    def one(c):
        forest = M.quantile_forest(features, names, f"y_{c}", ["entity", "period"])
        return forest.quantiles(features, ["entity", "period"], {"q05": 0.05, "median": 0.5, "q95": 0.95})

    return each_component(one)


# ------------------------------------------------------------- forecast run


def forecast_run(spark, folder, mode="full"):
    return Q.run(scaled_components(spark, folder), CRITERIA, models=tuple(M.MODELS), max_folds=ALL_FOLDS, mode=mode)


@query("forecast_next_period")
def forecast_next_period(spark, folder):
    """Stacked forecast with conformal intervals for the year after the last."""
    return forecast_run(spark, folder).predictions


@query("forecast_metrics")
def forecast_metrics(spark, folder):
    return forecast_run(spark, folder, "evaluate_only").metrics


@query("forecast_importance")
def forecast_importance(spark, folder):
    return Q.importance_table(spark, forecast_run(spark, folder).importance)


@query("forecast_ranking")
def forecast_ranking(spark, folder):
    """The forecast year ranked together with the history, with the historical weights."""
    panel = panel_of(spark, folder)
    grid = settle(X.dense(panel.data, panel.indicators))
    year = grid.agg(F.max("period")).first()[0]
    last = settle(X.baseline_forecasts(grid, panel.indicators).where((F.col("model") == "ewma") & (F.col("period") == year)))
    matrix = Q.prediction_matrix(last.withColumn("period", F.col("period") + 1), panel.indicators)
    extended = panel.with_data(settle(Q.with_history(panel.data, matrix)))
    w = two_level_weights(panel)
    scores = settle(R.method_scores(extended, w, ranked=False))
    return R.composite_ranks(scores).where(F.col("period") >= year)


CC = f"""{PAIRS}, m AS MATERIALIZED (SELECT entity, period, {", ".join(CRITERIA)} FROM w WHERE period = 2001),
rows0 AS MATERIALIZED (SELECT 0 AS g, m.entity AS id, h.item, CASE h.item WHEN 'K1' THEN K1 WHEN 'K2' THEN K2 WHEN 'K3' THEN K3 ELSE K4 END AS value FROM m, (VALUES ('K1'), ('K2'), ('K3'), ('K4')) h(item) WHERE {" AND ".join(f"{k} IS NOT NULL" for k in CRITERIA)}),
{critic("rows0", "g", "cr", scale=False)}, v AS (SELECT item, CASE WHEN sd > 1e-9 THEN weight ELSE 0 END AS u FROM cr), vw AS (SELECT item, u / sum(u) OVER () AS weight FROM v)"""


@query("critic_composite", f"""{CC} SELECT entity, {BIG}, {r("(" + " + ".join(f"coalesce({k}, 0) * (SELECT weight FROM vw WHERE item = '{k}')" for k in CRITERIA) + ")", 3)} AS composite FROM m""")
def critic_composite(spark, folder):
    """Composite of one matrix with CRITIC weights of the matrix itself."""
    grid = components(spark, folder).where("period = 2001").drop("position")
    out = Q.critic_composite(settle(grid), CRITERIA)
    return out.select("entity", "period", F.round("composite", 3).alias("composite"))


@query("model_comparison", f"""{PRED}, t AS (SELECT model, component, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - yhat) ** 2)) AS rmse, avg(abs(y - yhat)) AS mae FROM k GROUP BY ALL),
m AS (SELECT model, avg(r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae FROM t GROUP BY model)
SELECT model, {r("r2")} AS r2, {r("rmse")} AS rmse, {r("mae")} AS mae, row_number() OVER (ORDER BY round(r2, 9) DESC, model) AS position, row_number() OVER (ORDER BY round(r2, 9) DESC, model) = 1 AS best,
  CASE WHEN r2 < 0 THEN 'worse than the mean' WHEN r2 < 0.5 THEN 'weak' ELSE 'usable' END AS note FROM m""")
def model_comparison(spark, folder):
    return Q.model_comparison(E.metric_summary(forecasts(spark, folder), ["model", "component"]))


@query("residual_table", f"{PRED} SELECT entity, {BIG}, component, model, {r('y')} AS y, {r('yhat')} AS yhat, {r('y - yhat')} AS residual FROM k")
def residual_table(spark, folder):
    return Q.residual_table(forecasts(spark, folder))


@query("forecast_stability", f"""{PRED}, p AS (SELECT a.model, a.component, a.period, round(a.yhat, 10) AS x, round(b.yhat, 10) AS z FROM pred a JOIN pred b USING (entity, component, model) WHERE b.period = a.period + 1 AND a.yhat IS NOT NULL AND b.yhat IS NOT NULL),
q AS (SELECT model, component, period, {avg_rank("x", "model, component, period")} AS a, {avg_rank("z", "model, component, period")} AS b FROM p),
rh AS (SELECT model, component, period, {CORR.format(a="a", b="b")} AS rho FROM q GROUP BY ALL),
rs AS (SELECT model, avg(rho) AS s FROM rh GROUP BY model),
pe AS (SELECT model, period, sqrt(avg((y - yhat) ** 2)) AS rmse FROM k GROUP BY ALL), ps AS (SELECT model, greatest(1 - stddev_pop(rmse) / avg(rmse), 0) AS s FROM pe GROUP BY model)
SELECT model, {r("rs.s")} AS rank_stability, {r("ps.s")} AS score_stability, rs.s >= 0.8 AS stable FROM rs JOIN ps USING (model)""")
def forecast_stability(spark, folder):
    return Q.fold_stability(forecasts(spark, folder))


@query("forecast_agreement", f"""{PRED}, w AS (SELECT entity, period, component, {", ".join(f"max(yhat) FILTER (WHERE model = '{m}') AS m_{m}" for m in BASE)} FROM pred GROUP BY ALL)
{" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(CORR.format(a='m_' + a, b='m_' + b))} AS r FROM w" for a, b in (("last", "mean"), ("last", "ewma"), ("mean", "ewma")))}""")
def forecast_agreement(spark, folder):
    return Q.model_agreement(forecasts(spark, folder), BASE)


@query("width_stability", f"""{SYM}, iv AS (SELECT component, avg(2 * q) AS w FROM pred JOIN w USING (model, component) WHERE yhat IS NOT NULL GROUP BY component)
SELECT {r("greatest(1 - stddev_pop(w) / avg(w), 0)")} AS width_stability FROM iv""")
def width_stability(spark, folder):
    return Q.width_stability(intervals(spark, folder))


@query("leave_model_out", f"""{PRED}, n AS (SELECT *, count(*) OVER g AS n, sum(yhat) OVER g AS s FROM pred WHERE yhat IS NOT NULL WINDOW g AS (PARTITION BY entity, period, component))
SELECT model, {r("avg(abs(s / n - (s - yhat) / (n - 1)))")} AS impact, {r("avg(abs(yhat - s / n))")} AS deviation FROM n GROUP BY model""")
def leave_model_out(spark, folder):
    return Q.leave_model_out(forecasts(spark, folder))


@query("forecast_bootstrap")
def forecast_bootstrap(spark, folder):
    rows, scores = scored(spark, folder)
    out = S.ensemble(rows, settle(S.softmax_weights(scores)))
    last = out.agg(F.max("period")).first()[0]
    return Q.parametric_bootstrap(out.where(F.col("period") == last), "disagreement", seed=5)


@query("importance_stability")
def importance_stability(spark, folder):
    """Features of single-component ridge fits, components resampled."""
    features, names = training(spark, folder)
    rows = []
    for c in CRITERIA:
        model = M.bayesian_ridge(features.where(f"y_{c} IS NOT NULL"), names, f"y_{c}")
        rows += [(c, f, float(v)) for f, v in model.importance.items()]
    parts = spark.createDataFrame(rows, "component string, feature string, importance double")
    return Q.importance_stability(parts, seed=5)


def checks(spark, folder):
    slack = intervals(spark, folder).withColumns({"lower": F.col("lower") - 1e-9, "upper": F.col("upper") + 1e-9})
    return Q.forecast_checks(forecasts(spark, folder), slack)


@query("forecast_checks")
def forecast_checks(spark, folder):
    return checks(spark, folder)


@query("run_verdict")
def run_verdict(spark, folder):
    """Forecast checks and ranking robustness in one line."""
    scores, ranked = both(spark, folder)
    noise = H.criterion_sensitivity(settle(B.criterion_scores(scores)), seed=7)
    robust = settle(H.robustness(noise, H.criterion_consistency(scores, ranked)))
    return Q.verdict(settle(checks(spark, folder)), robust)


# ------------------------------------------------------------------- widths


@query("adaptive_widths")
def adaptive_widths(spark, folder):
    return A.adaptive_widths(forecasts(spark, folder), KEY)


@query("student_widths")
def student_widths(spark, folder):
    """Per model, component and period: groups small enough for a Student t."""
    return A.student_widths(forecasts(spark, folder), [*KEY, "period"])


@query("effective_outputs")
def effective_outputs(spark, folder):
    """Outputs that count for a Bonferroni correction, with the corrected level."""
    rows = S.wide_forecasts(forecasts(spark, folder).where("model = 'ewma'").withColumn("yhat", F.col("y") - F.col("yhat")), ["ewma"])
    wide = rows.groupBy("entity", "period").agg(*[F.max(F.when(F.col("component") == c, F.col("ewma"))).alias(c) for c in CRITERIA])
    n = L.effective_outputs(settle(wide), CRITERIA)
    return wide.agg(F.lit(n).alias("n_effective"), F.lit(0.1 / n).alias("alpha"), F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------- memberships


def shares(lines, years):
    """Share of each return flag in a supplier's lines, as a membership table."""
    rows = lines.where(years).groupBy(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("grade")).agg(F.count(F.lit(1)).alias("n"))
    whole = rows.groupBy("entity").agg(F.sum("n").alias("t"))
    return rows.join(whole, "entity").select("entity", "grade", (F.col("n") / F.col("t")).alias("belief"))


def share_sql(name, where):
    return f"""{name} AS MATERIALIZED (SELECT l_suppkey AS entity, l_returnflag AS grade, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey)::DOUBLE AS belief FROM lineitem WHERE {where} GROUP BY 1, 2)"""


@query("membership_checks", f"""WITH {share_sql("b", "true")} SELECT entity, {r("sum(belief)")} AS total, bool_and(belief BETWEEN 0 AND 1) AS in_range, sum(belief) <= 1 + 1e-9 AS sum_ok, sum(belief) >= 1 - 1e-6 AS complete,
  {r("-sum(CASE WHEN belief > 0 THEN belief * ln(belief) ELSE 0 END)")} AS entropy FROM b GROUP BY entity""")
def membership_checks(spark, folder):
    return Q.membership_checks(shares(table(spark, folder, "lineitem"), F.lit(True)))


@query("grade_distribution", f"""WITH {share_sql("b", "true")}, t AS (SELECT entity, grade FROM b QUALIFY row_number() OVER (PARTITION BY entity ORDER BY round(belief, 9) DESC, grade) = 1) SELECT grade, count(*) AS n FROM t GROUP BY grade""")
def grade_distribution(spark, folder):
    return Q.grade_distribution(shares(table(spark, folder, "lineitem"), F.lit(True)))


@query("membership_stability", f"""WITH {share_sql("a", "year(l_shipdate) < 1999")}, {share_sql("b", "year(l_shipdate) >= 1999")},
j AS (SELECT entity, grade, a.belief AS x, b.belief AS y FROM a JOIN b USING (entity, grade)),
p AS (SELECT entity, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS c, min_by(grade, (1 - round(x, 9))::VARCHAR || grade) AS ga, min_by(grade, (1 - round(y, 9))::VARCHAR || grade) AS gb,
  -sum(CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END) AS ea, -sum(CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END) AS eb FROM j GROUP BY entity)
SELECT {r("avg(c)")} AS cosine, {r("avg((ga = gb)::INT::DOUBLE)")} AS same_grade, {r(CORR.format(a="ea", b="eb"))} AS entropy_correlation, count(*) AS n FROM p""")
def membership_stability(spark, folder):
    lines = table(spark, folder, "lineitem")
    year = F.year("l_shipdate")
    return Q.membership_stability(shares(lines, year < 1999), shares(lines, year >= 1999))


# ------------------------------------- ranking of a prediction matrix by median


@query("rank_prediction_matrix")
def rank_prediction_matrix(spark, folder):
    """Six methods on the forecast matrix, median score, ten best."""
    from panelwise.plans.prediction import rank_predictions

    panel = panel_of(spark, folder)
    grid = settle(X.dense(panel.data, panel.indicators))
    last = settle(X.baseline_forecasts(grid, panel.indicators).where("model = 'mean' AND period = 2001"))
    return rank_predictions(settle(Q.prediction_matrix(last, panel.indicators)), panel.indicators)
