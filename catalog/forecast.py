"""Features, splits, baseline forecasts, intervals and evaluation."""

from pyspark.sql import functions as F

from catalog.combination import CORR
from catalog.ranking import BIG, panel_of
from catalog.registry import query
from oracle.base import CRITERIA, INDICATORS, avg_rank, long, r
from panelwise.operators import evaluate as E
from panelwise.operators import features as X
from panelwise.operators import intervals as I
from panelwise.operators import splits as S
from panelwise.operators.scaling import (
    apply_min_max, fit_min_max, global_min_max, inverse_logit, logit, normalize, period_min_max, ranking_min_max,
)
from panelwise.operators.views import criterion_means
from panelwise.session import settle
from panelwise.sources.tables import CUSTOMER_HIERARCHY, customer_panel, supplier_panel, table, user_panel

# ----------------------------------------------------------------- scaling

CLEAN = "WITH " + long(gaps=False)
LONG = "WITH " + long()
G = "PARTITION BY period, indicator"


def unlong(df, columns=INDICATORS):
    from panelwise.panel import to_long

    return to_long(df, columns)


def scaling_query(name, expr, fn, gaps=False, cte=""):
    src = LONG if gaps else CLEAN
    sql = f"""{src}, s AS (SELECT entity, period, indicator, {expr} AS value FROM obs WINDOW g AS ({G}), a AS (PARTITION BY indicator))
SELECT entity, {BIG}, indicator, {r("value")} AS value FROM s"""
    query(name, sql)(lambda spark, folder: unlong(fn(panel_of(spark, folder, gaps))))


RANGE = "max(value) OVER {w} - min(value) OVER {w}"
scaling_query(
    "scale_global", f"(value - min(value) OVER a) / greatest({RANGE.format(w='a')}, 1e-10)",
    lambda p: global_min_max(p.data, p.indicators), gaps=True)
scaling_query(
    "scale_ranking",
    f"CASE WHEN count(value) OVER g = 0 OR {RANGE.format(w='g')} < 1e-12 THEN 0.5 WHEN cost THEN (max(value) OVER g - value) / ({RANGE.format(w='g')}) ELSE (value - min(value) OVER g) / ({RANGE.format(w='g')}) END",
    lambda p: ranking_min_max(p.data, p.indicators, ["period"], p.hierarchy.cost), gaps=True)
for _kind, _expr in {
    "vector": "value / CASE WHEN sqrt(sum(value * value) OVER g) = 0 THEN 1 ELSE sqrt(sum(value * value) OVER g) END",
    "minmax": f"CASE WHEN cost THEN max(value) OVER g - value ELSE value - min(value) OVER g END / CASE WHEN max(value) OVER g = min(value) OVER g THEN 1 ELSE {RANGE.format(w='g')} END",
    "max": "CASE WHEN cost THEN CASE WHEN min(value) OVER g > 0 THEN min(value) OVER g / value WHEN max(value) OVER g > 0 THEN (max(value) OVER g - value) / max(value) OVER g ELSE 0 END ELSE value / CASE WHEN max(value) OVER g = 0 THEN 1 ELSE max(value) OVER g END END",
    "sum": "CASE WHEN cost THEN (1 / greatest(value, 1e-10)) / sum(1 / greatest(value, 1e-10)) OVER g ELSE value / CASE WHEN sum(value) OVER g = 0 THEN 1 ELSE sum(value) OVER g END END",
    "abs_sum": "CASE WHEN abs(sum(value) OVER g) > 0 THEN value / abs(sum(value) OVER g) ELSE 1.0::DOUBLE / count(value) OVER g END",
}.items():
    scaling_query(
        f"scale_{_kind}", _expr,
        lambda p, k=_kind: normalize(p.data, p.indicators, k, ["period"], p.hierarchy.cost))
scaling_query(
    "scale_period",
    f"CASE WHEN value IS NULL THEN NULL WHEN {RANGE.format(w='g')} > 0 THEN least(greatest((value - min(value) OVER g) / ({RANGE.format(w='g')}), 0), 1) ELSE 0 END",
    lambda p: period_min_max(p.data, p.indicators, ["period"]), gaps=True)


@query("scale_fit_transform_inverse", f"""{CLEAN}, f AS (SELECT indicator, min(value) AS lo, greatest(max(value) - min(value), 1e-10) AS span FROM obs WHERE period < 2000 GROUP BY indicator)
SELECT entity, {BIG}, indicator, {r("(value - lo) / span")} AS scaled, {r("(value - lo) / span * span + lo", 3)} AS back FROM obs JOIN f USING (indicator) WHERE period >= 2000""")
def scale_fit_transform_inverse(spark, folder):
    """Statistics of the early periods applied to the later ones, and back."""
    panel = panel_of(spark, folder, False)
    stats = fit_min_max(panel.data.where("period < 2000"), panel.indicators)
    new = apply_min_max(panel.data.where("period >= 2000"), stats, panel.indicators)
    back = apply_min_max(new, stats, panel.indicators, inverse=True)
    a = unlong(new).withColumnRenamed("value", "scaled")
    b = unlong(back).withColumn("back", F.round("value", 3)).drop("value")
    return a.join(b, ["entity", "period", "indicator"])


@query("target_logit", f"""{CLEAN}, p AS (SELECT entity, period, value AS x, least(greatest(value, 1e-6), 1 - 1e-6) AS q FROM obs WHERE indicator = 'I41')
SELECT entity, {BIG}, {r("ln(q / (1 - q))")} AS z, {r("1 / (1 + exp(-ln(q / (1 - q))))")} AS back FROM p""")
def target_logit(spark, folder):
    panel = supplier_panel(spark, folder, gaps=False)
    z = logit(F.col("I41"))
    return panel.data.select("entity", "period", z.alias("z"), inverse_logit(z).alias("back"))


# ---------------------------------------------------------------- features

COMP = f"""{LONG}, cm AS (SELECT entity, period, criterion, avg(value) AS v FROM obs GROUP BY ALL),
times AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS pos FROM (SELECT DISTINCT period FROM panel)),
grid AS MATERIALIZED (SELECT e.entity, t.period, t.pos, k.component, c.v FROM (SELECT DISTINCT entity FROM panel) e CROSS JOIN times t
  CROSS JOIN (SELECT DISTINCT criterion AS component FROM hier) k LEFT JOIN cm c ON c.entity = e.entity AND c.period = t.period AND c.criterion = k.component)"""
E_W = "PARTITION BY entity, component ORDER BY period"


def components(spark, folder):
    panel = panel_of(spark, folder)
    return settle(X.dense(criterion_means(panel), CRITERIA))


def by_component(df, suffixes, ids=("entity", "period")):
    """Wide ``K1_lag1`` columns to one row per component."""
    cells = F.array(*[
        F.struct(F.lit(k).alias("component"), *[F.col(f"{k}_{s}").alias(s) for s in suffixes]) for k in CRITERIA
    ])
    return df.select(*ids, F.inline(cells))


MED = "med AS (SELECT period, component, coalesce(quantile_cont(v, 0.5), 0) AS m FROM grid GROUP BY ALL)"


def lag_sql(k):
    return f"""{r(f"coalesce(lag(v, {k}) OVER w, CASE WHEN pos >= {k} THEN lag(m, {k}) OVER w ELSE m END)")} AS lag{k},
  (lag(v, {k}) OVER w IS NULL)::BIGINT AS lag{k}_missing"""


@query("features_lags", f"""{COMP}, {MED} SELECT entity, {BIG}, component, {r("v")} AS current, {", ".join(lag_sql(k) for k in (1, 2, 3))}
FROM grid JOIN med USING (period, component) WINDOW w AS ({E_W})""")
def features_lags(spark, folder):
    out = X.lag_features(components(spark, folder), CRITERIA)
    return by_component(out, ["current"] + [f"lag{k}{s}" for k in (1, 2, 3) for s in ("", "_missing")])


def roll_sql(n):
    def full(e):
        return r(f"CASE WHEN pos >= {n - 1} THEN {e} END")
    w = f"OVER ({E_W} ROWS {n - 1} PRECEDING)"
    return f"""{full(f"avg(v) {w}")} AS roll{n}_mean, {full(f"coalesce(stddev_samp(v) {w}, 0)")} AS roll{n}_sd,
  {full(f"min(v) {w}")} AS roll{n}_min, {full(f"max(v) {w}")} AS roll{n}_max"""


@query("features_rolling", f"{COMP} SELECT entity, {BIG}, component, {roll_sql(3)}, {roll_sql(5)} FROM grid")
def features_rolling(spark, folder):
    out = X.rolling_features(components(spark, folder), CRITERIA)
    return by_component(out, [f"roll{n}_{s}" for n in (3, 5) for s in ("mean", "sd", "min", "max")])


@query("features_skewness", f"""{COMP}, p AS (SELECT a.entity, a.period, a.component, a.pos, count(b.v) AS n, avg(b.v) AS m FROM grid a JOIN grid b ON a.entity = b.entity AND a.component = b.component AND b.pos BETWEEN a.pos - 4 AND a.pos GROUP BY ALL),
q AS (SELECT p.entity, p.period, p.component, any_value(p.pos) AS pos, any_value(n) AS n, avg((b.v - m) ** 3) AS m3, avg((b.v - m) ** 2) AS m2 FROM p JOIN grid b ON p.entity = b.entity AND p.component = b.component AND b.pos BETWEEN p.pos - 4 AND p.pos GROUP BY ALL)
SELECT entity, {BIG}, component, {r("CASE WHEN pos >= 4 AND n >= 3 AND m2 > 0 THEN m3 / m2 ** 1.5 END")} AS skew5 FROM q""")
def features_skewness(spark, folder):
    return by_component(X.rolling_skewness(components(spark, folder), CRITERIA), ["skew5"])


MOM = f"""{COMP}, d AS (SELECT *, v - lag(v) OVER w AS d1, lag(v, 1) OVER w - lag(v, 2) OVER w AS d2 FROM grid WINDOW w AS ({E_W}))"""


def mom_sql(cut):
    inside = f"FILTER (WHERE period <= {cut})" if cut else ""
    return f"""{MOM} SELECT entity, {BIG}, component, {r("d1")} AS momentum, {r("d2")} AS delta2, {r("d1 - d2")} AS acceleration,
  {r(f"v - coalesce(avg(v) {inside} OVER e, 0)")} AS demeaned, {r(f"d1 - coalesce(avg(d1) {inside} OVER e, 0)")} AS demeaned_momentum FROM d WINDOW e AS (PARTITION BY entity, component)"""


MOMENTUM = ["momentum", "delta2", "acceleration", "demeaned", "demeaned_momentum"]


@query("features_momentum", mom_sql(None))
def features_momentum(spark, folder):
    return by_component(X.momentum_features(components(spark, folder), CRITERIA), MOMENTUM)


@query("features_momentum_fold", mom_sql(1998))
def features_momentum_fold(spark, folder):
    """Entity means over the training periods of a fold only."""
    return by_component(X.momentum_features(components(spark, folder), CRITERIA, cut=1998), MOMENTUM)


def ewma_sql(s):
    up = f"power({s + 1}.0::DOUBLE / {s - 1}, pos)"
    return f"{r(f'sum(v * {up}) OVER u / sum(CASE WHEN v IS NOT NULL THEN {up} END) OVER u')} AS ewma{s}"


@query("features_trend", f"""{COMP} SELECT entity, {BIG}, component, {r("CASE WHEN count(v) OVER u >= 3 THEN regr_slope(v, pos) OVER u END")} AS trend, {ewma_sql(3)}, {ewma_sql(5)},
  {r("avg(v) OVER u")} AS expanding FROM grid WINDOW u AS ({E_W} ROWS UNBOUNDED PRECEDING)""")
def features_trend(spark, folder):
    return by_component(X.trend_features(components(spark, folder), CRITERIA), ["trend", "ewma3", "ewma5", "expanding"])


@query("features_diversity", f"""{COMP} SELECT entity, {BIG}, {r("CASE WHEN count(v) >= 2 THEN stddev_pop(v) END", 3)} AS diversity_sd, {r("CASE WHEN count(v) >= 2 THEN max(v) - min(v) END", 3)} AS diversity_range
FROM grid GROUP BY entity, period""")
def features_diversity(spark, folder):
    out = X.diversity_features(components(spark, folder), CRITERIA)
    return out.select("entity", "period", *[F.round(c, 3).alias(c) for c in ("diversity_sd", "diversity_range")])


CROSS = f"""{COMP}, has AS (SELECT period, component FROM grid GROUP BY ALL HAVING count(v) > 0),
co AS (SELECT g.entity, g.period FROM grid g JOIN has USING (period, component) GROUP BY ALL HAVING count(g.v) = count(*)),
x AS MATERIALIZED (SELECT g.*, co.entity IS NOT NULL AS c FROM grid g LEFT JOIN co USING (entity, period)),
s AS (SELECT period, component, avg(v) AS m, stddev_samp(v) AS sd, avg(v) FILTER (WHERE c) AS cmn, stddev_samp(v) FILTER (WHERE c) AS csd FROM x GROUP BY ALL),
f AS (SELECT x.entity, x.period, x.component, x.v, CASE WHEN x.v IS NULL THEN 0.5 ELSE (SELECT count(*) FILTER (WHERE y.v < x.v)::DOUBLE / nullif(count(y.v), 0) FROM x y WHERE y.period = x.period AND y.component = x.component AND (y.c OR NOT x.c)) END AS percentile,
  CASE WHEN x.v IS NULL THEN 0 WHEN x.c THEN (x.v - cmn) / (csd + 1e-10) ELSE (x.v - m) / (sd + 1e-10) END AS zscore FROM x JOIN s USING (period, component))"""


@query("features_cross_entity", f"""{CROSS} SELECT entity, {BIG}, component, {r("percentile")} AS percentile, {r("zscore")} AS zscore,
  {r("CASE WHEN lag(v) OVER w IS NOT NULL THEN percentile - lag(percentile) OVER w ELSE 0 END")} AS rank_change FROM f WINDOW w AS ({E_W})""")
def features_cross_entity(spark, folder):
    """Percentile, z-score and rank change against the cohort of complete suppliers."""
    return X.cross_entity_features(components(spark, folder), CRITERIA)


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("features_region", f"""SELECT s_suppkey AS entity, {", ".join(f"(r_name = '{n}')::BIGINT AS region_{i}" for i, n in enumerate(REGIONS))}
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def features_region(spark, folder):
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    suppliers = table(spark, folder, "supplier")
    register = suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("entity"), F.col("r_name").alias("region")
    )
    return X.region_features(suppliers.select(F.col("s_suppkey").alias("entity")), register, REGIONS)


PAIRS = f"""{COMP}, w AS MATERIALIZED (SELECT entity, period, any_value(pos) AS pos, {", ".join(f"max(v) FILTER (WHERE component = '{k}') AS {k}" for k in CRITERIA)} FROM grid GROUP BY ALL)"""


@query("training_pairs", f"""{PAIRS} SELECT a.entity, a.period::BIGINT AS period, b.period::BIGINT AS target_period, {", ".join(f"{r('a.' + k)} AS x_{k}, {r('b.' + k)} AS y_{k}" for k in CRITERIA)}
FROM w a JOIN w b ON a.entity = b.entity AND b.pos = a.pos + 1 WHERE b.period <> 2001 AND {" AND ".join(f"b.{k} IS NOT NULL" for k in CRITERIA)}""")
def training_pairs(spark, folder):
    return X.training_pairs(components(spark, folder), CRITERIA, holdout=2001)


SILENT = "WHERE NOT (period = 2001 AND entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))"


@query("prediction_rows", f"""{PAIRS}, v AS (SELECT * FROM w {SILENT})
SELECT entity, {BIG}, {", ".join(f"{r(k)} AS {k}" for k in CRITERIA)} FROM v QUALIFY row_number() OVER (PARTITION BY entity ORDER BY (coalesce({", ".join(CRITERIA)}) IS NOT NULL)::INT DESC, period DESC) = 1""")
def prediction_rows(spark, folder):
    """Latest row with a value; suppliers in debt have no row in the last year."""
    grid = components(spark, folder)
    debtors = table(spark, folder, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("entity"), F.lit(2001).alias("period"))
    return X.prediction_rows(grid.drop("position").join(debtors, ["entity", "period"], "left_anti"), CRITERIA)


SAW = f"""{COMP}, saw AS MATERIALIZED (SELECT entity, period, pos, component, CASE WHEN v IS NULL THEN NULL WHEN max(v) OVER g > min(v) OVER g THEN (v - min(v) OVER g) / (max(v) OVER g - min(v) OVER g) ELSE 0 END AS v
  FROM grid WINDOW g AS (PARTITION BY period, component))"""


@query("saw_targets", f"{SAW} SELECT entity, {BIG}, {', '.join(f'''{r(f"max(v) FILTER (WHERE component = '{k}')")} AS {k}''' for k in CRITERIA)} FROM saw GROUP BY entity, period")
def saw_targets(spark, folder):
    return X.saw_targets(components(spark, folder).drop("position"), CRITERIA)


@query("fold_medians", f"""{COMP}, kn AS (SELECT DISTINCT entity FROM grid WHERE period < 1997 AND v IS NOT NULL)
SELECT {BIG}, component AS indicator, count(v) AS n, {r("quantile_cont(v, 0.5)")} AS median FROM grid WHERE entity IN (SELECT entity FROM kn) GROUP BY period, component HAVING count(v) > 0""")
def fold_medians(spark, folder):
    return X.fold_medians(components(spark, folder), CRITERIA, 1997)


@query("target_counts", f"{COMP} SELECT component, count(v) AS n_valid FROM grid GROUP BY component")
def target_counts(spark, folder):
    return X.target_counts(components(spark, folder), CRITERIA)


@query("customer_lags", """WITH p AS (SELECT o_custkey AS entity, year(o_orderdate) AS period, count(*)::DOUBLE AS v FROM orders GROUP BY ALL),
g AS (SELECT e.entity, t.period, p.v FROM (SELECT DISTINCT entity FROM p) e CROSS JOIN (SELECT DISTINCT period FROM p) t LEFT JOIN p USING (entity, period))
SELECT entity, period::BIGINT AS period, v AS orders, v - lag(v) OVER w AS momentum FROM g WINDOW w AS (PARTITION BY entity ORDER BY period)""")
def customer_lags(spark, folder):
    """The dense grid on customers, who skip years."""
    grid = X.dense(customer_panel(spark, folder).data, ["J11"])
    out = X.momentum_features(grid, ["J11"]).select("entity", "period", F.col("J11_momentum").alias("momentum"))
    return grid.select("entity", "period", F.col("J11").alias("orders")).join(out, ["entity", "period"])


@query("user_trend", f"""WITH p AS (SELECT user_id AS entity, dayofyear(ts) AS period, count(*)::DOUBLE AS v FROM events GROUP BY ALL),
t AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS pos FROM (SELECT DISTINCT period FROM p)),
grid AS (SELECT e.entity, t.period, t.pos, 'U11' AS component, p.v FROM (SELECT DISTINCT entity FROM p) e CROSS JOIN t LEFT JOIN p USING (entity, period))
SELECT entity, {BIG}, {r("CASE WHEN count(v) OVER u >= 3 THEN regr_slope(v, pos) OVER u END")} AS trend, {ewma_sql(3)} FROM grid WINDOW u AS ({E_W} ROWS UNBOUNDED PRECEDING)""")
def user_trend(spark, folder):
    """Many periods: user x day of the event stream."""
    grid = X.dense(user_panel(spark, folder).data, ["U11"])
    out = X.trend_features(grid, ["U11"])
    return out.select("entity", "period", F.col("U11_trend").alias("trend"), F.col("U11_ewma3").alias("ewma3"))


# ------------------------------------------------------------------- splits


@query("walk_forward_folds", f"""{COMP}, v AS (SELECT period, pos - 3 AS fold FROM times WHERE pos BETWEEN 3 AND 7)
SELECT fold::BIGINT AS fold, v.period::BIGINT AS val_period, count(*) FILTER (WHERE g.period < v.period) AS n_train, count(*) FILTER (WHERE g.period = v.period) AS n_validate
FROM v JOIN (SELECT DISTINCT entity, period FROM panel) g ON g.period <= v.period GROUP BY 1, 2""")
def walk_forward_folds(spark, folder):
    panel = panel_of(spark, folder)
    return S.split_sizes(S.walk_forward(panel.data.select("entity", "period"), min_train=3))


@query("walk_forward_flagged", f"""{COMP}, v AS (SELECT period, pos - 3 AS fold FROM times WHERE pos BETWEEN 3 AND 7),
fl AS (SELECT entity, period, count(value) = 0 AS empty FROM obs GROUP BY ALL)
SELECT fold::BIGINT AS fold, v.period::BIGINT AS val_period, count(*) FILTER (WHERE g.period < v.period) AS n_train, count(*) FILTER (WHERE g.period = v.period AND NOT empty) AS n_validate
FROM v JOIN fl g ON g.period <= v.period GROUP BY 1, 2""")
def walk_forward_flagged(spark, folder):
    """Flagged rows train but never validate."""
    from panelwise.operators.views import entity_activity

    rows = entity_activity(panel_of(spark, folder)).select("entity", "period", (~F.col("active")).alias("empty"))
    return S.split_sizes(S.walk_forward(rows, min_train=3, never_validate="empty"))


@query("position_split", """WITH p AS (SELECT o_custkey AS entity, year(o_orderdate) AS period FROM orders GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) - 1 AS pos FROM p),
b AS (SELECT greatest(1, floor(quantile_cont(n, 0.5) / 4)) AS b FROM (SELECT count(*) AS n FROM p GROUP BY entity)),
f AS (SELECT fold, CASE WHEN pos < (fold + 1) * b THEN 'train' WHEN pos < (fold + 2) * b THEN 'validate' END AS role FROM q, b, (VALUES (0), (1), (2)) f(fold))
SELECT fold::BIGINT AS fold, role, count(*) AS n FROM f WHERE role IS NOT NULL GROUP BY ALL""")
def position_split(spark, folder):
    rows = settle(customer_panel(spark, folder).data.select("entity", "period"))
    return S.position_split(rows, n_splits=3).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------- forecasts and metrics

PRED = f"""{SAW}, fc AS MATERIALIZED (SELECT entity, period, component, v AS y,
    last_value(v IGNORE NULLS) OVER b AS "last", avg(v) OVER b AS "mean", sum(v * power(2.0::DOUBLE, pos)) OVER b / sum(CASE WHEN v IS NOT NULL THEN power(2.0::DOUBLE, pos) END) OVER b AS ewma
  FROM saw WINDOW b AS ({E_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pred AS MATERIALIZED (SELECT entity, period, component, y, model, yhat FROM (
  SELECT entity, period, component, y, 'last' AS model, "last" AS yhat FROM fc UNION ALL SELECT entity, period, component, y, 'mean', "mean" FROM fc UNION ALL SELECT entity, period, component, y, 'ewma', ewma FROM fc)),
k AS MATERIALIZED (SELECT *, round(y - yhat, 10) AS res FROM pred WHERE y IS NOT NULL AND yhat IS NOT NULL)"""


def forecasts(spark, folder):
    grid = components(spark, folder)
    scaled = X.saw_targets(grid, CRITERIA)
    return settle(X.baseline_forecasts(scaled, CRITERIA))


@query("persistence_forecasts", f"""{PRED} SELECT entity, {BIG}, component, {r("y")} AS y, model, {r("yhat")} AS yhat FROM pred""")
def persistence_forecasts(spark, folder):
    """One-step forecasts: last value, mean so far, weighted mean."""
    return forecasts(spark, folder)


@query("global_last_value", f"""{PAIRS} SELECT {", ".join(f"{r(k)} AS {k}" for k in CRITERIA)} FROM w WHERE {" AND ".join(f"{k} IS NOT NULL" for k in CRITERIA)} ORDER BY period DESC, entity DESC LIMIT 1""")
def global_last_value(spark, folder):
    return X.global_last(components(spark, folder), CRITERIA)


METRICS = f"""count(*) AS n, {r("1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*))")} AS r2, {r("sqrt(avg((y - yhat) ** 2))")} AS rmse, {r("avg(abs(y - yhat))")} AS mae,
  {r("100 * avg(abs(y - yhat) / CASE WHEN abs(y) < 1e-9 THEN 1 ELSE abs(y) END)", 3)} AS mape, {r("avg(y - yhat)")} AS bias, {r("coalesce(" + CORR.format(a="y", b="yhat") + ", 0)")} AS correlation"""


@query("metric_summary", f"{PRED} SELECT model, component, {METRICS} FROM k GROUP BY model, component")
def metric_summary(spark, folder):
    return E.metric_summary(forecasts(spark, folder), ["model", "component"]).withColumn("mape", F.round("mape", 3))


@query("compare_models", f"""{PRED}, t AS (SELECT model, {METRICS} FROM k GROUP BY model)
SELECT *, row_number() OVER (ORDER BY r2 DESC, model) AS position, row_number() OVER (ORDER BY r2 DESC, model) = 1 AS best FROM t""")
def compare_models(spark, folder):
    return E.compare_models(forecasts(spark, folder)).withColumn("mape", F.round("mape", 3))


FOLD = f"""{PRED}, f AS (SELECT model, period, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - yhat) ** 2)) AS rmse, avg(abs(y - yhat)) AS mae FROM k GROUP BY ALL)"""


@query("fold_summary", f"""{FOLD} SELECT model, count(*) AS n_folds, {", ".join(f"{r(f'avg({m})')} AS {m}_mean, {r(f'stddev_pop({m})')} AS {m}_sd, {r(f'min({m})')} AS {m}_min, {r(f'max({m})')} AS {m}_max" for m in ("r2", "rmse", "mae"))} FROM f GROUP BY model""")
def fold_summary(spark, folder):
    return E.fold_summary(forecasts(spark, folder), "period")


@query("fold_score_quantiles", f"""{FOLD} SELECT model, count(*) AS n, {", ".join(f"{r(f'quantile_cont(round(r2, 10), {q})')} AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))} FROM f GROUP BY model""")
def fold_score_quantiles(spark, folder):
    from panelwise.operators.ordered import group_quantiles

    per = E.metric_summary(forecasts(spark, folder), ["model", "period"])
    return group_quantiles(settle(per.withColumn("r2", F.round("r2", 10))), ["model"], "r2", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


DIAG = f"""{PRED}, e AS (SELECT *, y - yhat AS r FROM k), d AS (SELECT *, r - lag(r) OVER (PARTITION BY model, entity, component ORDER BY period) AS d FROM e),
dw AS (SELECT model, avg(dw) AS dw FROM (SELECT model, entity, component, sum(d * d) / (sum(r * r) + 1e-10) AS dw FROM d GROUP BY ALL HAVING count(*) > 2) GROUP BY model),
mo AS (SELECT model, avg(r) AS m, stddev_pop(r) AS s, count(*) AS n, {CORR.format(a="yhat", b="abs(r)")} AS c FROM e GROUP BY model)"""


@query("residual_diagnostics", f"""{DIAG} SELECT model, any_value(n) AS n, {r("any_value(m)")} AS mean, {r("any_value(s)")} AS sd, any_value(abs(m) < 2 * s / sqrt(n)) AS mean_is_zero, {r("any_value(c)")} AS spread_correlation,
  {r("avg(((r - m) / s) ** 3)")} AS skewness, {r("avg(((r - m) / s) ** 4) - 3")} AS excess_kurtosis, {r("any_value(dw)")} AS durbin_watson FROM e JOIN mo USING (model) JOIN dw USING (model) GROUP BY model""")
def residual_diagnostics(spark, folder):
    return E.residual_diagnostics(forecasts(spark, folder))


@query("entity_errors", f"""{PRED} SELECT model, entity, {r("avg(abs(y - yhat))")} AS mae, {r("sqrt(avg((y - yhat) ** 2))")} AS rmse, {r("avg(CASE WHEN abs(y) > 0.01 THEN abs(y - yhat) / abs(y) * 100 END)", 3)} AS mape FROM k GROUP BY model, entity""")
def entity_errors(spark, folder):
    return E.entity_errors(forecasts(spark, folder), ["model"]).withColumn("mape", F.round("mape", 3))


@query("worst_predictions", f"""{PRED} SELECT entity, {BIG}, component, model, {r("y")} AS y, {r("yhat")} AS yhat, {r("abs(res)")} AS abs_error FROM k ORDER BY abs(res) DESC, entity, k.period, component, model LIMIT 20""")
def worst_predictions(spark, folder):
    return E.worst_predictions(forecasts(spark, folder))


@query("skill_scores", f"""{PRED}, t AS (SELECT model, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) AS r2 FROM k GROUP BY model)
SELECT a.model, {r("a.r2")} AS r2, {r("(a.r2 - b.r2) / (1 - b.r2)")} AS skill FROM t a, t b WHERE b.model = 'last' AND a.model <> 'last'""")
def skill_scores(spark, folder):
    return E.skill(settle(E.metric_summary(forecasts(spark, folder), ["model"])), "last")


SUBSETS = {"all": ["last", "mean", "ewma"], "only last": ["last"], "only mean": ["mean"], "only ewma": ["ewma"], "without last": ["mean", "ewma"], "without mean": ["last", "ewma"],
           "without ewma": ["last", "mean"], "last + mean": ["last", "mean"], "last + ewma": ["last", "ewma"], "mean + ewma": ["mean", "ewma"]}


@query("ablation", f"""{PRED}, w AS (SELECT entity, period, component, any_value(y) AS y, {", ".join(f"max(yhat) FILTER (WHERE model = '{m}') AS m_{m}" for m in ("last", "mean", "ewma"))} FROM k GROUP BY ALL),
s AS ({" UNION ALL ".join(f"SELECT '{n}' AS subset, y, ({' + '.join('m_' + m for m in ms)}) / {len(ms)} AS yhat FROM w" for n, ms in SUBSETS.items())})
SELECT subset, count(*) AS n, {r("1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*))")} AS r2, {r("sqrt(avg((y - yhat) ** 2))")} AS rmse, {r("avg(abs(y - yhat))")} AS mae FROM s GROUP BY subset""")
def ablation(spark, folder):
    return E.ablation(forecasts(spark, folder), ["last", "mean", "ewma"], ["entity", "period", "component"])


@query("metric_bootstrap")
def metric_bootstrap(spark, folder):
    return E.bootstrap(forecasts(spark, folder), ["model"], ["entity", "period", "component"], seed=11)


@query("payload_checks", f"""{PRED} SELECT count(*) AS n_rows, count(*) - count(y) AS y_missing, 0::BIGINT AS y_not_finite, count(*) - count(yhat) AS yhat_missing, 0::BIGINT AS yhat_not_finite, 0::BIGINT AS duplicate_keys FROM pred""")
def payload_checks(spark, folder):
    out = E.payload_checks(forecasts(spark, folder), ["y", "yhat"], ["entity", "period", "component", "model"])
    return out.na.fill(0)


@query("leave_one_entity_out", f"""{SAW}, t AS (SELECT component, sum(v) AS s, count(v) AS n FROM saw GROUP BY ALL), o AS (SELECT component, entity, sum(v) AS s, count(v) AS n FROM saw GROUP BY ALL HAVING count(v) > 0),
h AS (SELECT o.component, o.entity, (t.s - o.s) / (t.n - o.n) AS yhat FROM o JOIN t USING (component))
SELECT component, entity, {r("any_value(yhat)")} AS yhat, {r("sqrt(avg((v - yhat) ** 2))")} AS rmse FROM saw JOIN h USING (component, entity) WHERE v IS NOT NULL GROUP BY component, entity""")
def leave_one_entity_out(spark, folder):
    rows = unlong(X.saw_targets(components(spark, folder), CRITERIA), CRITERIA)
    rows = settle(rows.where("value IS NOT NULL").select("entity", F.col("indicator").alias("component"), F.col("value").alias("y")))
    return S.leave_one_out_errors(rows, ["component"])


# ---------------------------------------------------------------- intervals

LEVEL = "least(ceil(round(0.9 * (n + 1), 9)) / n, 1)"


def q_at(value, order, part, level, name):
    """CTE: linearly interpolated quantile at a level that depends on n."""
    return f"""{name}_o AS (SELECT {part}, {value} AS v, row_number() OVER (PARTITION BY {part} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {part}) AS n FROM {order}),
{name} AS (SELECT {part}, n, max(v) FILTER (WHERE i = floor({level} * (n - 1))) + (max(v) FILTER (WHERE i = ceil({level} * (n - 1))) - max(v) FILTER (WHERE i = floor({level} * (n - 1)))) * ({level} * (n - 1) - floor({level} * (n - 1))) AS q
  FROM {name}_o GROUP BY {part}, n)"""


SYM = f"{PRED}, {q_at('abs(res)', 'k', 'model, component', LEVEL, 'w')}"
KEY = ["model", "component"]


@query("conformal_symmetric", f"{SYM} SELECT model, component, n, {r('q')} AS half_width FROM w")
def conformal_symmetric(spark, folder):
    return I.symmetric(forecasts(spark, folder), KEY)


@query("conformal_asymmetric", f"""{PRED}, {q_at('res', 'k', 'model, component', 'greatest(floor(round(0.05 * (n + 1), 9)) / n, 0)', 'lo')}, {q_at('res', 'k', 'model, component', 'least(ceil(round(0.95 * (n + 1), 9)) / n, 1)', 'hi')}
SELECT model, component, lo.n, {r("lo.q")} AS low, {r("hi.q")} AS high FROM lo JOIN hi USING (model, component)""")
def conformal_asymmetric(spark, folder):
    return I.asymmetric(forecasts(spark, folder), KEY)


CAL = f"""{PRED}, per AS (SELECT model, component, period, count(*) AS c FROM pred GROUP BY ALL),
cut AS (SELECT model, component, period FROM (SELECT *, coalesce(sum(c) OVER (PARTITION BY model, component ORDER BY period DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later, sum(c) OVER (PARTITION BY model, component) AS t FROM per) WHERE later < greatest(5, 0.25 * t)),
cal AS MATERIALIZED (SELECT k.* FROM k JOIN cut USING (model, component, period))"""


@query("conformal_split", f"{CAL}, {q_at('abs(res)', 'cal', 'model, component', LEVEL, 'w')} SELECT model, component, n, {r('q')} AS half_width FROM w")
def conformal_split(spark, folder):
    """Half-widths from the last quarter of the rows."""
    return I.symmetric(I.split_calibration(forecasts(spark, folder), KEY), KEY)


@query("conformal_walk_forward", f"""{PRED}, late AS (SELECT * FROM k WHERE period IN (SELECT period FROM times WHERE pos >= 2)), {q_at('abs(res)', 'late', 'model, component', LEVEL, 'w')} SELECT model, component, n, {r('q')} AS half_width FROM w""")
def conformal_walk_forward(spark, folder):
    """Pooled residuals of the walk-forward folds with at least two training periods."""
    rows = forecasts(spark, folder)
    folds = S.fold_table(rows, min_train=2, max_folds=100).select(F.col("val_period").alias("period"))
    return I.symmetric(rows.join(folds, "period", "left_semi"), KEY)


INTERVALS = f"{SYM}, iv AS MATERIALIZED (SELECT p.*, yhat - q AS lower, yhat + q AS upper FROM pred p JOIN w USING (model, component))"


def intervals(spark, folder):
    rows = forecasts(spark, folder)
    return settle(I.predict(rows, I.symmetric(rows, KEY), KEY))


@query("predict_intervals", f"{INTERVALS} SELECT entity, {BIG}, component, model, {r('y')} AS y, {r('yhat')} AS yhat, {r('lower')} AS lower, {r('upper')} AS upper FROM iv")
def predict_intervals(spark, folder):
    return intervals(spark, folder)


@query("interval_coverage", f"""{INTERVALS} SELECT model, component, count(*) AS n, {r("avg((y >= lower - 1e-9 AND y <= upper + 1e-9)::INT)")} AS coverage, {r("avg(upper - lower)")} AS mean_width, avg((y >= lower - 1e-9 AND y <= upper + 1e-9)::INT) >= 0.8 AS passes
FROM iv WHERE y IS NOT NULL AND lower IS NOT NULL GROUP BY model, component""")
def interval_coverage(spark, folder):
    """Coverage of the truth; the bounds get 1e-9 of slack for the residual that sets them."""
    slack = intervals(spark, folder).withColumns({"lower": F.col("lower") - 1e-9, "upper": F.col("upper") + 1e-9})
    return I.coverage(slack, KEY)


@query("holdout_coverage", f"""{PRED}, past AS (SELECT * FROM k WHERE period < 2001), {q_at('abs(res)', 'past', 'model, component', LEVEL, 'w')},
h AS (SELECT p.*, yhat - q - 1e-9 AS lower, yhat + q + 1e-9 AS upper FROM pred p JOIN w USING (model, component) WHERE period = 2001 AND y IS NOT NULL AND yhat IS NOT NULL)
SELECT model, count(*) AS n, {r("avg((y BETWEEN lower AND upper)::INT)")} AS coverage, {r("avg(upper - lower)")} AS mean_width, avg((y BETWEEN lower AND upper)::INT) >= 0.8 AS passes FROM h GROUP BY model""")
def holdout_coverage(spark, folder):
    """Widths of the earlier periods against the truth of the last one."""
    rows = forecasts(spark, folder)
    out = I.predict(rows.where("period = 2001"), I.symmetric(rows.where("period < 2001"), KEY), KEY)
    return I.coverage(out.withColumns({"lower": F.col("lower") - 1e-9, "upper": F.col("upper") + 1e-9}), ["model"])


@query("interval_quality", f"""{INTERVALS}, c AS (SELECT model, y, lower - 1e-9 AS lo, upper + 1e-9 AS hi FROM iv WHERE y IS NOT NULL AND lower IS NOT NULL)
SELECT model, count(*) AS n, {r("avg((y >= lo AND y <= hi)::INT)")} AS coverage, {r("avg((y >= lo AND y <= hi)::INT) - 0.9")} AS gap, {r("avg(hi - lo)")} AS mean_width, {r("quantile_cont(round(hi - lo, 10), 0.5)")} AS median_width, {r("stddev_pop(hi - lo)")} AS sd_width,
  {r("avg(hi - lo + CASE WHEN y < lo THEN 20 * (lo - y) WHEN y > hi THEN 20 * (y - hi) ELSE 0 END)")} AS winkler FROM c GROUP BY model""")
def interval_quality(spark, folder):
    slack = intervals(spark, folder).withColumns({"lower": F.col("lower") - 1e-9, "upper": F.col("upper") + 1e-9})
    return E.interval_quality(slack, ["model"])


@query("interval_widths", f"""{INTERVALS}, c AS (SELECT component, round(upper - lower, 10) AS w FROM iv WHERE lower IS NOT NULL)
SELECT component, {r("avg(w)")} AS mean_width, {r("min(w)")} AS min_width, {r("max(w)")} AS max_width, {r("quantile_cont(w, 0.5)")} AS median_width FROM c GROUP BY component""")
def interval_widths(spark, folder):
    return E.width_summary(intervals(spark, folder))


@query("order_quantile", f"""{PRED}, o AS (SELECT model, component, abs(res) AS a, row_number() OVER (PARTITION BY model, component ORDER BY abs(res)) AS i, count(*) OVER (PARTITION BY model, component) AS n FROM k),
q AS (SELECT model, component, n, a AS q FROM o WHERE i = least(greatest(ceil((n + 1) * 0.9), 1), n))
SELECT model, component, any_value(q.n) AS n, {r("any_value(q)")} AS quantile, {r("avg((a <= q + 1e-12)::INT)")} AS coverage, {r("2 * any_value(q)")} AS width FROM o JOIN q USING (model, component) GROUP BY model, component""")
def order_quantile(spark, folder):
    return E.order_quantile(forecasts(spark, folder), KEY)


CURVE = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


@query("calibration_curve", f"""{PRED}, s AS (SELECT model, {", ".join(f"quantile_cont(res, {q}) AS {n}" for n, q in CURVE.items())} FROM k GROUP BY model),
c AS (SELECT y, {", ".join(f"yhat + {n} + 1e-9 AS {n}" for n in CURVE)} FROM k JOIN s USING (model) WHERE model = 'ewma')
{" UNION ALL ".join(f"SELECT {q}::DOUBLE AS level, {r(f'avg((y <= {n})::INT)')} AS observed, {r(f'abs({q} - avg((y <= {n})::INT))')} AS error FROM c" for n, q in CURVE.items())}""")
def calibration_curve(spark, folder):
    """Observed share of values below each predicted quantile of one model."""
    from panelwise.operators.ordered import group_quantiles

    rows = I.residuals(forecasts(spark, folder)).where("model = 'ewma'")
    shifts = settle(group_quantiles(settle(rows), ["model"], "residual", CURVE))
    shifted = rows.join(shifts, "model").withColumns({n: F.col("yhat") + F.col(n) + 1e-9 for n in CURVE})
    return E.calibration_curve(shifted, CURVE)


RATE = f"""{PRED}, rate AS MATERIALIZED (SELECT entity, period + 1 AS period, round((count(*) - count(value)) / count(*)::DOUBLE, 10) AS rate FROM obs GROUP BY entity, obs.period),
kr AS MATERIALIZED (SELECT k.*, rate FROM k JOIN rate USING (entity, period) WHERE model = 'ewma'),
ed AS (SELECT component, list_sort(list_distinct([min(rate), quantile_cont(rate, 1/3.0), quantile_cont(rate, 2/3.0), max(rate)])) AS edges FROM (SELECT component, rate FROM kr) GROUP BY component),
st AS MATERIALIZED (SELECT kr.*, least(len(list_filter(edges[2:], lambda e: round(e, 10) <= rate)), greatest(len(edges) - 2, 0)) AS stratum FROM kr JOIN ed USING (component)),
{q_at('abs(res)', 'st', 'component, stratum', LEVEL, 'ws')}, {q_at('abs(res)', 'st', 'component', LEVEL, 'wa')}"""


@query("conformal_by_missingness", f"""{RATE} SELECT ws.component, stratum::BIGINT AS stratum, ws.n, {r("CASE WHEN ws.n < 5 THEN wa.q ELSE ws.q END")} AS half_width FROM ws JOIN wa USING (component)""")
def conformal_by_missingness(spark, folder):
    """Half-widths by the share of indicators missing in the period before."""
    panel = panel_of(spark, folder)
    rate = panel.data.select("entity", (F.col("period") + 1).alias("period"), X.missing_share(panel.data, panel.indicators).alias("rate"))
    rows = forecasts(spark, folder).where("model = 'ewma'").join(rate, ["entity", "period"])
    return I.stratified(settle(rows), "rate", ["component"])[1]


BANDS = f"""{PRED}, bd AS (SELECT *, yhat + min(res) OVER b * 0.9 AS lo, yhat + max(res) OVER b * 0.9 AS hi FROM k WINDOW b AS (PARTITION BY model, component, entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sc AS MATERIALIZED (SELECT model, component, round(greatest(lo - y, y - hi), 10) AS score FROM bd WHERE lo IS NOT NULL), {q_at('score', 'sc', 'model, component', LEVEL, 'w')}"""


@query("conformal_quantile_regression", f"""{BANDS} SELECT model, component, any_value(w.n) AS n, {r("any_value(q)")} AS shift, {r("avg((score > 0)::INT)")} AS miss_rate FROM sc JOIN w USING (model, component) GROUP BY model, component""")
def conformal_quantile_regression(spark, folder):
    """Correction of bands that come from an entity's own earlier residuals."""
    return I.conformalised_quantiles(I.past_quantile_bands(forecasts(spark, folder), KEY), KEY)


@query("gaussian_intervals", f"""{PRED}, s AS (SELECT model, component, stddev_samp(res) AS sd FROM k GROUP BY ALL)
SELECT entity, {BIG}, component, model, {r("yhat - 1.6448536269514722 * sd")} AS lower, {r("yhat + 1.6448536269514722 * sd")} AS upper FROM pred JOIN s USING (model, component)""")
def gaussian_intervals(spark, folder):
    rows = forecasts(spark, folder)
    sd = I.residuals(rows).groupBy(*KEY).agg(F.stddev_samp("residual").alias("sd"))
    out = I.gaussian(rows.join(settle(sd), KEY), "sd")
    return out.select("entity", "period", "component", "model", "lower", "upper")
