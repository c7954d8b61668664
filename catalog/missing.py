"""Missing values: diagnosis, imputation and checks."""

from pyspark.sql import functions as F

from catalog.combination import CORR
from catalog.ranking import BIG, panel_of
from catalog.registry import query
from oracle.base import INDICATORS, long, r
from panelwise.operators import missing as J
from panelwise.operators.neighbours import nearest_entities
from panelwise.operators.views import availability_report, criterion_means, final_means
from panelwise.panel import to_long
from panelwise.session import settle

LONG = "WITH " + long()
COLS = ["I11", "I12", "I13", "I21", "I31", "I32"]  # no structural gap


def full_columns(spark, folder):
    return panel_of(spark, folder).data


@query("fill_with_means", f"""{LONG} SELECT entity, {BIG}, indicator, {r("coalesce(value, avg(value) OVER (PARTITION BY indicator), 0)")} AS value, (value IS NULL)::BIGINT AS missing FROM obs""")
def fill_with_means(spark, folder):
    panel = panel_of(spark, folder)
    out = J.fill_with_means(panel.data, panel.indicators, mask=True)
    cells = F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("value"), F.col(f"{c}_missing").alias("missing")) for c in panel.indicators])
    return out.select("entity", "period", F.inline(cells))


@query("missing_indicators", f"""{LONG} SELECT entity, {BIG}, {", ".join(f"({i} IS NULL)::BIGINT AS {i}_missing" for i in INDICATORS)} FROM panel""")
def missing_indicators(spark, folder):
    panel = panel_of(spark, folder)
    return J.missing_indicators(panel.data, panel.indicators, ["entity", "period"])


@query("fallback_values", f"""{LONG} SELECT {", ".join(f"{r(f'coalesce(avg({i}), 0)')} AS {i}" for i in INDICATORS)} FROM panel""")
def fallback_values(spark, folder):
    panel = panel_of(spark, folder)
    return J.fallback_values(panel.data, panel.indicators)


@query("mcar_statistic", f"""{LONG}, pt AS (SELECT entity, period, string_agg(CASE WHEN value IS NULL THEN '1' ELSE '0' END, '' ORDER BY indicator) AS pat FROM obs GROUP BY ALL),
g AS (SELECT pat, indicator, count(value) AS n, avg(value) AS m FROM obs JOIN pt USING (entity, period) GROUP BY ALL),
w AS (SELECT indicator, avg(value) AS a, var_pop(value) AS v FROM obs GROUP BY ALL),
j AS (SELECT indicator, count(m) AS k, sum(n * (m - a) ** 2) AS s FROM g JOIN w USING (indicator) GROUP BY indicator)
SELECT {r("sum(s) FILTER (WHERE k >= 2) / (SELECT avg(v) FROM w)")} AS chi2, (sum(k - 1) FILTER (WHERE k >= 2))::BIGINT AS df, (SELECT count(DISTINCT pat) FROM pt) AS n_patterns FROM j""")
def mcar_statistic(spark, folder):
    panel = panel_of(spark, folder)
    return J.little_statistic(panel.data, panel.indicators)


@query("selection_index", f"""{LONG}, f AS (SELECT entity, period FROM obs GROUP BY ALL HAVING count(value) = count(*))
SELECT indicator, {r("abs(avg(value) FILTER (WHERE f.entity IS NOT NULL) - avg(value)) / stddev_pop(value)")} AS shift FROM obs LEFT JOIN f USING (entity, period) GROUP BY indicator""")
def selection_index(spark, folder):
    panel = panel_of(spark, folder)
    return J.selection_index(panel.data, panel.indicators)


@query("missing_flag_regressions")
def missing_flag_regressions(spark, folder):
    panel = panel_of(spark, folder)
    return J.flag_regressions(panel.data, panel.indicators)


@query("missing_mechanism")
def missing_mechanism(spark, folder):
    panel = panel_of(spark, folder)
    return J.mechanism(panel.data, panel.indicators)


INTER = f"""{LONG}, nr AS (SELECT *, row_number() OVER (PARTITION BY entity, indicator ORDER BY period) AS i FROM obs),
b AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS x0, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0,
  first_value(value IGNORE NULLS) OVER f AS x1, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER f AS i1 FROM nr
  WINDOW p AS (PARTITION BY entity, indicator ORDER BY period ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY entity, indicator ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ip AS MATERIALIZED (SELECT entity, period, indicator, criterion, coalesce(value, CASE WHEN i1 <> i0 THEN x0 + (x1 - x0) * ((i - i0) / (i1 - i0)::DOUBLE) END, x0, x1) AS value, value AS old FROM b)"""


@query("interpolate_in_time", f"{INTER} SELECT entity, {BIG}, indicator, {r('value')} AS value FROM ip")
def interpolate_in_time(spark, folder):
    panel = panel_of(spark, folder)
    return to_long(J.interpolate(panel.data, panel.indicators), panel.indicators)


def filled(spark, folder):
    panel = panel_of(spark, folder)
    return panel, panel.with_data(settle(J.interpolate(panel.data, panel.indicators)))


@query("imputed_criterion_means", f"""{INTER}, c AS (SELECT entity, period, criterion, avg(value) AS v FROM ip GROUP BY ALL)
SELECT entity, {BIG}, {r("avg(v)")} AS final, count(v) AS n_criteria FROM c GROUP BY entity, period""")
def imputed_criterion_means(spark, folder):
    """Criterion and final views rebuilt on the imputed panel."""
    return final_means(filled(spark, folder)[1])


@query("imputed_availability", f"""{INTER}, e AS (SELECT period, entity, count(value) > 0 AS a FROM ip GROUP BY ALL), i AS (SELECT period, criterion, indicator, count(value) > 0 AS a FROM ip GROUP BY ALL)
SELECT {BIG}, (SELECT count(*) FROM e WHERE e.period = i.period AND a) AS n_active_entities, count(*) FILTER (WHERE a) AS n_active_indicators, count(DISTINCT criterion) FILTER (WHERE a) AS n_active_criteria FROM i GROUP BY i.period""")
def imputed_availability(spark, folder):
    """Availability rebuilt on the imputed panel."""
    return availability_report(filled(spark, folder)[1]).select("period", "n_active_entities", "n_active_indicators", "n_active_criteria")


@query("imputation_completeness", f"""{INTER} SELECT {BIG}, indicator, count(*) - count(old) AS missing_before, count(*) - count(value) AS missing_after FROM ip GROUP BY period, indicator""")
def imputation_completeness(spark, folder):
    before, after = filled(spark, folder)
    return J.completeness(before.data, after.data, before.indicators)


@query("imputation_drift", f"""{INTER}, s AS (SELECT indicator, round(old, 8) AS o, round(value, 8) AS v FROM ip)
SELECT indicator, count(o) AS n_before, count(v) AS n_after, {r("avg(o)")} AS mean_before, {r("avg(v)")} AS mean_after, {r("stddev_pop(o)")} AS sd_before, {r("stddev_pop(v)")} AS sd_after,
  {r("quantile_cont(o, 0.5)")} AS median_before, {r("quantile_cont(v, 0.5)")} AS median_after, {r("coalesce(abs(avg(v) - avg(o)) / stddev_pop(o), 0)")} AS mean_shift, {r("stddev_pop(v) / stddev_pop(o)")} AS sd_ratio FROM s GROUP BY indicator""")
def imputation_drift(spark, folder):
    before, after = filled(spark, folder)
    return J.drift(before.data, after.data, before.indicators)


@query("imputation_correlation_drift", f"""{INTER}, p AS (SELECT a.indicator AS a, b.indicator AS b, a.old AS ao, b.old AS bo, a.value AS av, b.value AS bv FROM ip a JOIN ip b USING (entity, period) WHERE a.indicator < b.indicator),
o AS (SELECT a, b, {CORR.format(a="ao", b="bo")} AS r FROM p WHERE ao IS NOT NULL AND bo IS NOT NULL GROUP BY a, b), n AS (SELECT a, b, {CORR.format(a="av", b="bv")} AS r FROM p WHERE av IS NOT NULL AND bv IS NOT NULL GROUP BY a, b)
SELECT a, b, {r("o.r")} AS r_before, {r("n.r")} AS r_after, {r("abs(n.r - o.r)")} AS change FROM o JOIN n USING (a, b)""")
def imputation_correlation_drift(spark, folder):
    before, after = filled(spark, folder)
    return J.correlation_drift(before.data, after.data, before.indicators)


@query("imputation_leakage", f"{INTER} SELECT entity, {BIG}, indicator, {r('old')} AS value, {r('value')} AS new FROM ip WHERE old IS NOT NULL AND abs(old - value) > 1e-9 * greatest(abs(old), 1)")
def imputation_leakage(spark, folder):
    """Observed cells changed by the imputation: must be empty."""
    before, after = filled(spark, folder)
    return J.kept_cells_changed(before.data, after.data, before.indicators)


#: Rounds for those that run until the tolerance ends them; ``last_change`` of the result shows that it did.
ROUNDS = 1_000
WITH_CHANGE = ("entity", "period", "last_change")


@query("chained_imputation")
def chained_imputation(spark, folder):
    panel = panel_of(spark, folder)
    return to_long(J.chained_equations(panel.data, panel.indicators, rounds=ROUNDS, change_as="last_change"), panel.indicators, ids=WITH_CHANGE)


@query("panel_imputation")
def panel_imputation(spark, folder):
    """Interpolation in time, then the nearest entities of the period, then chained equations."""
    panel = panel_of(spark, folder)
    return to_long(J.impute_panel(panel.data, panel.indicators, rounds=ROUNDS, change_as="last_change"), panel.indicators, ids=WITH_CHANGE)


#: Distances to all donors of the period on shared columns, in standard deviations of the column.
NEAR = ", ".join(f"stddev_pop({i}) AS {i}" for i in INDICATORS)
SQUARES = " + ".join(f"coalesce((a.{i} / s.{i} - b.{i} / s.{i}) ** 2, 0)" for i in INDICATORS)
SHARED = " + ".join(f"(a.{i} IS NOT NULL AND b.{i} IS NOT NULL)::INT" for i in INDICATORS)


@query("nearest_entity_imputation", f"""{LONG}, s AS (SELECT {NEAR} FROM panel),
d AS (SELECT a.entity, a.period, b.entity AS donor, round(({SQUARES}) * {len(INDICATORS)} / ({SHARED}), 9) AS far FROM panel a JOIN panel b ON a.period = b.period AND a.entity <> b.entity, s WHERE {SHARED} > 0),
n AS (SELECT d.entity, d.period, o.indicator, o.value, row_number() OVER (PARTITION BY d.entity, d.period, o.indicator ORDER BY far, donor) AS place
  FROM d JOIN obs o ON o.entity = d.donor AND o.period = d.period AND o.value IS NOT NULL JOIN obs q ON q.entity = d.entity AND q.period = d.period AND q.indicator = o.indicator AND q.value IS NULL),
m AS (SELECT entity, period, indicator, avg(value) AS value FROM n WHERE place <= 5 GROUP BY ALL)
SELECT entity, {BIG}, indicator, {r("coalesce(o.value, m.value)")} AS value FROM obs o LEFT JOIN m USING (entity, period, indicator)""")
def nearest_entity_imputation(spark, folder):
    """Gaps from the five nearest entities of the period."""
    panel = panel_of(spark, folder)
    return to_long(nearest_entities(panel.data, panel.indicators, 5), panel.indicators)


@query("low_rank_imputation")
def low_rank_imputation(spark, folder):
    panel = panel_of(spark, folder)
    return to_long(J.soft_impute(panel.data, panel.indicators, rounds=ROUNDS, change_as="last_change"), panel.indicators, ids=WITH_CHANGE)


def imputations(spark, folder):
    """Five proper imputations of the panel."""
    panel = panel_of(spark, folder)
    return panel, settle(J.multiple_imputations(panel.data, panel.indicators, [1, 2, 3, 4, 5], rounds=ROUNDS, change_as="last_change"))


@query("pooled_imputations")
def pooled_imputations(spark, folder):
    """Means of the indicators over five imputations, by Rubin's rules."""
    panel, stacked = imputations(spark, folder)
    rows = to_long(stacked, panel.indicators, ids=("entity", "period", "imputation"))
    per = rows.groupBy("imputation", "indicator").agg(
        F.avg("value").alias("estimate"), (F.var_samp("value") / F.count("value")).alias("variance")
    )
    return J.pool(per, ["indicator"]).withColumn("last_change", F.lit(stacked.agg(F.max("last_change")).first()[0]))


@query("pooled_regression")
def pooled_regression(spark, folder):
    """The first indicator on the others, a model for each of five imputations, coefficients pooled by Rubin's rules."""
    panel, stacked = imputations(spark, folder)
    return J.pooled_regression(stacked, panel.indicators[0], panel.indicators[1:])


@query("rubin_pooling", f"""{LONG}, sc AS (SELECT indicator, period, (value - min(value) OVER (PARTITION BY indicator)) / (max(value) OVER (PARTITION BY indicator) - min(value) OVER (PARTITION BY indicator)) AS value FROM obs),
e AS (SELECT indicator, period, avg(value) AS est, var_samp(value) / count(value) AS va FROM sc WHERE value IS NOT NULL GROUP BY ALL),
q AS (SELECT indicator, avg(est) AS p, avg(va) AS w, coalesce(var_samp(est), 0) AS b, count(*) AS m FROM e GROUP BY indicator)
SELECT indicator, {r("p")} AS pooled, {r("w")} AS within, {r("b")} AS between, {r("w + (1 + 1.0::DOUBLE / m) * b")} AS total, {r("(1 + 1.0::DOUBLE / m) * b / (w + (1 + 1.0::DOUBLE / m) * b)")} AS missing_information FROM q""")
def rubin_pooling(spark, folder):
    """The pooling rules with periods in the place of imputations."""
    from panelwise.operators.scaling import global_min_max

    panel = panel_of(spark, folder)
    rows = panel.with_data(global_min_max(panel.data, panel.indicators)).long(keep_missing=False)
    per = rows.groupBy("indicator", "period").agg(
        F.avg("value").alias("estimate"), (F.var_samp("value") / F.count("value")).alias("variance")
    )
    return J.pool(per, ["indicator"])


def imputed_means(spark, folder):
    return criterion_means(filled(spark, folder)[1])


@query("tensor_completion")
def tensor_completion(spark, folder):
    """Low-rank model over entity, period and indicator."""
    from panelwise.operators.tensor import complete_tensor

    panel = panel_of(spark, folder)
    return to_long(complete_tensor(panel.data, panel.indicators, rounds=ROUNDS, change_as="last_change"), panel.indicators, ids=WITH_CHANGE)
