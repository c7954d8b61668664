"""Agreement, re-weighting, report tables, several periods, stability.

The report queries use the five closed-form methods; the six-method run is
``rank_suppliers`` and ``method_scores``.
"""

from pyspark.sql import functions as F

from catalog.ranking import (
    BIG, CLEAN, ONE, SCALED, PREFERENCES, VIKOR, one_matrix, panel_of, scaled_long, scaled_weights,
)
from catalog.registry import query
from oracle.base import (
    COMPOSITE, CRITERIA, SIX, INDICATORS, avg_rank, min_rank, noise, pair_flows, r, scores, trunc_rank, weights,
)
from panelwise.functions.guards import score_key
from panelwise.operators import combine as B
from panelwise.operators import critic as C
from panelwise.operators import methods as M
from panelwise.operators import promethee as P
from panelwise.operators import reports as T
from panelwise.operators import stability as S
from panelwise.plans import ranking as R
from panelwise.session import settle

SCORES = "WITH " + scores()
RANKED = f"""{SCORES}, {COMPOSITE}, ranked AS MATERIALIZED (SELECT period, entity, composite, n_criteria, {trunc_rank("composite", "period")} AS rank FROM comp)""".replace(
    "ranked AS (SELECT *, CASE", "ranked0 AS (SELECT *, CASE").replace("FROM ranked u", "FROM ranked0 u")
PERIODS = list(range(1995, 2002))


def inputs(spark, folder, ranked=True):
    panel = panel_of(spark, folder)
    w = C.two_level_weights(panel)
    return settle(R.method_scores(panel, w, SIX, ranked=ranked))


def both(spark, folder):
    scores = inputs(spark, folder)
    return scores, settle(R.composite_ranks(scores))


# ----------------------------------------------------------------- agreement

W = "least(greatest(12 * var_pop(s) * count(*) / (max(k) * max(k) * (count(*)::DOUBLE * count(*) * count(*) - count(*))), 0), 1)"


@query("kendall_w_pooled", f"""{SCORES}, t AS (SELECT period, criterion, entity, sum(rank)::DOUBLE AS s, count(*)::DOUBLE AS k FROM scores GROUP BY ALL)
SELECT {BIG}, count(*) AS n_items, {r(W)} AS kendall_w FROM t GROUP BY period""")
def kendall_w_pooled(spark, folder):
    """Concordance of the methods, ranks of all criteria pooled into one item list."""
    return B.kendall_w(inputs(spark, folder), ["period"], ["criterion", "entity"], "method")


@query("kendall_w_by_criterion", f"""{SCORES}, t AS (SELECT period, criterion, entity, sum(rank)::DOUBLE AS s, count(*)::DOUBLE AS k FROM scores GROUP BY ALL)
SELECT {BIG}, criterion, count(*) AS n_items, {r(W)} AS kendall_w FROM t GROUP BY period, criterion""")
def kendall_w_by_criterion(spark, folder):
    return B.kendall_w(inputs(spark, folder), ["period", "criterion"], ["entity"], "method")


REWEIGHED = f"""{SCORES}, yw(scenario, criterion, w) AS (VALUES {", ".join(f"({s}, '{k}', {1.0 + (s * n) % 4}::DOUBLE)" for s in (1, 2, 3) for n, k in enumerate(CRITERIA))}),
m AS (SELECT period, entity, criterion, avg(score) AS mean FROM scores GROUP BY ALL),
re AS MATERIALIZED (SELECT scenario, period, entity, sum(mean * w / t) AS composite FROM m JOIN yw USING (criterion)
  JOIN (SELECT scenario, sum(w) AS t FROM yw GROUP BY ALL) USING (scenario) GROUP BY ALL)"""


@query("reweighed_composites", f"""{REWEIGHED} SELECT scenario::BIGINT AS scenario, {BIG}, entity, {r("composite")} AS composite,
  {trunc_rank("composite", "scenario, period")} AS rank FROM re""")
def reweighed_composites(spark, folder):
    """Stored method scores under three other weightings, without running the methods."""
    scores = inputs(spark, folder, ranked=False)
    rows = [(s, k, 1.0 + (s * n) % 4) for s in (1, 2, 3) for n, k in enumerate(CRITERIA)]
    return B.reweigh(B.criterion_scores(scores), spark.createDataFrame(rows, "scenario int, criterion string, w double"))


TOPSIS_VIKOR = f"""{VIKOR}, t0 AS (SELECT *, x / sqrt(sum(x * x) OVER g) * w AS v FROM x WINDOW g AS (PARTITION BY period, indicator)),
t1 AS (SELECT *, CASE WHEN cost THEN min(v) OVER g ELSE max(v) OVER g END AS hi, CASE WHEN cost THEN max(v) OVER g ELSE min(v) OVER g END AS lo FROM t0 WINDOW g AS (PARTITION BY period, indicator)),
t2 AS (SELECT period, entity, sqrt(sum((v - hi) * (v - hi))) AS dp, sqrt(sum((v - lo) * (v - lo))) AS dn FROM t1 GROUP BY ALL),
t3 AS (SELECT period, entity, {trunc_rank("dn / (dp + dn)", "period")} AS topsis_rank, dn / (dp + dn) AS topsis FROM t2),
tv AS MATERIALIZED (SELECT period, entity, topsis, q, topsis_rank, rank AS vikor_rank FROM t3 JOIN vr USING (period, entity))"""
CORR = "coalesce(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), NULL)"


def topsis_vikor(spark, folder):
    t = one_matrix(spark, folder, "topsis").select("period", "entity", F.col("rank").alias("topsis_rank"))
    v = one_matrix(spark, folder, "vikor").select("period", "entity", F.col("rank").alias("vikor_rank"))
    return settle(t.join(v, ["period", "entity"]))


@query("compare_topsis_vikor", f"""{TOPSIS_VIKOR}, rk AS (SELECT *, {avg_rank("topsis_rank", "period")} AS a, {avg_rank("vikor_rank", "period")} AS b FROM tv)
SELECT {BIG}, {r("avg(abs(topsis_rank - vikor_rank))")} AS mean_difference, max(abs(topsis_rank - vikor_rank)) AS max_difference,
  count(*) FILTER (WHERE abs(topsis_rank - vikor_rank) > 5) AS n_major, {r(CORR.format(a="a", b="b"))} AS rho FROM rk GROUP BY period""")
def compare_topsis_vikor(spark, folder):
    return B.compare_rankings(topsis_vikor(spark, folder), ["period"], "topsis_rank", "vikor_rank")


@query("major_disagreements", f"""{TOPSIS_VIKOR} SELECT {BIG}, entity, topsis_rank, vikor_rank, abs(topsis_rank - vikor_rank) AS difference
FROM tv WHERE abs(topsis_rank - vikor_rank) > 5""")
def major_disagreements(spark, folder):
    return B.major_disagreements(topsis_vikor(spark, folder), "topsis_rank", "vikor_rank")


# ------------------------------------------------------------- report tables


@query("final_ranking", f"""{RANKED}, t AS (SELECT period, criterion, entity, sum(rank)::DOUBLE AS s, count(*)::DOUBLE AS k FROM scores GROUP BY ALL),
kw AS (SELECT period, {W} AS kendall_w FROM t GROUP BY period)
SELECT {BIG}, entity, {r("composite")} AS composite, rank, {r("(count(*) OVER g - rank + 1) / (count(*) OVER g)::DOUBLE * 100")} AS percentile,
  {r("(composite - avg(composite) OVER g) / stddev_samp(composite) OVER g")} AS z_score,
  CASE WHEN rank <= count(*) OVER g * 0.1 THEN 'Elite' WHEN rank <= count(*) OVER g * 0.25 THEN 'High' WHEN rank <= count(*) OVER g * 0.5 THEN 'Upper-Mid'
    WHEN rank <= count(*) OVER g * 0.75 THEN 'Lower-Mid' ELSE 'Low' END AS tier, {r("kendall_w")} AS kendall_w
FROM ranked JOIN kw USING (period) WINDOW g AS (PARTITION BY period)""")
def final_ranking(spark, folder):
    scores, ranked = both(spark, folder)
    return T.final_ranking(ranked, settle(B.kendall_w(scores, ["period"], ["criterion", "entity"], "method")))


def cols(expr, keys, name="{}"):
    return ", ".join(f"{expr.format(k)} AS {name.format(k)}" for k in keys)


@query("scores_by_criterion", f"""{SCORES} SELECT {BIG}, criterion, entity, {cols(r("max(score) FILTER (WHERE method = '{}')"), SIX)}
FROM scores GROUP BY period, criterion, entity""")
def scores_by_criterion(spark, folder):
    return T.scores_by_criterion(inputs(spark, folder, ranked=False), SIX)


@query("mean_method_scores", f"""{RANKED}, m AS (SELECT period, entity, {cols("avg(score) FILTER (WHERE method = '{}')", SIX)} FROM scores GROUP BY ALL)
SELECT {BIG}, entity, {cols(r("{}"), SIX)}, {r("composite")} AS composite, rank FROM m JOIN ranked USING (period, entity)""")
def mean_method_scores(spark, folder):
    scores, ranked = both(spark, folder)
    return T.mean_method_scores(scores, ranked, SIX)


@query("top_by_mean_score", f"""{SCORES}, m AS (SELECT period, entity, {cols("avg(score) FILTER (WHERE method = '{}')", SIX)}, avg(score) AS mean_score FROM scores GROUP BY ALL)
SELECT * FROM (SELECT {BIG}, entity, {cols(r("{}"), SIX)}, {r("mean_score")} AS mean_score FROM m
  QUALIFY row_number() OVER (PARTITION BY period ORDER BY round(mean_score, 10) DESC, entity) = 1)""")
def top_by_mean_score(spark, folder):
    return T.top_by_mean_score(inputs(spark, folder, ranked=False), SIX)


@query("rank_comparison", f"""{SCORES} SELECT {BIG}, entity, {r("avg(rank)")} AS mean_rank, {r("quantile_cont(rank::DOUBLE, 0.5)")} AS median_rank, {r("stddev_samp(rank)")} AS sd_rank,
  min(rank) AS best_rank, max(rank) AS worst_rank, max(rank) - min(rank) AS rank_range FROM scores GROUP BY period, entity""")
def rank_comparison(spark, folder):
    return T.rank_comparison(inputs(spark, folder))


@query("score_matrix", f"""{RANKED} SELECT entity, {cols(r("max(composite) FILTER (WHERE period = {})"), PERIODS, "p{}")}, {r("avg(composite)")} AS mean_score,
  {r("regr_slope(composite, period)")} AS trend FROM ranked GROUP BY entity""")
def score_matrix(spark, folder):
    _, ranked = both(spark, folder)
    return T.score_matrix(ranked, T.periods_of(ranked))


@query("rank_matrix", f"""{RANKED} SELECT entity, {cols("max(rank) FILTER (WHERE period = {})", PERIODS, "p{}")}, {r("avg(rank)")} AS mean_rank,
  {r("stddev_samp(rank)")} AS volatility, (min(rank * 10000 + period) % 10000)::BIGINT AS best_period FROM ranked GROUP BY entity""")
def rank_matrix(spark, folder):
    _, ranked = both(spark, folder)
    return T.rank_matrix_by_period(ranked, T.periods_of(ranked))


COMPARISON = f"""{RANKED}, nk AS (SELECT period, count(DISTINCT criterion) AS n FROM scores GROUP BY ALL),
mc AS (SELECT period, entity, method, sum(score) / max(n) AS score FROM scores JOIN nk USING (period) GROUP BY ALL),
mr AS MATERIALIZED (SELECT *, {min_rank("score", "period, method")} AS rank FROM mc)"""


@query("composite_comparison", f"""{COMPARISON} SELECT c.period::BIGINT AS period, c.entity, {cols(r("max(c.score) FILTER (WHERE method = '{}')"), SIX)}, {cols("max(c.rank) FILTER (WHERE method = '{}')", SIX, "{}_rank")},
  {r("avg(c.score)")} AS mean_method_score, max(c.rank) - min(c.rank) AS rank_range, {r("any_value(composite)")} AS composite, any_value(d.rank) AS composite_rank
FROM mr c JOIN ranked d USING (period, entity) GROUP BY c.period, c.entity""")
def composite_comparison(spark, folder):
    scores, ranked = both(spark, folder)
    return T.composite_comparison(scores, ranked, SIX)


@query("method_against_composite", f"""{COMPARISON}, p AS (SELECT c.period, method, c.rank AS x, d.rank AS y FROM mr c JOIN ranked d USING (period, entity)),
q AS (SELECT period, method, {avg_rank("x", "period, method")} AS a, {avg_rank("y", "period, method")} AS b FROM p)
SELECT {BIG}, method, {r(CORR.format(a="a", b="b"))} AS rho FROM q GROUP BY period, method""")
def method_against_composite(spark, folder):
    scores, ranked = both(spark, folder)
    return T.method_against_composite(T.composite_comparison(scores, ranked, SIX), SIX)


GW_ALL = f"""g AS (SELECT 0 AS fit, h.indicator, h.criterion, coalesce(g.weight, 0) AS weight, coalesce(c.weight, 0) AS criterion_weight, coalesce(g.local_weight, 0) AS local_weight
  FROM hier h LEFT JOIN gw g USING (indicator) LEFT JOIN cw c ON c.criterion = h.criterion)"""


@query("weight_table", f"""WITH {weights()}, {GW_ALL}
SELECT fit::BIGINT AS fit, indicator, criterion, {r("weight")} AS weight, {r("criterion_weight")} AS criterion_weight, {r("local_weight")} AS local_weight, {min_rank("weight", "fit")} AS rank FROM g
UNION ALL SELECT 0, '[criterion]', criterion, {r("weight")}, {r("weight")}, {r("weight")}, 0 FROM cw""")
def weight_table(spark, folder):
    w = C.two_level_weights(panel_of(spark, folder))
    return T.weight_table(w.long(), w.criteria_long())


YW = f"""WITH {weights(per_period=True)}, fits AS (SELECT DISTINCT fit FROM cw),
yg AS (SELECT f.fit, h.indicator, coalesce(g.weight, 0) AS weight, coalesce(g.local_weight, 0) AS local_weight FROM fits f CROSS JOIN hier h LEFT JOIN gw g ON g.fit = f.fit AND g.indicator = h.indicator),
yc AS MATERIALIZED (SELECT f.fit, k.criterion, coalesce(c.weight, 0) AS weight FROM fits f CROSS JOIN (SELECT DISTINCT criterion FROM hier) k LEFT JOIN cw c ON c.fit = f.fit AND c.criterion = k.criterion)"""


def yearly(spark, folder):
    return C.two_level_weights(panel_of(spark, folder), per_period=True)


for _name, _table, _key, _value in (
    ("indicator_weight_matrix", "yg", "indicator", "weight"),
    ("local_weight_matrix", "yg", "indicator", "local_weight"),
    ("criterion_weight_matrix", "yc", "criterion", "weight"),
):
    query(_name, f"""{YW} SELECT {_key}, {cols(r(f"max({_value}) FILTER (WHERE fit = {{}})"), PERIODS, "p{}")}, {r(f"avg({_value})")} AS mean, {r(f"stddev_samp({_value})")} AS sd FROM {_table} GROUP BY {_key}""")(
        lambda spark, folder, k=_key, v=_value: T.weight_matrix(
            (lambda w: w.long() if k == "indicator" else w.criteria_long())(yearly(spark, folder)), k, v, PERIODS)
    )


@query("method_ranks_matrix", f"""{SCORES} SELECT {BIG}, criterion, entity, {cols("max(rank) FILTER (WHERE method = '{}')", SIX)} FROM scores GROUP BY period, criterion, entity""")
def method_ranks_matrix(spark, folder):
    return T.wide(inputs(spark, folder), ["period", "criterion", "entity"], "method", "rank", SIX)


# ------------------------------------------------------ tables behind charts


@query("method_agreement", f"""{SCORES}, i AS (SELECT period, criterion, entity, method, {avg_rank("round(score, 10)", "period, criterion, method", False)} AS rr FROM scores),
g AS (SELECT *, {avg_rank("rr", "method", False)} AS g FROM i)
SELECT a.method AS a, b.method AS b, {r(CORR.format(a="a.g", b="b.g"))} AS rho FROM g a JOIN g b USING (period, criterion, entity) WHERE a.method < b.method GROUP BY ALL""")
def method_agreement(spark, folder):
    return T.method_agreement(inputs(spark, folder, ranked=False), SIX)


@query("stability_across_criteria", f"""{SCORES}, p AS (SELECT a.period, a.method, a.criterion AS ca, b.criterion AS cb, round(a.score, 10) AS x, round(b.score, 10) AS y
  FROM scores a JOIN scores b USING (period, method, entity) WHERE a.criterion < b.criterion),
q AS (SELECT period, method, ca, cb, {avg_rank("x", "period, method, ca, cb")} AS a, {avg_rank("y", "period, method, ca, cb")} AS b FROM p),
zz AS (SELECT period, method, ca, cb, {CORR.format(a="a", b="b")} AS rho FROM q GROUP BY ALL)
SELECT {BIG}, method, {r("avg(rho)")} AS mean_rho, count(rho) AS n_pairs FROM zz GROUP BY period, method""")
def stability_across_criteria(spark, folder):
    return T.stability_across_criteria(inputs(spark, folder, ranked=False))


@query("ranking_persistence", f"""{SCORES}, p AS (SELECT a.period, a.criterion, a.method, round(a.score, 10) AS x, round(b.score, 10) AS y
  FROM scores a JOIN scores b ON a.criterion = b.criterion AND a.method = b.method AND a.entity = b.entity AND b.period = a.period + 1),
q AS (SELECT period, criterion, method, {avg_rank("x", "period, criterion, method")} AS a, {avg_rank("y", "period, criterion, method")} AS b FROM p),
zz AS (SELECT period, criterion, method, {CORR.format(a="a", b="b")} AS rho FROM q GROUP BY ALL)
SELECT method, {r("avg(rho)")} AS mean_rho, count(rho) AS n_pairs FROM zz GROUP BY method""")
def ranking_persistence(spark, folder):
    return T.persistence(inputs(spark, folder, ranked=False))


@query("discriminating_power", f"""{SCORES}, c AS (SELECT period, method, entity, round(sum(score * criterion_weight) / sum(criterion_weight), 10) AS v FROM scores GROUP BY ALL HAVING sum(criterion_weight) > 0)
SELECT {BIG}, method, {r("quantile_cont(v, 0.25)")} AS q25, {r("quantile_cont(v, 0.75)")} AS q75, {r("quantile_cont(v, 0.75) - quantile_cont(v, 0.25)")} AS iqr FROM c GROUP BY period, method""")
def discriminating_power(spark, folder):
    return T.discriminating_power(inputs(spark, folder, ranked=False))


@query("score_histogram", f"""{SCORES} SELECT method, least(floor(round(score, 10) * 20), 19)::BIGINT AS bin, count(*) AS n FROM scores GROUP BY 1, 2""")
def score_histogram(spark, folder):
    return T.score_histogram(inputs(spark, folder, ranked=False))


@query("score_distribution", f"""{SCORES}, s AS (SELECT method, round(score, 10) AS v FROM scores)
SELECT method, count(*) AS n, {r("quantile_cont(v, 0.25)")} AS q25, {r("quantile_cont(v, 0.5)")} AS median, {r("quantile_cont(v, 0.75)")} AS q75,
  {r("avg(v)")} AS mean, {r("stddev_pop(v)")} AS sd, {r("min(v)")} AS min, {r("max(v)")} AS max FROM s GROUP BY method""")
def score_distribution(spark, folder):
    return T.score_distribution(inputs(spark, folder, ranked=False))


@query("rank_profiles", f"""{RANKED}, p AS (SELECT s.period, s.entity, d.rank AS composite_rank, s.method, avg(s.rank) AS mean_rank FROM scores s JOIN ranked d USING (period, entity) WHERE d.rank <= 15 GROUP BY ALL)
SELECT {BIG}, entity, composite_rank, method, {r("mean_rank")} AS mean_rank, {r("var_pop(mean_rank) OVER (PARTITION BY period, entity)")} AS rank_variance FROM p""")
def rank_profiles(spark, folder):
    scores, ranked = both(spark, folder)
    return T.rank_profiles(scores, ranked)


@query("method_fit", f"""{SCORES}, p AS (SELECT a.criterion, a.score AS x, b.score AS y FROM scores a JOIN scores b USING (period, criterion, entity) WHERE a.method = 'topsis' AND b.method = 'vikor')
SELECT criterion, {r("regr_slope(y, x)")} AS slope, {r("regr_intercept(y, x)")} AS intercept, {r(CORR.format(a="x", b="y"))} AS r, count(*) AS n FROM p GROUP BY criterion""")
def method_fit(spark, folder):
    return T.method_fit(inputs(spark, folder, ranked=False), "topsis", "vikor")


@query("method_robustness", f"""{SCORES} SELECT {BIG}, criterion, method, {r("greatest(1 - stddev_pop(score) / (avg(score) + 1e-10), 0)")} AS robustness FROM scores GROUP BY period, criterion, method""")
def method_robustness(spark, folder):
    return T.method_robustness(inputs(spark, folder, ranked=False))


@query("weight_deviation", f"""{YW} SELECT fit::BIGINT AS fit, criterion, {r("weight")} AS weight, {r("weight - 1.0::DOUBLE / count(*) OVER (PARTITION BY fit)")} AS deviation FROM yc""")
def weight_deviation(spark, folder):
    return T.weight_deviation(yearly(spark, folder).criteria_long())


@query("rank_volatility", f"""{RANKED} SELECT entity, {r("stddev_samp(rank)")} AS volatility, {r("avg((rank <= 10)::INT::DOUBLE)")} AS share_top, count(*) AS n_periods FROM ranked GROUP BY entity""")
def rank_volatility(spark, folder):
    return T.rank_volatility(both(spark, folder)[1])


@query("rank_slopegraph", f"""{RANKED} SELECT entity, {BIG}, rank FROM ranked WHERE entity IN (SELECT entity FROM ranked WHERE rank <= 10 AND period = (SELECT max(period) FROM ranked))""")
def rank_slopegraph(spark, folder):
    return T.slopegraph(both(spark, folder)[1])


@query("rank_change", f"""{RANKED} SELECT a.entity, a.rank AS rank_before, b.rank AS rank_after, a.rank - b.rank AS change
FROM ranked a JOIN ranked b USING (entity) WHERE a.period = 2000 AND b.period = 2001""")
def rank_change(spark, folder):
    ranked = both(spark, folder)[1]
    return T.rank_change(ranked.where("period = 2000"), ranked.where("period = 2001"))


# ------------------------------------------------------------ several periods

MULTI = """o AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS t FROM (SELECT DISTINCT period FROM y)),
e AS (SELECT entity, sum(v * power(0.9, t - 1 - i)) / sum(power(0.9, t - 1 - i)) AS discounted,
    coalesce(regr_slope(v, i) / (max(v) - min(v) + 1e-10), 0) AS trend, stddev_samp(u) AS sd FROM y JOIN o USING (period) GROUP BY entity HAVING count(v) = max(t)),
s AS (SELECT *, 1 - sd / CASE WHEN max(sd) OVER () > 0 THEN max(sd) OVER () ELSE 1 END AS stability,
  CASE WHEN max(discounted) OVER () > min(discounted) OVER () THEN (discounted - min(discounted) OVER ()) / (max(discounted) OVER () - min(discounted) OVER ()) ELSE 0.5 END AS du,
  CASE WHEN max(trend) OVER () > min(trend) OVER () THEN (trend - min(trend) OVER ()) / (max(trend) OVER () - min(trend) OVER ()) ELSE 0.5 END AS tu FROM e),
f AS (SELECT *, 0.5 * du + 0.3 * tu + 0.2 * stability AS composite, 0 AS one FROM s)
SELECT entity, """ + ", ".join(f"{r(c)} AS {c}" for c in ("discounted", "trend", "stability", "composite")) + f""", {trunc_rank("composite", "one")} AS rank FROM f"""


def _copras_y():
    from catalog.ranking import COPRAS
    return f"""{COPRAS}, y AS MATERIALIZED (SELECT period, entity, q AS v, q / max(q) OVER (PARTITION BY period) * 100 AS u FROM c2), {MULTI}"""


@query("multi_period_copras", _copras_y())
def multi_period_copras(spark, folder):
    out = settle(one_matrix(spark, folder, "copras").select("period", "entity", "Q", "utility"))
    return B.multi_period(out, "Q", "utility")


def _edas_y():
    return f"""{ONE}, e0 AS (SELECT *, avg(x) OVER g AS av, CASE WHEN cost THEN -1 ELSE 1 END AS sg FROM x WINDOW g AS (PARTITION BY period, indicator)),
e1 AS (SELECT period, entity, sum(w * greatest(sg * (x - av), 0) / greatest(abs(av), 1e-10)) AS sp, sum(w * greatest(sg * (av - x), 0) / greatest(abs(av), 1e-10)) AS sn FROM e0 GROUP BY ALL),
e2 AS (SELECT *, (sp / max(sp) OVER g + 1 - sn / max(sn) OVER g) / 2 AS v FROM e1 WINDOW g AS (PARTITION BY period)), y AS MATERIALIZED (SELECT period, entity, v, v AS u FROM e2), {MULTI}"""


@query("multi_period_edas", _edas_y())
def multi_period_edas(spark, folder):
    return B.multi_period(settle(one_matrix(spark, folder, "edas").select("period", "entity", "AS")), "AS")


FLOW_YEARS = f"""{SCALED}, {pair_flows("x", "period", "fl", PREFERENCES["vshape"])}"""


def yearly_flows(spark, folder):
    return settle(P.flow_ranks(settle(P.flows(scaled_long(spark, folder), ["period"], "entity")), ["period"]))


@query("multi_period_promethee", f"""{FLOW_YEARS}, y AS MATERIALIZED (SELECT period, entity, phi AS v, {trunc_rank("phi", "period")} AS u FROM fl), {MULTI}""")
def multi_period_promethee(spark, folder):
    """Stability by the rank over time."""
    return B.multi_period(yearly_flows(spark, folder), "phi", "rank")


@query("flow_evolution", f"""{FLOW_YEARS} SELECT entity, {r("avg(phi_plus)")} AS phi_plus, {r("avg(phi_minus)")} AS phi_minus, {r("avg(phi)")} AS phi FROM fl GROUP BY entity""")
def flow_evolution(spark, folder):
    flows = P.flows(scaled_long(spark, folder), ["period"], "entity")
    return flows.groupBy("entity").agg(*[F.avg(c).alias(c) for c in ("phi_plus", "phi_minus", "phi")])


@query("multi_period_vikor", f"""{VIKOR}, o AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS t FROM (SELECT DISTINCT period FROM vk)),
d AS (SELECT entity, sum(q * power(0.9, t - 1 - i)) / max((1 - power(0.9, t)) / 0.1) AS discounted, 0 AS one FROM vk JOIN o USING (period) GROUP BY entity)
SELECT entity, {r("discounted")} AS discounted, {trunc_rank("discounted", "one", False)} AS rank FROM d""")
def multi_period_vikor(spark, folder):
    return B.discounted_mean(settle(one_matrix(spark, folder, "vikor").select("period", "entity", "Q")), "Q")


@query("distance_from_average", f"""{CLEAN}, d AS (SELECT period, entity, value - avg(value) OVER (PARTITION BY period, indicator) AS d FROM obs)
SELECT {BIG}, entity, {r("sqrt(sum(d * d))", 3)} AS distance FROM d GROUP BY period, entity""")
def distance_from_average(spark, folder):
    from panelwise.operators.scaling import distance_from_mean

    panel = panel_of(spark, folder, gaps=False)
    out = distance_from_mean(panel.data, panel.indicators, ["period"])
    return out.select("period", "entity", F.round("distance", 3).alias("distance"))


# ---------------------------------------------------------------- stability

WINDOWS = f"""{YW}, wi AS (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY fit) - 1 AS i, avg(weight) OVER (PARTITION BY criterion ORDER BY fit ROWS 2 PRECEDING) AS m FROM yc),
win AS MATERIALIZED (SELECT i - 2 AS win, criterion, m AS weight FROM wi WHERE i >= 2)"""


def windows(spark, folder):
    return settle(S.window_means(yearly(spark, folder).criteria_long(), size=3))


@query("weight_windows", f"""{WINDOWS} SELECT win::BIGINT AS "window", criterion, {r("weight")} AS weight FROM win""")
def weight_windows(spark, folder):
    return windows(spark, folder)


RHO = f"""{WINDOWS}, p AS (SELECT a.win, {avg_rank("round(a.weight, 10)", "a.win")} AS a, {avg_rank("round(b.weight, 10)", "a.win")} AS b FROM win a JOIN win b ON b.win = a.win + 1 AND a.criterion = b.criterion),
rho AS (SELECT win, coalesce({CORR.format(a="a", b="b")}, 1) AS rho FROM p GROUP BY win)"""


@query("weight_window_rho", f"""{RHO} SELECT win::BIGINT AS "window", {r("rho")} AS rho FROM rho""")
def weight_window_rho(spark, folder):
    return S.consecutive_rho(windows(spark, folder))


@query("weight_stability_summary", f"""{RHO}, rk AS (SELECT win, criterion, row_number() OVER (PARTITION BY win ORDER BY round(weight, 10), criterion) AS r FROM win),
t AS (SELECT criterion, sum(r)::DOUBLE AS s, count(*)::DOUBLE AS k FROM rk GROUP BY criterion)
SELECT {r("avg(rho)")} AS mean_rho, {r("stddev_pop(rho)")} AS sd_rho, count(*) AS n_pairs, (SELECT {r(W)} FROM t) AS kendall_w, (SELECT max(k)::BIGINT FROM t) AS n_windows FROM rho""")
def weight_stability_summary(spark, folder):
    w = windows(spark, folder)
    left = S.rho_summary(S.consecutive_rho(w)).withColumn("_one", F.lit(1))
    return left.join(S.windows_kendall_w(w).withColumn("_one", F.lit(1)), "_one").drop("_one")


@query("weight_variation", f"""{YW} SELECT criterion, {r("avg(weight)")} AS mean, {r("stddev_pop(weight)")} AS sd,
  {r("CASE WHEN avg(weight) < 1e-10 THEN 0 ELSE stddev_pop(weight) / avg(weight) END")} AS cv FROM yc GROUP BY criterion""")
def weight_variation(spark, folder):
    return S.variation(yearly(spark, folder).criteria_long())


CONSISTENCY = f"""{RANKED}, m AS (SELECT period, entity, criterion, round(avg(score), 10) AS m FROM scores GROUP BY ALL),
p AS (SELECT period, criterion, m, round(composite, 10) AS c FROM m JOIN ranked USING (period, entity)),
q AS (SELECT period, criterion, {avg_rank("m", "period, criterion")} AS a, {avg_rank("c", "period, criterion")} AS b FROM p),
cc AS (SELECT period, criterion, {CORR.format(a="a", b="b")} AS rho, count(*) AS n FROM q GROUP BY period, criterion)"""


@query("criterion_consistency", f"""{CONSISTENCY} SELECT {BIG}, criterion, {r("rho")} AS rho, n FROM cc""")
def criterion_consistency(spark, folder):
    scores = inputs(spark, folder, ranked=False)
    return S.criterion_consistency(scores, R.composite(scores))


@query("score_spread", f"""{CONSISTENCY}, c AS (SELECT period, avg((rho + 1) / 2) AS consistency FROM cc GROUP BY period)
SELECT {BIG}, {r("stddev_samp(composite) / (max(composite) - min(composite))")} AS spread, {r("any_value(consistency)")} AS consistency FROM ranked JOIN c USING (period) GROUP BY period""")
def score_spread(spark, folder):
    """Sd of the composite over its range, and criterion-to-final consistency in [0, 1]."""
    scores, ranked = both(spark, folder)
    rho = S.criterion_consistency(scores, ranked).groupBy("period").agg(F.avg((F.col("rho") + 1) / 2).alias("consistency"))
    spread = ranked.groupBy("period").agg(
        F.try_divide(F.stddev_samp("composite"), F.max("composite") - F.min("composite")).alias("spread"))
    return spread.join(rho, "period")


@query("compare_composites", f"""{RANKED}, p AS (SELECT a.entity, round(a.composite, 10) AS x, round(b.composite, 10) AS y FROM ranked a JOIN ranked b USING (entity) WHERE a.period = 2000 AND b.period = 2001),
q AS (SELECT 0 AS g, {avg_rank("x", "1")} AS a, {avg_rank("y", "1")} AS b FROM p)
SELECT {r(CORR.format(a="a", b="b"))} AS rho, count(*) AS n, {CORR.format(a="a", b="b")} >= 0.85 AS stable FROM q""")
def compare_composites(spark, folder):
    """Are the composites of the last two periods rank-stable?"""
    from panelwise.operators.ordered import spearman

    ranked = both(spark, folder)[1]
    a = ranked.where("period = 2000").select("entity", score_key(F.col("composite")).alias("x"))
    b = ranked.where("period = 2001").select("entity", score_key(F.col("composite")).alias("y"))
    return spearman(settle(a.join(b, "entity")), [], "x", "y").withColumn("stable", F.col("rho") >= 0.85)


# ------------------------- perturbation: noise by hash, checked by invariants


DRAWS = f"""{YW}, varied AS (SELECT fit FROM yc GROUP BY fit HAVING max(weight) - min(weight) > 1e-8),
drawn AS MATERIALIZED (SELECT tier, replicate, fit, criterion, weight, weight * (1 + eps * (2 * {noise(7, "tier", "replicate", "fit", "criterion")} - 1)) AS raw
  FROM yc JOIN varied USING (fit), (VALUES ('conservative', 0.05::DOUBLE), ('moderate', 0.15::DOUBLE), ('aggressive', 0.5::DOUBLE)) t(tier, eps), range(1, 51) x(replicate)),
moved AS (SELECT *, abs(raw - weight) AS delta, raw / sum(raw) OVER (PARTITION BY tier, replicate, fit) AS moved FROM drawn),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tier, replicate, fit ORDER BY weight, criterion)::DOUBLE AS a,
  row_number() OVER (PARTITION BY tier, replicate, fit ORDER BY moved, criterion)::DOUBLE AS b FROM moved),
runs AS MATERIALIZED (SELECT tier, replicate, fit, least(greatest(1 - coalesce({CORR.format(a="a", b="b")}, 1), 0), 1) AS disruption, avg(delta) AS delta FROM placed GROUP BY ALL)"""
STATS = ", ".join(f"{r(f'{f}({c}{q})')} AS {n}_{c}" for c in ("disruption", "delta") for n, f, q in (
    ("mean", "avg", ""), ("sd", "stddev_pop", ""), ("min", "min", ""), ("max", "max", ""), ("q95", "quantile_cont", ", 0.95")))


@query("weight_sensitivity_tiers", f"""{DRAWS} SELECT tier, {r("avg((disruption <= 0.1)::INT::DOUBLE)")} AS robustness, {STATS}, count(*) AS n_runs FROM runs GROUP BY tier""")
def weight_sensitivity_tiers(spark, folder):
    return S.weight_sensitivity(settle(yearly(spark, folder).criteria_long()), seed=7)[0]


@query("weight_sensitivity_by_criterion", f"""{DRAWS} SELECT tier, criterion,
  {r("sum((a <> b)::INT)::DOUBLE / (50 * (SELECT count(DISTINCT fit) FROM yc))")} AS sensitivity FROM placed GROUP BY tier, criterion""")
def weight_sensitivity_by_criterion(spark, folder):
    return S.weight_sensitivity(settle(yearly(spark, folder).criteria_long()), seed=7)[1]


NOISE = f"""nm AS (SELECT period, entity, criterion, avg(score) AS mean FROM scores GROUP BY ALL),
nx AS (SELECT period, criterion, replicate, round(mean, 10) AS x,
  greatest(mean + 0.15 * (2 * {noise(7, "period", "criterion", "entity", "replicate")} - 1), 0) AS y FROM nm, range(1, 51) t(replicate)),
nr AS (SELECT period, criterion, replicate, {avg_rank("x", "period, criterion, replicate")} AS a, {avg_rank("y", "period, criterion, replicate")} AS b FROM nx),
nc AS (SELECT period, criterion, replicate, {CORR.format(a="a", b="b")} AS rho FROM nr GROUP BY ALL),
nl AS (SELECT period, criterion, avg(1 - greatest(coalesce(rho, 0), 0)) AS loss FROM nc GROUP BY ALL),
ns AS MATERIALIZED (SELECT period, criterion, CASE WHEN max(loss) OVER (PARTITION BY period) > 0 THEN loss / max(loss) OVER (PARTITION BY period) ELSE loss END AS sensitivity FROM nl)"""


@query("criterion_noise_sensitivity", f"""{SCORES}, {NOISE} SELECT {BIG}, criterion, {r("sensitivity")} AS sensitivity FROM ns""")
def criterion_noise_sensitivity(spark, folder):
    return S.criterion_sensitivity(settle(B.criterion_scores(inputs(spark, folder, ranked=False))), seed=7)


@query("key_weight_sensitivity", f"""{YW}, d AS (SELECT fit, criterion, avg(abs(0.15 * (2 * {noise(7, "fit", "criterion", "draw")} - 1)) * weight) AS m
  FROM yc, range(1, 101) t(draw) GROUP BY ALL),
s AS (SELECT fit, criterion, CASE WHEN max(m) OVER (PARTITION BY fit) > 0 THEN m / max(m) OVER (PARTITION BY fit) ELSE m END AS sensitivity FROM d)
SELECT fit::BIGINT AS fit, criterion, {r("sensitivity")} AS sensitivity, CASE WHEN sensitivity >= 0.3 THEN 'High' WHEN sensitivity >= 0.15 THEN 'Medium' ELSE 'Low' END AS level FROM s""")
def key_weight_sensitivity(spark, folder):
    out = S.key_weight_sensitivity(yearly(spark, folder).criteria_long(), seed=7)
    return out.withColumn("level", T.level(F.col("sensitivity")))


@query("ranking_robustness", f"""{CONSISTENCY}, {NOISE}, na AS (SELECT period, least(greatest(1 - avg(sensitivity), 0), 1) AS a FROM ns GROUP BY period),
nb AS (SELECT period, least(greatest(avg(rho) * 0.5 + 0.5, 0), 1) AS b FROM cc GROUP BY period)
SELECT {BIG}, {r("(a + b) / 2")} AS robustness FROM na JOIN nb USING (period)""")
def ranking_robustness(spark, folder):
    scores = inputs(spark, folder, ranked=False)
    noise = S.criterion_sensitivity(settle(B.criterion_scores(scores)), seed=7)
    return S.robustness(noise, S.criterion_consistency(scores, R.composite(scores)))


def scenarios(spark, folder, n=100):
    panel = panel_of(spark, folder)
    w = C.two_level_weights(panel)
    scores = settle(R.method_scores(panel, w, SIX, ranked=False))
    means = settle(B.criterion_scores(scores))
    return scores, settle(B.reweigh(means, S.scenario_weights(w.criteria_long(), 7, n)))


@query("scenario_stability")
def scenario_stability(spark, folder):
    scores, re = scenarios(spark, folder)
    return S.scenario_stability(re, R.composite(scores))[1]


@query("rank_uncertainty")
def rank_uncertainty(spark, folder):
    return S.rank_uncertainty(scenarios(spark, folder)[1])


@query("rank_win_rates")
def rank_win_rates(spark, folder):
    """How often each of the three leaders beats every other supplier."""
    from panelwise.operators.ordered import top_n

    scores, re = scenarios(spark, folder)
    lead = top_n(R.composite(scores), ["period"], [score_key(F.col("composite")).desc(), F.col("entity").asc()], 3)
    return S.win_rates(re, settle(lead.select("period", "entity")))
