"""Weights, methods on one matrix, and combined rankings."""

from pyspark.sql import functions as F

from catalog.registry import query
from oracle.base import (
    COMPOSITE, CRITERIA, INDICATORS, critic, long, methods, min_rank, pair_flows, r, scores, trunc_rank, weights,
)
from panelwise.operators import critic as C
from panelwise.operators import methods as M
from panelwise.operators import promethee as P
from panelwise.operators.ordered import top_n
from panelwise.plans import ranking as R
from panelwise.session import settle
from panelwise.sources.tables import supplier_panel

BIG = "period::BIGINT AS period"


def panel_of(spark, folder, gaps=True):
    panel = supplier_panel(spark, folder, gaps)
    return panel.with_data(settle(panel.data))


# ------------------------------------------------------------------- weights

CLEAN = "WITH " + long(gaps=False)
CLEAN_ROWS = "rows0 AS MATERIALIZED (SELECT period, entity AS id, indicator AS item, value FROM obs)"
MATRIX = f"{CLEAN}, {CLEAN_ROWS}, {critic('rows0', 'period', 'm', scale=False)}"


@query("critic_matrix", f"""{MATRIX} SELECT {BIG}, item AS indicator, {r("sd")} AS sd, {r("conflict")} AS conflict,
{r("info")} AS info, {r("weight")} AS weight FROM m""")
def critic_matrix(spark, folder):
    """CRITIC of every period's full matrix, with its intermediate quantities."""
    panel = panel_of(spark, folder, gaps=False)
    stats = C.critic_matrix(panel.data, panel.indicators, ["period"])
    return C.unpivot_weights(stats, ["period"], panel.indicators)


@query("critic_correlations", f"{MATRIX} SELECT {BIG}, item AS indicator, other, {r('r')} AS r FROM m_r")
def critic_correlations(spark, folder):
    panel = panel_of(spark, folder, gaps=False)
    stats = C.critic_matrix(panel.data, panel.indicators, ["period"])
    return C.unpivot_correlations(stats, ["period"], panel.indicators)


W_COV = """w0 AS MATERIALIZED (SELECT period, id, item, value, w / sum(w) OVER (PARTITION BY period, item) AS w
  FROM rows0 JOIN (SELECT period, entity AS id, I12 AS w FROM panel) USING (period, id)),
w1 AS MATERIALIZED (SELECT *, value - sum(w * value) OVER (PARTITION BY period, item) AS d FROM w0),
w2 AS MATERIALIZED (SELECT period, item, greatest(sqrt(sum(w * d * d)), 1e-10) AS sd FROM w1 GROUP BY ALL),
w3 AS (SELECT a.period, a.item, b.item AS other, sum(a.w * a.d * b.d) AS cov FROM w1 a JOIN w1 b ON a.period = b.period AND a.id = b.id AND a.item <> b.item GROUP BY ALL),
w4 AS (SELECT c.period, c.item, sum(1 - least(greatest(cov / (s.sd * t.sd), -1), 1)) AS conflict FROM w3 c
  JOIN w2 s ON s.period = c.period AND s.item = c.item JOIN w2 t ON t.period = c.period AND t.item = c.other GROUP BY ALL)"""


@query("critic_weighted_rows", f"""{CLEAN}, {CLEAN_ROWS}, {W_COV}
SELECT {BIG}, item AS indicator, {r("sd")} AS sd, {r("conflict")} AS conflict,
  {r("sd * conflict / sum(sd * conflict) OVER (PARTITION BY period)")} AS weight FROM w2 JOIN w4 USING (period, item)""")
def critic_weighted_rows(spark, folder):
    """CRITIC with every supplier weighted by its number of lines."""
    panel = panel_of(spark, folder, gaps=False)
    rows = panel.data.withColumn("lines", F.col("I12"))
    stats = C.critic_matrix(rows, panel.indicators, ["period"], row_weight="lines")
    return C.unpivot_weights(stats, ["period"], panel.indicators).drop("info")


POOLED = "WITH " + weights()
YEARLY = "WITH " + weights(per_period=True)
ALL_GW = f"""SELECT f.fit::BIGINT AS fit, h.criterion, h.indicator, {r("coalesce(g.local_weight, 0)")} AS local_weight,
  {r("coalesce(c.weight, 0)")} AS criterion_weight, {r("coalesce(g.weight, 0)")} AS weight
FROM hier h CROSS JOIN (SELECT DISTINCT fit FROM gw) f LEFT JOIN gw g ON g.fit = f.fit AND g.indicator = h.indicator
LEFT JOIN cw c ON c.fit = f.fit AND c.criterion = h.criterion"""


@query("two_level_weights", f"{POOLED} {ALL_GW}")
def two_level_weights(spark, folder):
    """Local, criterion and global weights over all periods."""
    return C.two_level_weights(panel_of(spark, folder)).long()


@query("two_level_weights_by_period", f"{YEARLY} {ALL_GW}")
def two_level_weights_by_period(spark, folder):
    """The same for every period in one job; inactive indicators weigh 0."""
    return C.two_level_weights(panel_of(spark, folder), per_period=True).long()


@query("local_weights", f"""{POOLED} SELECT criterion, indicator, {r("local_weight")} AS local_weight FROM local""")
def local_weights(spark, folder):
    w = C.two_level_weights(panel_of(spark, folder))
    return w.long().select("criterion", "indicator", "local_weight")


@query("criterion_composites", f"""{POOLED} SELECT id // 10000 AS entity, id % 10000 AS period,
  {", ".join(f"{r(f"max(value) FILTER (WHERE criterion = '{k}')")} AS {k}" for k in CRITERIA)} FROM z GROUP BY id""")
def criterion_composites(spark, folder):
    """Criterion scores with weights renormalised over the indicators present."""
    w = C.two_level_weights(panel_of(spark, folder))
    h = w.hierarchy
    rows = w.rows.join(w.local, C.FIT)
    cols = [C.composite(h.groups[k], lambda c: F.col(f"local_{c}")).alias(k) for k in h.criteria]
    return rows.select("entity", "period", *cols)


REGIME = "concat(" + ", ".join(f"CASE WHEN regime LIKE '%{k}%' THEN '1' ELSE '0' END" for k in CRITERIA) + ")"


@query("regime_weights", f"""{POOLED} SELECT {REGIME} AS regime, max(n) AS n_rows,
  {", ".join(f"{r(f"coalesce(max(weight) FILTER (WHERE item = '{k}'), 0)")} AS crit_{k}" for k in CRITERIA)} FROM l2 GROUP BY regime""")
def regime_weights(spark, folder):
    """Criterion weights per missing-data regime."""
    return C.two_level_weights(panel_of(spark, folder)).regimes.drop(C.FIT)


@query("criterion_weights_by_period", f"""{YEARLY} SELECT f.fit::BIGINT AS fit, k.criterion, {r("coalesce(weight, 0)")} AS weight
FROM (SELECT DISTINCT fit FROM cw) f CROSS JOIN (SELECT DISTINCT criterion FROM hier) k LEFT JOIN cw USING (fit, criterion)""")
def criterion_weights_by_period(spark, folder):
    return C.two_level_weights(panel_of(spark, folder), per_period=True).criteria_long()


ADAPT = f"""WITH {long()},
kept AS (SELECT period, entity FROM obs GROUP BY ALL HAVING count(value) > 0),
full0 AS (SELECT o.period, o.entity FROM obs o JOIN kept USING (period, entity) JOIN act USING (period, indicator) GROUP BY ALL HAVING count(o.value) = count(*)),
rows0 AS MATERIALIZED (SELECT o.period, o.entity AS id, o.indicator AS item, o.value FROM obs o JOIN full0 USING (period, entity) JOIN act USING (period, indicator)),
{critic("rows0", "period", "m", scale=False)}"""


@query("adaptive_weights", f"""{ADAPT} SELECT p.period::BIGINT AS period, h.indicator, {r("coalesce(m.weight, 0)")} AS weight
FROM (SELECT DISTINCT period FROM panel) p CROSS JOIN hier h LEFT JOIN m ON m.period = p.period AND m.item = h.indicator""")
def adaptive_weights(spark, folder):
    """Empty rows and columns dropped per period, then CRITIC."""
    panel = panel_of(spark, folder)
    stats = C.adaptive_weights(panel.data, panel.indicators, ["period"])
    return C.unpivot_weights(stats, ["period"], panel.indicators).select("period", "indicator", "weight")


SHARES = f"""WITH {weights()}, aw AS (SELECT a.period, a.criterion, a.indicator, coalesce(g.weight, 0) AS w FROM act a LEFT JOIN gw g ON g.indicator = a.indicator)"""


@query("period_shares", f"""{SHARES} SELECT {BIG}, criterion, indicator,
  {r("w / sum(w) OVER (PARTITION BY period, criterion)")} AS share,
  {r("sum(w) OVER (PARTITION BY period, criterion) / sum(w) OVER (PARTITION BY period)")} AS criterion_weight FROM aw""")
def period_shares(spark, folder):
    """Pooled weights cut to the indicators active in each period."""
    panel = panel_of(spark, folder)
    w = C.two_level_weights(panel)
    wide = R.period_weights(panel, w, own_criterion_weights=False)
    cells = F.array(*[
        F.when(F.col(f"has_{c}"), F.struct(
            F.lit(k).alias("criterion"), F.lit(c).alias("indicator"), F.col(f"share_{c}").alias("share"),
            F.col(f"cw_{k}").alias("criterion_weight")))
        for c, k in panel.hierarchy.criterion_of.items()])
    return wide.select("period", F.inline(F.filter(cells, lambda s: s.isNotNull())))


# --------------------------------------------------- one matrix, every period

WEIGHT_BY_ITEM = "m.weight"
SCALED_MATRIX = f"{CLEAN}, {CLEAN_ROWS}, {critic('rows0', 'period', 'm')}"
ONE = f"""{SCALED_MATRIX}, x AS MATERIALIZED (SELECT o.period, o.entity, o.indicator, o.cost, o.value AS x, m.weight AS w
  FROM obs o JOIN m ON m.period = o.period AND m.item = o.indicator)"""
SIGN = "CASE WHEN cost THEN -1 ELSE 1 END"


def scaled_weights(panel):
    stats = C.critic_matrix(panel.data, panel.indicators, ["period"], scale=True)
    return settle(stats.select("period", *[f"weight_{c}" for c in panel.indicators]))


def one_matrix(spark, folder, method, own_weights=False, **options):
    """Weights: CRITIC of the scaled matrix, or (the method's default) of the matrix as it is."""
    panel = panel_of(spark, folder, gaps=False)
    weights = None if own_weights else scaled_weights(panel)
    return M.rank_matrix(
        panel.data, method, panel.indicators, ["period"], weights, cost=panel.hierarchy.cost, **options
    )


def topsis_sql(norm: str, one: str = ONE) -> str:
    return f"""{one}, t0 AS (SELECT *, {norm} * w AS v FROM x WINDOW g AS (PARTITION BY period, indicator)),
t1 AS (SELECT *, CASE WHEN cost THEN min(v) OVER g ELSE max(v) OVER g END AS hi, CASE WHEN cost THEN max(v) OVER g ELSE min(v) OVER g END AS lo
  FROM t0 WINDOW g AS (PARTITION BY period, indicator)),
t2 AS (SELECT period, entity, sqrt(sum((v - hi) * (v - hi))) AS d_pos, sqrt(sum((v - lo) * (v - lo))) AS d_neg FROM t1 GROUP BY ALL),
t3 AS (SELECT *, CASE WHEN d_pos + d_neg > 1e-14 THEN d_neg / (d_pos + d_neg) ELSE 0.5 END AS score FROM t2)
SELECT {BIG}, entity, {r("d_pos")} AS d_pos, {r("d_neg")} AS d_neg, {r("score")} AS score, {trunc_rank("score", "period")} AS rank FROM t3"""


def topsis(spark, folder, normalization):
    out = one_matrix(spark, folder, "topsis", normalization == "max", normalization=normalization)
    return out.select("period", "entity", "d_pos", "d_neg", "score", "rank")


for _norm, _sql in {
    "vector": "x / CASE WHEN sqrt(sum(x * x) OVER g) = 0 THEN 1 ELSE sqrt(sum(x * x) OVER g) END",
    "minmax": "(x - min(x) OVER g) / CASE WHEN max(x) OVER g = min(x) OVER g THEN 1 ELSE max(x) OVER g - min(x) OVER g END",
    "max": "x / CASE WHEN max(x) OVER g = 0 THEN 1 ELSE max(x) OVER g END",
}.items():
    query(f"topsis_{_norm}", topsis_sql(_sql, ONE.replace(SCALED_MATRIX, MATRIX) if _norm == "max" else ONE))(lambda spark, folder, n=_norm: topsis(spark, folder, n))


VIKOR = f"""{ONE}, v0 AS (SELECT *, CASE WHEN cost THEN min(x) OVER g ELSE max(x) OVER g END AS best,
    CASE WHEN cost THEN max(x) OVER g ELSE min(x) OVER g END AS worst FROM x WINDOW g AS (PARTITION BY period, indicator)),
v1 AS (SELECT period, entity, sum(w * (best - x) / CASE WHEN abs(best - worst) < 1e-10 THEN 1e-10 ELSE best - worst END) AS s,
    greatest(0, max(w * (best - x) / CASE WHEN abs(best - worst) < 1e-10 THEN 1e-10 ELSE best - worst END)) AS r FROM v0 GROUP BY ALL),
vk AS MATERIALIZED (SELECT *, 0.5 * (s - min(s) OVER g) / CASE WHEN max(s) OVER g = min(s) OVER g THEN 1e-10 ELSE max(s) OVER g - min(s) OVER g END
  + 0.5 * (r - min(r) OVER g) / CASE WHEN max(r) OVER g = min(r) OVER g THEN 1e-10 ELSE max(r) OVER g - min(r) OVER g END AS q
  FROM v1 WINDOW g AS (PARTITION BY period)),
vr AS MATERIALIZED (SELECT *, {trunc_rank("q", "period", False)} AS rank, {trunc_rank("s", "period", False)} AS rank_s, {trunc_rank("r", "period", False)} AS rank_r,
  row_number() OVER (PARTITION BY period ORDER BY round(q, 10), entity) AS rn, count(*) OVER (PARTITION BY period) AS n FROM vk)"""


@query("vikor", f"""{VIKOR} SELECT {BIG}, entity, {r("s")} AS S, {r("r")} AS R, {r("q")} AS Q, rank, rank_s AS rank_S, rank_r AS rank_R FROM vr""")
def vikor(spark, folder):
    return one_matrix(spark, folder, "vikor").select("period", "entity", "S", "R", "Q", "rank", "rank_S", "rank_R")


@query("vikor_compromise", f"""{VIKOR}, a AS (SELECT x1.period, x1.entity AS a1, x2.entity AS a2, x1.q AS q1, x2.q - x1.q >= 1.0::DOUBLE / (x1.n - 1) AS advantage,
  x1.rank_s = 1 OR x1.rank_r = 1 AS stability, 1.0::DOUBLE / (x1.n - 1) AS dq FROM vr x1 JOIN vr x2 USING (period) WHERE x1.rn = 1 AND x2.rn = 2)
SELECT v.period::BIGINT AS period, v.entity, {r("v.q")} AS Q, advantage, stability FROM vr v JOIN a USING (period)
WHERE CASE WHEN advantage AND stability THEN v.entity = a1 WHEN NOT advantage THEN v.q - q1 < dq ELSE v.entity IN (a1, a2) END""")
def vikor_compromise(spark, folder):
    """The compromise set of every period, with both acceptance conditions."""
    from panelwise.operators.combine import compromise_set

    ranked = one_matrix(spark, folder, "vikor").select("period", "entity", "S", "R", "Q", "rank", "rank_S", "rank_R")
    return compromise_set(ranked, ["period"], "entity")


COPRAS = f"""{ONE}, c0 AS (SELECT *, w * CASE WHEN abs(sum(x) OVER g) > 0 THEN x / abs(sum(x) OVER g) ELSE 1.0::DOUBLE / count(*) OVER g END AS v
  FROM x WINDOW g AS (PARTITION BY period, indicator)),
c1 AS (SELECT period, entity, sum(v) FILTER (WHERE NOT cost) AS sp, sum(v) FILTER (WHERE cost) AS sm FROM c0 GROUP BY ALL),
c2 AS (SELECT *, CASE WHEN sum(sm) OVER g > 0 THEN sp + sum(sm) OVER g / (CASE WHEN sm = 0 THEN 1e-10 ELSE sm END * sum(1 / CASE WHEN sm = 0 THEN 1e-10 ELSE sm END) OVER g) ELSE sp END AS q
  FROM c1 WINDOW g AS (PARTITION BY period))"""


@query("copras", f"""{COPRAS} SELECT {BIG}, entity, {r("sp")} AS S_plus, {r("sm")} AS S_minus, {r("q")} AS Q,
  {r("CASE WHEN max(q) OVER (PARTITION BY period) > 0 THEN q / max(q) OVER (PARTITION BY period) * 100 ELSE 0 END")} AS utility, {trunc_rank("q", "period")} AS rank FROM c2""")
def copras(spark, folder):
    return one_matrix(spark, folder, "copras").select("period", "entity", "S_plus", "S_minus", "Q", "utility", "rank")


def edas_sql(centre: str) -> str:
    return f"""{ONE}, e0 AS (SELECT *, {centre} AS av FROM x WINDOW g AS (PARTITION BY period, indicator)),
e1 AS (SELECT period, entity, sum(w * greatest({SIGN} * (x - av), 0) / greatest(abs(av), 1e-10)) AS sp,
  sum(w * greatest({SIGN} * (av - x), 0) / greatest(abs(av), 1e-10)) AS sn FROM e0 GROUP BY ALL),
e2 AS (SELECT *, (CASE WHEN max(sp) OVER g > 0 THEN sp / max(sp) OVER g ELSE 0 END + CASE WHEN max(sn) OVER g > 0 THEN 1 - sn / max(sn) OVER g ELSE 1 END) / 2 AS score
  FROM e1 WINDOW g AS (PARTITION BY period))
SELECT {BIG}, entity, {r("sp")} AS SP, {r("sn")} AS SN, {r("score")} AS "AS", {trunc_rank("score", "period")} AS rank FROM e2"""


@query("edas", edas_sql("avg(x) OVER g"))
def edas(spark, folder):
    return one_matrix(spark, folder, "edas").select("period", "entity", "SP", "SN", "AS", "rank")


def saw_sql(norm: str) -> str:
    return f"""{ONE}, s0 AS (SELECT *, {norm} AS v FROM x WINDOW g AS (PARTITION BY period, indicator)),
s1 AS (SELECT period, entity, sum(w * v) AS score FROM s0 GROUP BY ALL)
SELECT {BIG}, entity, {r("score")} AS score, {trunc_rank("score", "period")} AS rank FROM s1"""


for _norm, _sql in {
    "minmax": "CASE WHEN cost THEN max(x) OVER g - x ELSE x - min(x) OVER g END / CASE WHEN max(x) OVER g = min(x) OVER g THEN 1 ELSE max(x) OVER g - min(x) OVER g END",
    "max": """CASE WHEN cost THEN CASE WHEN min(x) OVER g > 0 THEN min(x) OVER g / x WHEN max(x) OVER g > 0 THEN (max(x) OVER g - x) / max(x) OVER g ELSE 0 END
      ELSE x / CASE WHEN max(x) OVER g = 0 THEN 1 ELSE max(x) OVER g END END""",
    "sum": """CASE WHEN cost THEN (1 / greatest(x, 1e-10)) / sum(1 / greatest(x, 1e-10)) OVER g ELSE x / CASE WHEN sum(x) OVER g = 0 THEN 1 ELSE sum(x) OVER g END END""",
}.items():
    query(f"saw_{_norm}", saw_sql(_sql))(
        lambda spark, folder, n=_norm: one_matrix(spark, folder, "saw", normalization=n).select("period", "entity", "score", "rank")
    )


@query("base_sum", f"""{ONE}, b AS (SELECT period, entity, sum(x) AS score FROM x GROUP BY ALL)
SELECT {BIG}, entity, {r("score", 3)} AS score, {min_rank("score", "period", True, 3)} AS rank FROM b""")
def base_sum(spark, folder):
    from panelwise.operators.ordered import add_ranks

    panel = panel_of(spark, folder, gaps=False)
    total = F.round(M.base(panel.indicators, F.col), 3)
    rows = panel.data.select("period", "entity", total.alias("score"))
    return add_ranks(rows, ["period"], {"rank": ("score", True, "min")})


@query("top_suppliers", topsis_sql("x / sqrt(sum(x * x) OVER g)").replace("SELECT period::BIGINT AS period, entity, (round(d_pos", "SELECT * EXCLUDE (rn) FROM (SELECT row_number() OVER (PARTITION BY period ORDER BY round(score, 10) DESC, entity) AS rn, period::BIGINT AS period, entity, (round(d_pos") + ") WHERE rn <= 5")
def top_suppliers(spark, folder):
    """Five best per period; the group limit runs before the shuffle."""
    from panelwise.functions.guards import score_key

    out = topsis(spark, folder, "vector")
    return top_n(out, ["period"], [score_key(F.col("score")).desc(), F.col("entity").asc()], 5)


# ------------------------------------------------------------------ flows

SCALED = f"""{SCALED_MATRIX}, x AS MATERIALIZED (SELECT o.period, o.entity, o.indicator, m.weight AS w,
  CASE WHEN max(value) OVER g > min(value) OVER g THEN CASE WHEN cost THEN max(value) OVER g - value ELSE value - min(value) OVER g END / (max(value) OVER g - min(value) OVER g) ELSE 0.5 END AS x
  FROM obs o JOIN m ON m.period = o.period AND m.item = o.indicator WINDOW g AS (PARTITION BY o.period, o.indicator))"""

PREFERENCES = {
    "usual": "1",
    "ushape": "CASE WHEN round(a.x - b.x, 11) > 0.1 THEN 1 ELSE 0 END",
    "vshape": "least((a.x - b.x) / 0.3, 1)",
    "level": "CASE WHEN round(a.x - b.x, 11) > 0.3 THEN 1 WHEN round(a.x - b.x, 11) > 0.1 THEN 0.5 ELSE 0 END",
    "vshape_i": "greatest(least((a.x - b.x - 0.1) / 0.2, 1), 0)",
    "gaussian": "1 - exp(-(a.x - b.x) * (a.x - b.x) / 0.08)",
}


def scaled_long(spark, folder):
    """Long min-max scaled matrix with CRITIC weights, input of the flows."""
    panel = panel_of(spark, folder, gaps=False)
    rows, w = M.place_weights(panel.data, panel.indicators, ["period"], scaled_weights(panel))
    out, found = R.run_programs(
        rows, ["period"], {"s": M.ranking_scale(panel.indicators, F.col, panel.hierarchy.cost)}
    )
    cells = F.array(*[
        F.struct(F.lit(c).alias("indicator"), found["s"][c].alias("x"), w(c).alias("w")) for c in panel.indicators
    ])
    return settle(out.select("period", "entity", F.inline(cells)))


def flow_sql(pref: str) -> str:
    return f"""{SCALED}, {pair_flows("x", "period", "fl", pref)}
SELECT {BIG}, entity, {r("phi_plus")} AS phi_plus, {r("phi_minus")} AS phi_minus, {r("phi")} AS phi,
  {trunc_rank("phi", "period")} AS rank, {trunc_rank("phi_plus", "period")} AS rank_plus, {trunc_rank("phi_minus", "period", False)} AS rank_minus FROM fl"""


for _kind, _sql in PREFERENCES.items():
    query(f"promethee_{_kind}", flow_sql(_sql))(
        lambda spark, folder, k=_kind: P.flow_ranks(
            settle(P.flows(scaled_long(spark, folder), ["period"], "entity", P.Preference(k))), ["period"]
        )
    )


@query("promethee_gaussian_narrow", flow_sql("1 - exp(-(a.x - b.x) * (a.x - b.x) / 0.0002)"))
def promethee_gaussian_narrow(spark, folder):
    """A bell of one hundredth of the range."""
    pref = P.Preference("gaussian", sigma=0.01)
    return P.flow_ranks(settle(P.flows(scaled_long(spark, folder), ["period"], "entity", pref)), ["period"])


MIXED = {"I11": "usual", "I12": "level", "I13": "vshape", "I21": "vshape_i", "I22": "gaussian", "I31": "ushape", "I32": "vshape", "I41": "vshape", "I42": "usual"}


@query("promethee_mixed", f"""{SCALED}, {pair_flows("x", "period", "fl", "CASE a.indicator " + " ".join(f"WHEN '{i}' THEN {PREFERENCES[k]}" for i, k in MIXED.items()) + " END")}
SELECT {BIG}, entity, {r("phi_plus")} AS phi_plus, {r("phi_minus")} AS phi_minus, {r("phi")} AS phi FROM fl""")
def promethee_mixed(spark, folder):
    """A preference function per indicator."""
    prefs = {i: P.Preference(k) for i, k in MIXED.items()}
    return P.flows(scaled_long(spark, folder), ["period"], "entity", prefs)


FOCUS = f"""{SCALED}, {pair_flows("x", "period", "fl", PREFERENCES["vshape"])},
focus AS (SELECT period, entity FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY round(phi, 10) DESC, entity) AS rn FROM fl) WHERE rn <= 3)"""


def focus_of(flow):
    from panelwise.functions.guards import score_key

    return settle(top_n(flow, ["period"], [score_key(F.col("phi")).desc(), F.col("entity").asc()], 3).select("period", "entity"))


@query("outranking_relations", f"""{FOCUS}, p AS (SELECT a.period, a.entity AS a, b.entity AS b, round(a.phi_plus, 10) AS pa, round(b.phi_plus, 10) AS pb, round(a.phi_minus, 10) AS ma, round(b.phi_minus, 10) AS mb
  FROM fl a JOIN focus f USING (period, entity) JOIN fl b ON a.period = b.period AND a.entity <> b.entity)
SELECT {BIG}, a, b, CASE WHEN pa = pb AND ma = mb THEN 'indifferent' WHEN pa >= pb AND ma <= mb THEN 'outranks' WHEN pa <= pb AND ma >= mb THEN 'outranked' ELSE 'incomparable' END AS relation FROM p""")
def outranking_relations(spark, folder):
    """Partial preorder of the three best of each period against all others."""
    flow = settle(P.flows(scaled_long(spark, folder), ["period"], "entity"))
    return P.outranking(flow, focus_of(flow), ["period"], "entity")


@query("preference_matrix_rows", f"""{FOCUS} SELECT a.period::BIGINT AS period, a.entity AS a, b.entity AS b,
  {r("sum(a.w * CASE WHEN a.x > b.x THEN least((a.x - b.x) / 0.3, 1) ELSE 0 END)")} AS preference,
  {r("sum(a.w * CASE WHEN b.x > a.x THEN least((b.x - a.x) / 0.3, 1) ELSE 0 END)")} AS against
FROM x a JOIN focus f ON f.period = a.period AND f.entity = a.entity JOIN x b ON a.period = b.period AND a.indicator = b.indicator AND a.entity <> b.entity GROUP BY 1, 2, 3""")
def preference_matrix_rows(spark, folder):
    """Rows of the preference matrix of the three best of each period."""
    x = scaled_long(spark, folder)
    flow = settle(P.flows(x, ["period"], "entity"))
    return P.preference_rows(x, focus_of(flow), ["period"], "entity")


# --------------------------------------------------------------- combination

SCORES = "WITH " + scores()


def scores_of(spark, folder, per_period=False, ranked=True):
    panel = panel_of(spark, folder)
    w = C.two_level_weights(panel, per_period)
    return settle(R.method_scores(panel, w, ranked=ranked))


@query("method_scores", f"""{SCORES} SELECT {BIG}, criterion, entity, method, {r("raw")} AS raw, {r("score")} AS score,
  {r("criterion_weight")} AS criterion_weight, rank FROM scores""")
def method_scores(spark, folder):
    """Six methods x criteria x periods, scaled scores and ranks."""
    return scores_of(spark, folder)


@query("rank_suppliers", f"""{SCORES}, {COMPOSITE} SELECT {BIG}, entity, {r("composite")} AS composite, n_criteria, {trunc_rank("composite", "period")} AS rank FROM comp""")
def rank_suppliers(spark, folder):
    """The whole ranking run: weights, six methods, composite, rank."""
    return R.composite_ranks(scores_of(spark, folder, ranked=False))


@query("rank_suppliers_renormalised", f"""{SCORES}, {COMPOSITE} SELECT {BIG}, entity, {r("shared")} AS composite, n_criteria, {trunc_rank("shared", "period")} AS rank FROM comp""")
def rank_suppliers_renormalised(spark, folder):
    return R.composite_ranks(scores_of(spark, folder, ranked=False), renormalise=True)


@query("rank_suppliers_yearly_weights", f"""WITH {scores(per_period=True)}, {COMPOSITE} SELECT {BIG}, entity, {r("composite")} AS composite, n_criteria, {trunc_rank("composite", "period")} AS rank FROM comp""")
def rank_suppliers_yearly_weights(spark, folder):
    return R.composite_ranks(scores_of(spark, folder, per_period=True, ranked=False))



@query("edas_trimmed", edas_sql("tm").replace("e0 AS (SELECT *, tm AS av FROM x WINDOW g AS (PARTITION BY period, indicator))", """o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY period, indicator ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY period, indicator) AS n FROM x),
tm AS MATERIALIZED (SELECT period, indicator, avg(x) AS av FROM o WHERE i >= floor(n * 0.1 + 1e-9) AND i < n - floor(n * 0.1 + 1e-9) GROUP BY ALL),
e0 AS (SELECT x.*, tm.av FROM x JOIN tm USING (period, indicator))"""))
def edas_trimmed(spark, folder):
    """EDAS around the mean without the lowest and highest tenth."""
    panel = panel_of(spark, folder, gaps=False)
    out = M.edas_trimmed(panel.data, panel.indicators, ["period"], scaled_weights(panel), panel.hierarchy.cost)
    return out.select("period", "entity", "SP", "SN", "AS", "rank")


TWO_TABLES = f"""{CLEAN}, ri AS MATERIALIZED (SELECT period, criterion, entity AS id, indicator AS item, value FROM obs),
{critic("ri", "period, criterion", "li", scale=False)}, rc AS MATERIALIZED (SELECT period, entity AS id, criterion AS item, avg(value) AS value FROM obs GROUP BY ALL),
{critic("rc", "period", "lc", scale=False)}"""


@query("adaptive_two_level", f"""{TWO_TABLES} SELECT i.period::BIGINT AS period, i.criterion, i.item AS indicator, {r("i.weight")} AS local_weight, {r("c.weight")} AS criterion_weight, {r("i.weight * c.weight")} AS weight
FROM li i JOIN lc c ON c.period = i.period AND c.item = i.criterion""")
def adaptive_two_level(spark, folder):
    """Weights from a table of indicators and a table of criterion scores."""
    from panelwise.operators.views import criterion_means

    panel = panel_of(spark, folder, gaps=False)
    means = settle(criterion_means(panel))
    return C.adaptive_two_level(panel.data, means, panel.hierarchy, ["period"])
