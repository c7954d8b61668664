"""Common table expressions shared by the oracle queries."""

INDICATORS = ["I11", "I12", "I13", "I21", "I22", "I31", "I32", "I41", "I42"]
CRITERION = {i: "K" + i[1] for i in INDICATORS}
CRITERIA = ["K1", "K2", "K3", "K4"]
COST = ["I31", "I32", "I41", "I42"]

HIER = (
    "hier(indicator, criterion, cost) AS (VALUES "
    + ", ".join(f"('{i}', '{CRITERION[i]}', {'true' if i in COST else 'false'})" for i in INDICATORS)
    + ")"
)


def r(expr: str, digits: int = 6) -> str:
    """Rounded, -0.0 folded into 0.0."""
    return f"(round({expr}, {digits}) + 0.0)"


def noise(seed: int, *keys: str) -> str:
    """The uniform number of (seed, keys), as in ``functions/noise.py``."""
    text = ", ".join(f"coalesce(({k})::VARCHAR, '')" for k in keys)
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def panel(gaps: bool = True) -> str:
    small = "FILTER (WHERE l_quantity <= 2)" if gaps else ""
    silent = "(period = 1999 AND bulk < 49)" if gaps else "false"
    rule = {i: "false" for i in INDICATORS}
    if gaps:
        rule |= {"I22": "period >= 2000", "I41": "period < 1997", "I42": "period < 1997"}
    cells = ", ".join(f"CASE WHEN {silent} OR {rule[i]} THEN NULL ELSE {i} END AS {i}" for i in INDICATORS)
    return f"""agg AS (
  SELECT l_suppkey::BIGINT AS entity, year(l_shipdate)::INT AS period,
    round(sum(l_quantity), 6) AS I11, count(*)::DOUBLE AS I12, round(avg(l_quantity), 8) AS I13,
    round(sum(l_extendedprice * (1 - l_discount)), 4) AS I21, round(avg(l_extendedprice), 8) AS I22,
    round(avg(l_discount) {small}, 8) AS I31, round(avg(l_tax), 8) AS I32,
    round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS I41,
    round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS I42,
    max(l_quantity) AS bulk
  FROM lineitem GROUP BY 1, 2),
panel AS MATERIALIZED (SELECT entity, period, {cells} FROM agg)"""


OBS = (
    "obs AS MATERIALIZED (SELECT p.entity, p.period, h.indicator, h.criterion, h.cost, CASE h.indicator "
    + " ".join(f"WHEN '{i}' THEN p.{i}" for i in INDICATORS)
    + " END AS value FROM panel p CROSS JOIN hier h)"
)

ACT = "act AS (SELECT period, criterion, indicator FROM obs GROUP BY ALL HAVING count(value) > 0)"

# entities complete in the active indicators of a criterion
CASES = """cases AS MATERIALIZED (
  SELECT o.period, o.criterion, o.entity FROM obs o JOIN act USING (period, indicator)
  GROUP BY ALL HAVING count(o.value) = count(*))"""


def long(gaps: bool = True) -> str:
    return ",\n".join([HIER, panel(gaps), OBS, ACT, CASES])


def critic(rows: str, keys: str, name: str, scale: bool = True) -> str:
    """CTE ``name(keys, item, weight, ..)`` from ``rows(keys, id, item, value)``, complete rows only."""
    k = keys
    on = " AND ".join(f"a.{x} = b.{x}" for x in k.split(", "))
    using = k
    sd = "stddev_samp(value)"
    if scale:
        sd = f"({sd} / greatest(max(value) - min(value), 1e-10))"
    return f"""{name}_st AS MATERIALIZED (
  SELECT {k}, item, count(*) AS n, stddev_samp(value) AS raw_sd,
    CASE WHEN {sd} = 0 THEN 1e-10 ELSE {sd} END AS sd FROM {rows} GROUP BY {k}, item),
{name}_cov AS (
  SELECT {", ".join("a." + x for x in k.split(", "))}, a.item AS item, b.item AS other, covar_samp(a.value, b.value) AS cov
  FROM {rows} a JOIN {rows} b ON {on} AND a.id = b.id AND a.item <> b.item GROUP BY ALL),
{name}_r AS MATERIALIZED (
  SELECT c.*, coalesce(CASE WHEN s.raw_sd * t.raw_sd <> 0 THEN cov / (s.raw_sd * t.raw_sd) END, 1) AS r
  FROM {name}_cov c JOIN {name}_st s USING ({using}, item)
  JOIN (SELECT {k}, item AS other, raw_sd FROM {name}_st) t USING ({using}, other)),
{name}_c AS (
  SELECT s.*, greatest(coalesce((SELECT sum(1 - r) FROM {name}_r x
      WHERE x.item = s.item AND {" AND ".join(f"x.{y} = s.{y}" for y in k.split(", "))}), 0), 1e-10) AS conflict
  FROM {name}_st s),
{name} AS MATERIALIZED (
  SELECT *, sd * conflict AS info,
    CASE WHEN n < 2 OR sum(sd * conflict) OVER (PARTITION BY {k}) < 1e-10
      THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY {k})
      ELSE sd * conflict / sum(sd * conflict) OVER (PARTITION BY {k}) END AS weight
  FROM {name}_c)"""


def weights(per_period: bool = False, gaps: bool = True) -> str:
    """CTEs up to ``local``, ``regime``, ``cw`` and ``gw`` (two-level weights)."""
    fit = "o.period" if per_period else "0"
    return f"""{long(gaps)},
usable AS (SELECT o.period, o.entity FROM obs o JOIN act USING (period, indicator)
  GROUP BY ALL HAVING count(o.value) = count(*)),
u AS MATERIALIZED (SELECT {fit} AS fit, o.period, o.entity, o.entity * 10000 + o.period AS id, o.criterion, o.indicator, o.value
  FROM obs o JOIN usable USING (period, entity)),
fact AS MATERIALIZED (SELECT fit, criterion, indicator FROM u GROUP BY ALL HAVING count(value) > 0),
full1 AS (SELECT u.fit, u.criterion, u.id FROM u JOIN fact USING (fit, indicator) GROUP BY ALL HAVING count(u.value) = count(*)),
rows1 AS MATERIALIZED (SELECT u.fit, u.criterion, u.id, u.indicator AS item, u.value
  FROM u JOIN fact USING (fit, indicator) JOIN full1 f ON f.fit = u.fit AND f.criterion = u.criterion AND f.id = u.id),
{critic("rows1", "fit, criterion", "l1")},
local AS MATERIALIZED (SELECT f.fit, f.criterion, f.indicator,
    coalesce(w.weight / sum(w.weight) OVER (PARTITION BY f.fit, f.criterion),
             1.0::DOUBLE / count(*) OVER (PARTITION BY f.fit, f.criterion)) AS local_weight
  FROM fact f LEFT JOIN (SELECT fit, criterion, item AS indicator, weight FROM l1) w USING (fit, criterion, indicator)),
z AS MATERIALIZED (SELECT u.fit, u.id, u.criterion, sum(u.value * l.local_weight) / sum(l.local_weight) AS value
  FROM u JOIN local l USING (fit, indicator) WHERE u.value IS NOT NULL GROUP BY ALL),
reg AS (SELECT fit, id, string_agg(criterion, ',' ORDER BY criterion) AS regime FROM z GROUP BY ALL),
rows2 AS MATERIALIZED (SELECT z.fit, reg.regime, z.id, z.criterion AS item, z.value FROM z JOIN reg USING (fit, id)),
{critic("rows2", "fit, regime", "l2")},
blend AS (SELECT fit, item AS criterion, sum(weight * n) AS s FROM l2 GROUP BY ALL),
cw AS MATERIALIZED (SELECT fit, criterion, s / sum(s) OVER (PARTITION BY fit) AS weight FROM blend),
gw AS MATERIALIZED (SELECT l.fit, l.criterion, l.indicator, l.local_weight, c.weight AS criterion_weight,
    l.local_weight * c.weight / sum(l.local_weight * c.weight) OVER (PARTITION BY l.fit) AS weight
  FROM local l JOIN cw c USING (fit, criterion))"""


def trunc_rank(value: str, part: str, desc: bool = True, digits: int = 10) -> str:
    """Average rank of ties, truncated."""
    v = f"round({value}, {digits})"
    return (
        f"(rank() OVER (PARTITION BY {part} ORDER BY {v} {'DESC' if desc else 'ASC'})"
        f" + (count(*) OVER (PARTITION BY {part}, {v}) - 1) // 2)::BIGINT"
    )


def min_rank(value: str, part: str, desc: bool = True, digits: int = 10) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY round({value}, {digits}) {'DESC' if desc else 'ASC'}))::BIGINT"


def avg_rank(value: str, part: str, desc: bool = True) -> str:
    order = f"PARTITION BY {part} ORDER BY {value} {'DESC' if desc else 'ASC'}"
    return f"(rank() OVER ({order}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0::DOUBLE)"


SIX = ["topsis", "vikor", "promethee", "copras", "edas", "base"]


def scores(per_period: bool = False, flows: bool = True) -> str:
    """CTEs up to ``scores(period, criterion, entity, method, raw, score, criterion_weight, rank)``."""
    fit = "a.period" if per_period else "0"
    k = "period, criterion"
    return f"""{weights(per_period)},
aw AS (SELECT a.period, a.criterion, a.indicator, coalesce(g.weight, 0) AS w FROM act a LEFT JOIN gw g ON g.fit = {fit} AND g.indicator = a.indicator),
share AS MATERIALIZED (SELECT period, criterion, indicator,
    CASE WHEN sum(w) OVER (PARTITION BY {k}) > 0 THEN w / sum(w) OVER (PARTITION BY {k})
      ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY {k}) END AS w FROM aw),
x AS MATERIALIZED (SELECT o.period, o.criterion, o.entity, o.indicator, o.value, s.w,
    CASE WHEN max(o.value) OVER g - min(o.value) OVER g < 1e-12 THEN 0.5::DOUBLE
      WHEN o.cost THEN (max(o.value) OVER g - o.value) / (max(o.value) OVER g - min(o.value) OVER g)
      ELSE (o.value - min(o.value) OVER g) / (max(o.value) OVER g - min(o.value) OVER g) END AS x
  FROM obs o JOIN cases c USING (period, criterion, entity) JOIN share s USING (period, criterion, indicator)
  WINDOW g AS (PARTITION BY o.period, o.criterion, o.indicator)),
{methods("x", k, flows)},
raws AS (
  SELECT {k}, entity, 'topsis' AS method, score AS raw, score AS up FROM topsis UNION ALL
  SELECT {k}, entity, 'vikor', q, -q FROM vikor UNION ALL
  {f"SELECT {k}, entity, 'promethee', phi, phi FROM promethee UNION ALL" if flows else ""}
  SELECT {k}, entity, 'copras', utility, utility FROM copras UNION ALL
  SELECT {k}, entity, 'edas', score, score FROM edas UNION ALL
  SELECT {k}, entity, 'base', sum(value), sum(value) FROM x GROUP BY {k}, entity),
unit AS MATERIALIZED (SELECT {k}, entity, method, raw,
    CASE WHEN max(up) OVER g - min(up) OVER g < 1e-12 THEN 0.5::DOUBLE
      ELSE (up - min(up) OVER g) / (max(up) OVER g - min(up) OVER g) END AS score
  FROM raws WINDOW g AS (PARTITION BY {k}, method)),
ranked AS (SELECT *, CASE WHEN method = 'base' THEN {min_rank("score", k + ", method")}
      ELSE {trunc_rank("score", k + ", method")} END AS rank FROM unit),
scores AS MATERIALIZED (SELECT u.*, coalesce(c.weight, 0) AS criterion_weight
  FROM ranked u LEFT JOIN cw c ON c.criterion = u.criterion AND c.fit = {fit.replace("a.", "u.")})"""


COMPOSITE = """per AS (SELECT period, entity, criterion, avg(score) AS m, any_value(criterion_weight) AS w FROM scores GROUP BY ALL),
comp AS MATERIALIZED (SELECT period, entity, sum(m * w) AS composite, sum(m * w) / sum(w) AS shared,
  count(*) FILTER (WHERE w > 0) AS n_criteria FROM per GROUP BY ALL)"""


def methods(x: str, k: str, flows: bool = True) -> str:
    """Benefit-only methods on long ``x(keys, entity, indicator, x, w)``; all pairs for the flows."""
    pairs = pair_flows(x, k, "promethee", "least((a.x - b.x) / 0.3, 1)") + "," if flows else ""
    return f"""t0 AS (SELECT *, x / CASE WHEN sqrt(sum(x * x) OVER g) = 0 THEN 1 ELSE sqrt(sum(x * x) OVER g) END * w AS v
  FROM {x} WINDOW g AS (PARTITION BY {k}, indicator)),
t1 AS (SELECT *, max(v) OVER g AS hi, min(v) OVER g AS lo FROM t0 WINDOW g AS (PARTITION BY {k}, indicator)),
t2 AS (SELECT {k}, entity, sqrt(sum((v - hi) * (v - hi))) AS dp, sqrt(sum((v - lo) * (v - lo))) AS dn FROM t1 GROUP BY {k}, entity),
topsis AS MATERIALIZED (SELECT *, CASE WHEN dp + dn > 1e-14 THEN dn / (dp + dn) ELSE 0.5 END AS score FROM t2),
v0 AS (SELECT *, w * (max(x) OVER g - x) / CASE WHEN abs(max(x) OVER g - min(x) OVER g) < 1e-10 THEN 1e-10
    ELSE max(x) OVER g - min(x) OVER g END AS regret FROM {x} WINDOW g AS (PARTITION BY {k}, indicator)),
v1 AS (SELECT {k}, entity, sum(regret) AS s, greatest(0, max(regret)) AS r FROM v0 GROUP BY {k}, entity),
vikor AS MATERIALIZED (SELECT *, 0.5 * (s - min(s) OVER g) / CASE WHEN max(s) OVER g = min(s) OVER g THEN 1e-10 ELSE max(s) OVER g - min(s) OVER g END
    + 0.5 * (r - min(r) OVER g) / CASE WHEN max(r) OVER g = min(r) OVER g THEN 1e-10 ELSE max(r) OVER g - min(r) OVER g END AS q
  FROM v1 WINDOW g AS (PARTITION BY {k})),
{pairs}
c0 AS (SELECT *, w * CASE WHEN abs(sum(x) OVER g) > 0 THEN x / abs(sum(x) OVER g) ELSE 1.0::DOUBLE / count(*) OVER g END AS v
  FROM {x} WINDOW g AS (PARTITION BY {k}, indicator)),
c1 AS (SELECT {k}, entity, sum(v) AS q FROM c0 GROUP BY {k}, entity),
copras AS MATERIALIZED (SELECT *, CASE WHEN max(q) OVER (PARTITION BY {k}) > 0 THEN q / max(q) OVER (PARTITION BY {k}) * 100 ELSE 0 END AS utility FROM c1),
e0 AS (SELECT *, x - avg(x) OVER g AS d, greatest(abs(avg(x) OVER g), 1e-10) AS av FROM {x} WINDOW g AS (PARTITION BY {k}, indicator)),
e1 AS (SELECT {k}, entity, sum(w * greatest(d, 0) / av) AS sp, sum(w * greatest(-d, 0) / av) AS sn FROM e0 GROUP BY {k}, entity),
edas AS MATERIALIZED (SELECT *, (CASE WHEN max(sp) OVER g > 0 THEN sp / max(sp) OVER g ELSE 0 END
    + CASE WHEN max(sn) OVER g > 0 THEN 1 - sn / max(sn) OVER g ELSE 1 END) / 2 AS score
  FROM e1 WINDOW g AS (PARTITION BY {k}))"""


def pair_flows(x: str, k: str, name: str, pref: str) -> str:
    """Every pair compared; ``pref`` is the preference for a.x - b.x > 0."""
    on = " AND ".join(f"a.{c} = b.{c}" for c in k.split(", "))
    ks = ", ".join("a." + c for c in k.split(", "))
    other = pref.replace("a.x - b.x", "b.x - a.x")
    return f"""{name}_n AS (SELECT {k}, count(DISTINCT entity) AS n FROM {x} GROUP BY {k}),
{name}_p AS (SELECT {ks}, a.entity,
    sum(a.w * CASE WHEN a.x > b.x THEN {pref} ELSE 0 END) AS plus,
    sum(a.w * CASE WHEN b.x > a.x THEN {other} ELSE 0 END) AS minus
  FROM {x} a JOIN {x} b ON {on} AND a.indicator = b.indicator GROUP BY {ks}, a.entity),
{name} AS MATERIALIZED (SELECT p.*, plus / greatest(n - 1, 1) AS phi_plus, minus / greatest(n - 1, 1) AS phi_minus,
    (plus - minus) / greatest(n - 1, 1) AS phi FROM {name}_p p JOIN {name}_n USING ({k}))"""
