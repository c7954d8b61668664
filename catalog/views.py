"""Availability and panel views."""

from pyspark.sql import functions as F

from catalog.registry import query
from oracle.base import CRITERIA, INDICATORS, long, r
from panelwise.operators import views as V
from panelwise.operators.critic import usable_rows
from panelwise.panel import to_long
from panelwise.session import settle
from panelwise.sources.files import to_number
from panelwise.sources.tables import CUSTOMER_HIERARCHY, SUPPLIER_HIERARCHY, customer_panel, supplier_panel, table

LONG = "WITH " + long()
BIG = "period::BIGINT AS period"


@query("entity_activity", f"""{LONG} SELECT {BIG}, entity, count(value) AS n_present, count(value) > 0 AS active
FROM obs GROUP BY period, entity""")
def entity_activity(spark, folder):
    return V.entity_activity(supplier_panel(spark, folder))


@query("indicator_activity", f"""{LONG} SELECT {BIG}, criterion, indicator, count(value) AS n_present, count(value) > 0 AS active
FROM obs GROUP BY period, criterion, indicator""")
def indicator_activity(spark, folder):
    return V.indicator_activity(supplier_panel(spark, folder))


@query("criterion_activity", f"""{LONG}, i AS (SELECT period, criterion, indicator, count(value) > 0 AS a FROM obs GROUP BY ALL)
SELECT {BIG}, criterion, count(*) FILTER (WHERE a) AS n_active_indicators, bool_or(a) AS active FROM i GROUP BY period, criterion""")
def criterion_activity(spark, folder):
    return V.criterion_activity(supplier_panel(spark, folder))


@query("complete_cases", f"{LONG} SELECT {BIG}, criterion, entity FROM cases")
def complete_cases(spark, folder):
    panel = supplier_panel(spark, folder)
    return V.complete_cases(panel.with_data(settle(panel.data)))


@query("valid_pairs", f"{LONG} SELECT {BIG}, entity, indicator, {r('value')} AS value FROM obs WHERE value IS NOT NULL")
def valid_pairs(spark, folder):
    return V.valid_pairs(supplier_panel(spark, folder))


@query("valid_cell_lookup", f"""{LONG} SELECT {BIG}, entity, indicator FROM obs
WHERE value IS NOT NULL AND entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def valid_cell_lookup(spark, folder):
    """Membership test: all cells of suppliers in debt, kept where a value is present."""
    panel = supplier_panel(spark, folder)
    debtors = table(spark, folder, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("entity"))
    probes = panel.long().select("period", "entity", "indicator").join(debtors, "entity", "left_semi")
    return V.is_valid(panel, probes)


@query("criterion_means", f"""{LONG}, c AS (SELECT entity, period, criterion, avg(value) AS v FROM obs GROUP BY ALL)
SELECT entity, {BIG}, {", ".join(f"{r(f"max(v) FILTER (WHERE criterion = '{k}')")} AS {k}" for k in CRITERIA)}
FROM c GROUP BY entity, period""")
def criterion_means(spark, folder):
    return V.criterion_means(supplier_panel(spark, folder))


@query("final_means", f"""{LONG}, c AS (SELECT entity, period, criterion, avg(value) AS v FROM obs GROUP BY ALL)
SELECT entity, {BIG}, {r("avg(v)")} AS final, count(v) AS n_criteria FROM c GROUP BY entity, period""")
def final_means(spark, folder):
    return V.final_means(supplier_panel(spark, folder))


@query("criterion_matrix", f"""{LONG} SELECT {BIG}, p.entity, {r("I21")} AS I21, {r("I22")} AS I22
FROM panel p JOIN cases c USING (period, entity) WHERE c.criterion = 'K2'""")
def criterion_matrix(spark, folder):
    panel = supplier_panel(spark, folder)
    return V.criterion_matrix(panel.with_data(settle(panel.data)), "K2")


@query("entity_history", f"""{LONG} SELECT entity, {BIG}, {", ".join(f"{r(i)} AS {i}" for i in INDICATORS)}
FROM panel WHERE entity = (SELECT max(l_suppkey) FROM lineitem)""")
def entity_history(spark, folder):
    """The filter on the entity reaches the scan of the transactions."""
    last = table(spark, folder, "lineitem").agg(F.max("l_suppkey")).first()[0]
    return V.entity_history(supplier_panel(spark, folder), last)


@query("entity_criteria_history", f"""{LONG}, c AS (SELECT entity, period, criterion, avg(value) AS v FROM obs
  WHERE entity = (SELECT max(l_suppkey) FROM lineitem) GROUP BY ALL)
SELECT entity, {BIG}, {", ".join(f"{r(f"max(v) FILTER (WHERE criterion = '{k}')")} AS {k}" for k in CRITERIA)}
FROM c GROUP BY entity, period""")
def entity_criteria_history(spark, folder):
    last = table(spark, folder, "lineitem").agg(F.max("l_suppkey")).first()[0]
    return V.entity_history(supplier_panel(spark, folder), last, criteria=True)


@query("valid_series", f"""{LONG} SELECT {BIG}, {r("value")} AS value FROM obs
WHERE value IS NOT NULL AND indicator = 'I22' AND entity = (SELECT min(l_suppkey) FROM lineitem)""")
def valid_series(spark, folder):
    first = table(spark, folder, "lineitem").agg(F.min("l_suppkey")).first()[0]
    return V.valid_series(supplier_panel(spark, folder), first, "I22")


@query("latest_period", f"""{LONG} SELECT entity, {BIG}, {", ".join(f"{r(i)} AS {i}" for i in INDICATORS)}
FROM panel WHERE period = (SELECT max(period) FROM panel)""")
def latest_period(spark, folder):
    return V.period_slice(supplier_panel(spark, folder))


def _gone(names, test):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test(n)} THEN '{n}' END" for n in names) + ")"


@query("availability_report", f"""{LONG},
i AS (SELECT period, criterion, indicator, count(value) AS n FROM obs GROUP BY ALL),
w AS (SELECT period, {", ".join(f"max(n) FILTER (WHERE indicator = '{i}') AS {i}" for i in INDICATORS)},
  {", ".join(f"max(n) FILTER (WHERE criterion = '{k}') AS {k}" for k in CRITERIA)},
  count(*) FILTER (WHERE n > 0) AS n_active_indicators, count(DISTINCT criterion) FILTER (WHERE n > 0) AS n_active_criteria
  FROM i GROUP BY period),
e AS (SELECT period, entity, count(value) > 0 AS a FROM obs GROUP BY ALL)
SELECT {BIG}, count(*) AS n_entities, count(*) FILTER (WHERE a) AS n_active_entities,
  count(*) FILTER (WHERE NOT a) AS n_excluded_entities, any_value(n_active_indicators) AS n_active_indicators,
  any_value(n_active_criteria) AS n_active_criteria,
  any_value({_gone(INDICATORS, lambda i: f"{i} = 0")}) AS excluded_indicators,
  any_value({_gone(CRITERIA, lambda k: f"{k} = 0")}) AS excluded_criteria
FROM e JOIN w USING (period) GROUP BY period""")
def availability_report(spark, folder):
    return V.availability_report(supplier_panel(spark, folder))


@query("future_context", f"""{LONG}, last AS (SELECT criterion, indicator FROM act WHERE period = (SELECT max(period) FROM panel))
SELECT e.entity, (SELECT max(period) + 1 FROM panel)::BIGINT AS period, criterion, indicator
FROM (SELECT DISTINCT entity FROM panel) e, last""")
def future_context(spark, folder):
    panel = supplier_panel(spark, folder)
    return V.future_context(panel.with_data(settle(panel.data)))


@query("non_empty_rows", f"{LONG} SELECT entity, {BIG} FROM obs GROUP BY entity, period HAVING count(value) > 0")
def non_empty_rows(spark, folder):
    return V.entity_activity(supplier_panel(spark, folder)).where("active").select("entity", "period")


@query("non_empty_columns", f"{LONG} SELECT {BIG}, indicator FROM obs GROUP BY period, indicator HAVING count(value) > 0")
def non_empty_columns(spark, folder):
    return V.indicator_activity(supplier_panel(spark, folder)).where("active").select("period", "indicator")


@query("matrix_report", f"""{LONG}, rr AS (SELECT period, entity, count(value) > 0 AS a FROM obs GROUP BY ALL),
rc AS (SELECT period, count(*) AS n_rows, count(*) FILTER (WHERE a) AS n_kept_rows, count(*) FILTER (WHERE NOT a) AS n_dropped_rows FROM rr GROUP BY period),
cc AS (SELECT period, indicator, count(value) > 0 AS a FROM obs GROUP BY ALL)
SELECT {BIG}, any_value(n_rows) AS n_rows, any_value(n_kept_rows) AS n_kept_rows, any_value(n_dropped_rows) AS n_dropped_rows,
  count(*) FILTER (WHERE a) AS n_kept_columns, count(*) FILTER (WHERE NOT a) AS n_dropped_columns,
  coalesce(string_agg(indicator, ',' ORDER BY indicator) FILTER (WHERE NOT a), '') AS dropped_columns
FROM cc JOIN rc USING (period) GROUP BY period""")
def matrix_report(spark, folder):
    panel = supplier_panel(spark, folder)
    return V.matrix_report(panel.data, panel.indicators, ["period"])


@query("usable_rows", f"""{LONG}, u AS (SELECT o.period, o.entity FROM obs o JOIN act USING (period, indicator)
  GROUP BY ALL HAVING count(o.value) = count(*))
SELECT {BIG}, count(*) AS n_rows FROM u GROUP BY period""")
def usable(spark, folder):
    panel = supplier_panel(spark, folder)
    return V.usable_row_counts(usable_rows(panel.with_data(settle(panel.data))))


@query("target_completeness", f"""{LONG} SELECT {BIG}, count(*) FILTER (WHERE n = 4) AS n_complete, count(*) AS n_rows FROM (
  SELECT period, entity, count(DISTINCT criterion) FILTER (WHERE value IS NOT NULL) AS n FROM obs GROUP BY ALL) GROUP BY period""")
def target_completeness(spark, folder):
    panel = supplier_panel(spark, folder)
    means = V.criterion_means(panel)
    done = V.target_complete(means, panel.hierarchy.criteria)
    return means.groupBy("period").agg(
        F.count(F.when(done, 1)).alias("n_complete"), F.count(F.lit(1)).alias("n_rows")
    )


@query("matrix_key_check", """WITH a AS (SELECT DISTINCT l_suppkey AS entity, year(l_shipdate) AS period FROM lineitem),
l AS (SELECT entity FROM a WHERE period = 2001), r AS (SELECT s_suppkey AS entity FROM supplier)
SELECT entity, 'left' AS side FROM l WHERE entity NOT IN (SELECT entity FROM r)
UNION ALL SELECT entity, 'right' FROM r WHERE entity NOT IN (SELECT entity FROM l)""")
def matrix_key_check(spark, folder):
    """Entities of the latest matrix against the register of suppliers."""
    panel = supplier_panel(spark, folder)
    register = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("entity"))
    return V.compare_keys(panel.data.where("period = 2001"), register, ["entity"])


@query("null_counts", f"""{LONG} SELECT {BIG}, indicator, count(*) - count(value) AS n_missing, count(*) AS n_rows
FROM obs GROUP BY period, indicator""")
def null_counts(spark, folder):
    return V.null_counts(supplier_panel(spark, folder))


@query("duplicate_entities", """SELECT l_orderkey AS entity, year(l_shipdate)::BIGINT AS period, count(*) AS n
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_entities(spark, folder):
    """The duplicate audit on raw rows, where one order ships several lines a year."""
    raw = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("entity"), F.year("l_shipdate").alias("period")
    )
    return V.duplicate_keys(raw)


@query("structural_gaps", f"{LONG} SELECT {BIG}, criterion, indicator FROM obs GROUP BY ALL HAVING count(value) = 0")
def structural_gaps(spark, folder):
    return V.structural_gaps(supplier_panel(spark, folder))


@query("numeric_coercion", f"""SELECT doc_id AS entity, lang, {r("CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END")} AS value
FROM (SELECT doc_id, lang, try_cast(regexp_extract(text, '[0-9]+[.]?[0-9]*') AS DOUBLE) AS v FROM documents)""")
def numeric_coercion(spark, folder):
    """First number of each text; no number is a missing value, not an error."""
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", "lang", F.regexp_extract("text", "[0-9]+[.]?[0-9]*", 0).alias("cell"))
    return found.select(F.col("doc_id").alias("entity"), "lang", to_number("cell").alias("value"))


@query("customer_panel_long", f"""SELECT o_custkey::BIGINT AS entity, year(o_orderdate)::BIGINT AS period, i.indicator,
  {r("CASE i.indicator WHEN 'J11' THEN count(*)::DOUBLE WHEN 'J12' THEN round(sum(o_totalprice), 2) WHEN 'J21' THEN round(avg(o_totalprice), 8) WHEN 'J22' THEN max(o_totalprice) ELSE round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END), 8) END")} AS value
FROM orders, (VALUES ('J11'), ('J12'), ('J21'), ('J22'), ('J31')) i(indicator) GROUP BY 1, 2, 3""")
def customer_panel_long(spark, folder):
    """Wide to long on the largest panel."""
    return to_long(customer_panel(spark, folder).data, CUSTOMER_HIERARCHY.indicators)


@query("criteria_from_indicators", f"""{LONG}, lw(indicator, w) AS (VALUES {", ".join(f"('{i}', {1 + n}.0::DOUBLE)" for n, i in enumerate(INDICATORS))}),
c AS (SELECT entity, period, criterion, sum(value * w) / sum(w) FILTER (WHERE value IS NOT NULL) AS v FROM obs JOIN lw USING (indicator) GROUP BY ALL)
SELECT entity, {BIG}, {", ".join(f"{r(f"max(v) FILTER (WHERE criterion = '{k}')")} AS {k}" for k in CRITERIA)}
FROM c GROUP BY entity, period""")
def criteria_from_indicators(spark, folder):
    """Indicators to criteria by given local weights, renormalised over those present."""
    weights = {c: 1.0 + n for n, c in enumerate(SUPPLIER_HIERARCHY.indicators)}
    return V.weighted_criteria(supplier_panel(spark, folder), weights)
