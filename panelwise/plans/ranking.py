"""Panel + weights -> scores of six methods per criterion -> composite ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwise.functions.guards import any_of, lit, ratio, score_key, total
from panelwise.operators import methods as M
from panelwise.operators.critic import FIT, TwoLevelWeights, period_activity, slot_names, slots
from panelwise.operators.ordered import add_ranks
from panelwise.operators.passes import run_programs
from panelwise.operators.promethee import Preference, flows
from panelwise.panel import ENTITY, PERIOD, Panel
from panelwise.session import settle

ALL_METHODS = ("topsis", "vikor", "promethee", "copras", "edas", "base")
MATRIX = [PERIOD, "criterion"]
GROUP = [*MATRIX, "method"]
# the result of each method that becomes its score
RAW = {"topsis": "score", "vikor": "Q", "copras": "utility", "edas": "AS", "saw": "score"}


def period_weights(panel: Panel, weights: TwoLevelWeights, own_criterion_weights: bool = True) -> DataFrame:
    """One row per period: ``has_*``, shares ``share_*`` of the active indicators
    inside their criterion, and criterion weights ``cw_*`` (sum 1).

    ``own_criterion_weights``: use the weights of the second level, also for a
    criterion without data that period; else the sum of the active indicators.
    """
    h = panel.hierarchy
    active = period_activity(panel)
    table = weights.table.select(FIT, *[f"global_{c}" for c in h.indicators], *[f"crit_{k}" for k in h.criteria])
    placed = active.withColumn(FIT, F.col(PERIOD) if weights.per_period else F.lit(0)).join(table, FIT)
    g = {c: F.when(F.col(f"has_{c}"), F.col(f"global_{c}")).otherwise(lit(0)) for c in h.indicators}
    out: dict[str, Column] = {}
    raw: dict[str, Column] = {}
    for k in h.criteria:
        cols = h.groups[k]
        whole = total(g[c] for c in cols)
        n = total(F.when(F.col(f"has_{c}"), lit(1)) for c in cols)
        for c in cols:
            even = F.when(F.col(f"has_{c}"), ratio(lit(1), n)).otherwise(lit(0))
            out[f"share_{c}"] = F.when(whole > 0, ratio(g[c], whole)).otherwise(even)
        raw[k] = F.col(f"crit_{k}") if own_criterion_weights else whole
    every = total(raw.values())
    for k in h.criteria:
        out[f"cw_{k}"] = F.when(every > 0, ratio(raw[k], every)).otherwise(lit(0))
    # both sides are settled and have a row per period: their join needs no own write
    return placed.select(PERIOD, *[f"has_{c}" for c in h.indicators], *[c.alias(n) for n, c in out.items()])


def criterion_matrices(panel: Panel, table: DataFrame) -> DataFrame:
    """One row per (period, criterion, entity) complete in the criterion: indicator
    slots ``x1..`` with cost columns negated, weights ``w1..``, the plain sum
    ``base`` of the raw values, and the criterion weight."""
    h = panel.hierarchy
    rows = panel.data.join(table, PERIOD)
    n = slots(h)
    cells = []
    for k in h.criteria:
        cols = h.groups[k]
        gap = any_of(F.col(f"has_{c}") & F.col(c).isNull() for c in cols)
        some = any_of(F.col(c).isNotNull() for c in cols)
        pad = [F.lit(None).cast("double")] * (n - len(cols))
        signed = [-F.col(c) if c in h.cost else F.col(c) for c in cols] + pad
        shares = [F.col(f"share_{c}") for c in cols] + pad
        cell = F.struct(
            F.lit(k).alias("criterion"),
            total(F.col(c) for c in cols).alias("base"),
            F.col(f"cw_{k}").alias("criterion_weight"),
            *[v.alias(f"x{i + 1}") for i, v in enumerate(signed)],
            *[v.alias(f"w{i + 1}") for i, v in enumerate(shares)],
        )
        cells.append(F.when(some & ~gap, cell))
    return rows.select(PERIOD, ENTITY, F.inline(F.filter(F.array(*cells), lambda s: s.isNotNull())))


def scaled_matrices(panel: Panel, table: DataFrame) -> DataFrame:
    """The criterion matrices with every slot scaled to [0, 1], 1 best."""
    h = panel.hierarchy
    names = slot_names(h)
    out, found = run_programs(
        criterion_matrices(panel, table), MATRIX, {"scale": M.ranking_scale(names, F.col, frozenset())}
    )
    keep = [PERIOD, "criterion", ENTITY, "base", "criterion_weight", *[x.replace("x", "w") for x in names]]
    return settle(out.select(*keep, *[found["scale"][x].alias(x) for x in names]))


def method_scores(
    panel: Panel,
    weights: TwoLevelWeights,
    methods: Sequence[str] = ALL_METHODS,
    own_criterion_weights: bool = True,
    preference: Preference = Preference(),
    ranked: bool = True,
) -> DataFrame:
    """``(period, criterion, entity, method, raw, score, criterion_weight[, rank])``
    for all periods, criteria and methods.

    ``score`` is the method's result scaled to [0, 1], 1 best.
    """
    h = panel.hierarchy
    table = period_weights(panel, weights, own_criterion_weights)
    rows = scaled_matrices(panel, table)
    parts = []
    wide = [m for m in methods if m != "promethee"]
    if wide:
        parts.append(_closed_form(rows, h, wide))
    if "promethee" in methods:
        parts.append(_flow_method(rows, h, preference))
    raws = settle(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    scores = _unit_scores(raws)
    return rank_scores(scores) if ranked else scores


def _closed_form(rows: DataFrame, h, wide: Sequence[str]) -> DataFrame:
    """Raw results of the closed-form methods, which share each pass over the rows."""
    names = slot_names(h)
    weight = lambda x: F.col(x.replace("x", "w"))
    programs = {m: M.METHODS[m](names, F.col, weight) for m in wide if m != "base"}
    out, found = run_programs(rows, MATRIX, programs)
    raw = {m: F.col("base") if m == "base" else found[m][RAW[m]] for m in wide}
    cells = F.array(*[F.struct(F.lit(m).alias("method"), raw[m].alias("raw")) for m in wide])
    return out.select(*MATRIX, ENTITY, "criterion_weight", F.inline(cells))


def _unit_scores(raws: DataFrame) -> DataFrame:
    """``score``: the raw result scaled to [0, 1] within (period, criterion, method), 1 best."""
    up = F.when(F.col("method") == "vikor", -F.col("raw")).otherwise(F.col("raw"))
    out, found = run_programs(raws, GROUP, {"unit": M.unit_scale(up)})
    return out.select(*MATRIX, ENTITY, "criterion_weight", "method", "raw", found["unit"]["score"].alias("score"))


def long_scaled(rows: DataFrame, h) -> DataFrame:
    """``(period, criterion, entity, criterion_weight, indicator, x, w)``; the
    indicator is its slot in the criterion."""
    cells = F.array(
        *[
            F.struct(F.lit(x).alias("indicator"), F.col(x).alias("x"), F.col(x.replace("x", "w")).alias("w"))
            for x in slot_names(h)
        ]
    )
    return rows.select(*MATRIX, ENTITY, "criterion_weight", F.inline(cells)).where(F.col("x").isNotNull())


def _flow_method(rows: DataFrame, h, preference: Preference) -> DataFrame:
    net = flows(long_scaled(rows, h), [*MATRIX, "criterion_weight"], ENTITY, preference)
    return net.select(
        *MATRIX, ENTITY, "criterion_weight", F.lit("promethee").alias("method"), F.col("phi").alias("raw")
    )


def rank_scores(scores: DataFrame) -> DataFrame:
    """Ranks within (period, criterion, method): truncated average rank, ``min`` for base."""
    keyed = scores.withColumn("_key", score_key(F.col("score")))
    ranked = add_ranks(keyed, GROUP, {"_t": ("_key", True, "truncated"), "_f": ("_key", True, "min")})
    return ranked.withColumn("rank", F.when(F.col("method") == "base", F.col("_f")).otherwise(F.col("_t"))).drop(
        "_key", "_t", "_f"
    )


def composite(scores: DataFrame, renormalise: bool = False) -> DataFrame:
    """``(period, entity, composite, n_criteria)``: sum over criteria of weight x mean
    method score. A missing criterion adds nothing, unless ``renormalise``."""
    # an entity has the same methods in every criterion, and its rows come from one row:
    # one aggregation whose map side already folds them into one
    w = F.col("criterion_weight")
    per = scores.groupBy(PERIOD, ENTITY).agg(
        F.sum(F.col("score") * w).alias("_sum"),
        F.sum(w).alias("_w"),
        F.count(F.lit(1)).alias("_rows"),
        F.size(F.collect_set("criterion")).alias("_criteria"),
        F.size(F.collect_set(F.when(w > 0, F.col("criterion")))).cast("long").alias("n_criteria"),
    )
    methods = F.col("_rows") / F.col("_criteria")
    value = ratio(F.col("_sum"), F.col("_w")) if renormalise else F.col("_sum") / methods
    return per.select(PERIOD, ENTITY, value.alias("composite"), "n_criteria")


def composite_ranks(scores: DataFrame, renormalise: bool = False) -> DataFrame:
    """The composite with its truncated average rank per period."""
    out = settle(composite(scores, renormalise).withColumn("_key", score_key(F.col("composite"))))
    return add_ranks(out, [PERIOD], {"rank": ("_key", True, "truncated")}).drop("_key")


def rank_panel(
    panel: Panel, weights: TwoLevelWeights, methods: Sequence[str] = ALL_METHODS, renormalise: bool = False
) -> DataFrame:
    """End to end: scores of all methods, combined and ranked, for every period."""
    return composite_ranks(settle(method_scores(panel, weights, methods, ranked=False)), renormalise)
