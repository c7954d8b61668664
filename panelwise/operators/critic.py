"""Objective weights from dispersion and conflict (the CRITIC method).

weight_j is proportional to sd_j * sum_k (1 - r_jk). Min-max scaling leaves r
unchanged and divides sd by the range, so the scaled matrix is never built: one
aggregation gives every sd, range and covariance of all criteria and groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwise.functions.guards import all_of, any_of, lit, present, ratio, total
from panelwise.operators.passes import with_stats
from panelwise.panel import Hierarchy, Panel
from panelwise.session import settle

EPS = 1e-10
FIT = "fit"


def _pairs(columns: Sequence[str]):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def critic_statistics(
    df: DataFrame,
    by: Sequence[str],
    blocks: Mapping[str, Sequence[str]],
    scale: bool = True,
    row_weight: str | None = None,
) -> DataFrame:
    """One row per group with, for each block and column, ``sd``, ``conflict``,
    ``info`` and ``weight`` (columns named ``<what>_<column>``), and the
    correlations ``r_<a>_<b>``.

    Columns of a block must be NULL together: mask incomplete rows first (see
    ``mask_incomplete``). A column NULL in a whole group does not take part.
    """
    if row_weight is not None:
        df = _centred(df, by, [c for columns in blocks.values() for c in columns], row_weight)
    aggs: list[Column] = []
    for columns in blocks.values():
        for c in columns:
            x = F.col(c)
            aggs += [
                F.count(x).alias(f"_n_{c}"),
                F.min(x).alias(f"_min_{c}"),
                F.max(x).alias(f"_max_{c}"),
            ]
            if row_weight is None:
                aggs.append(F.stddev_samp(x).alias(f"_sd_{c}"))
            else:
                w = F.when(x.isNotNull(), F.col(row_weight))
                aggs += [F.sum(w).alias(f"_w_{c}"), F.sum(w * x).alias(f"_wx_{c}"), F.sum(w * x * x).alias(f"_wxx_{c}")]
        for a, b in _pairs(columns):
            if row_weight is None:
                aggs.append(F.covar_samp(a, b).alias(f"_cov_{a}_{b}"))
            else:
                aggs.append(F.sum(F.col(row_weight) * F.col(a) * F.col(b)).alias(f"_wxy_{a}_{b}"))
    base = df.groupBy(*by).agg(*aggs)
    if row_weight is not None:
        base = _weighted_moments(base, blocks)
    keep, steps = list(by), base
    for block, columns in blocks.items():
        steps = _block_weights(steps, columns, scale, row_weight is not None)
        keep += [f"{what}_{c}" for c in columns for what in ("sd", "conflict", "info", "weight")]
        keep += [f"r_{a}_{b}" for a, b in _pairs(columns)]
        keep += [f"_n_{c}" for c in columns]
    return steps.select(*keep)


def _centred(df: DataFrame, by: Sequence[str], columns: Sequence[str], row_weight: str) -> DataFrame:
    """Shift every column by its weighted mean, so that sums of squares do not cancel."""
    w = F.col(row_weight)
    means = {
        f"_m_{c}": ratio(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w))) for c in columns
    }
    return with_stats(df, by, means).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns})


def _weighted_moments(base: DataFrame, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Population moments of weighted rows; a deviation below EPS is floored."""
    for columns in blocks.values():
        mean = {c: ratio(F.col(f"_wx_{c}"), F.col(f"_w_{c}")) for c in columns}
        base = base.withColumns(
            {
                f"_sd_{c}": F.sqrt(F.greatest(ratio(F.col(f"_wxx_{c}"), F.col(f"_w_{c}")) - mean[c] * mean[c], lit(0)))
                for c in columns
            }
        )
        pairs = _pairs(columns)
        if pairs:
            base = base.withColumns(
                {
                    f"_cov_{a}_{b}": ratio(F.col(f"_wxy_{a}_{b}"), F.col(f"_w_{a}")) - mean[a] * mean[b]
                    for a, b in pairs
                }
            )
    return base


def _block_weights(df: DataFrame, columns: Sequence[str], scale: bool, weighted: bool) -> DataFrame:
    active = {c: F.col(f"_n_{c}") > 0 for c in columns}
    n_active = total(F.when(active[c], lit(1)) for c in columns)
    n_rows = F.greatest(*[F.col(f"_n_{c}") for c in columns]) if len(columns) > 1 else F.col(f"_n_{columns[0]}")
    new: dict[str, Column] = {}
    for c in columns:
        sd = F.col(f"_sd_{c}")
        if scale:
            sd = sd / F.greatest(F.col(f"_max_{c}") - F.col(f"_min_{c}"), lit(EPS))
        floor = F.greatest(sd, lit(EPS)) if weighted else F.when(sd == 0, lit(EPS)).otherwise(sd)
        new[f"sd_{c}"] = F.when(active[c], floor)
    for a, b in _pairs(columns):
        r = ratio(F.col(f"_cov_{a}_{b}"), F.col(f"_sd_{a}") * F.col(f"_sd_{b}"))
        if weighted:
            r = F.least(F.greatest(r, lit(-1)), lit(1))
        new[f"r_{a}_{b}"] = F.when(active[a] & active[b], F.coalesce(r, lit(1)))
    df = df.withColumns(new)
    conflict = {}
    for c in columns:
        others = [1 - F.col(f"r_{a}_{b}") for a, b in _pairs(columns) if c in (a, b)]
        conflict[f"conflict_{c}"] = F.when(active[c], F.greatest(total(others) if others else lit(0), lit(EPS)))
    df = df.withColumns(conflict)
    df = df.withColumns({f"info_{c}": F.col(f"sd_{c}") * F.col(f"conflict_{c}") for c in columns})
    df = df.withColumns(
        {
            "_whole": total(F.col(f"info_{c}") for c in columns),
            "_equal": F.when(n_rows < 2, lit(1)).otherwise(lit(0)),
            "_share": ratio(lit(1), n_active),
        }
    )
    even = (F.col("_equal") == 1) | (F.col("_whole") < EPS)
    return df.withColumns(
        {
            f"weight_{c}": F.when(~active[c], lit(0))
            .when(even, F.col("_share"))
            .otherwise(ratio(F.col(f"info_{c}"), F.col("_whole")))
            for c in columns
        }
    )


def mask_incomplete(df: DataFrame, columns: Sequence[str], active: Mapping[str, Column]) -> dict[str, Column]:
    """The block's columns, NULL on rows where an active column is missing."""
    complete = all_of(F.col(c).isNotNull() | ~active[c] for c in columns)
    return {c: F.when(complete, F.col(c)) for c in columns}


def critic_matrix(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    scale: bool = False,
    row_weight: str | None = None,
) -> DataFrame:
    """CRITIC of one matrix per group: incomplete rows are dropped first."""
    rows = df.where(all_of(F.col(c).isNotNull() for c in columns))
    return critic_statistics(rows, by, {"m": list(columns)}, scale, row_weight)


def unpivot_weights(stats: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(by.., indicator, sd, conflict, info, weight)``."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("indicator"),
                *[F.col(f"{w}_{c}").alias(w) for w in ("sd", "conflict", "info", "weight")],
            )
            for c in columns
        ]
    )
    return stats.select(*by, F.inline(rows))


def unpivot_correlations(stats: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(by.., indicator, other, r)`` for each pair of different indicators, both orders."""
    rows = []
    for a, b in _pairs(list(columns)):
        for x, y in ((a, b), (b, a)):
            rows.append(
                F.struct(F.lit(x).alias("indicator"), F.lit(y).alias("other"), F.col(f"r_{a}_{b}").alias("r"))
            )
    return stats.select(*by, F.inline(F.array(*rows)))


# ---------------------------------------------------------------- two levels


def activity(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group: ``has_<column>``, whether any value is present."""
    return df.groupBy(*by).agg(*[(F.count(c) > 0).alias(f"has_{c}") for c in columns])


def period_activity(panel: Panel) -> DataFrame:
    """:func:`activity` by period, computed once per panel and kept with it."""
    if "activity" not in panel.known:
        panel.known["activity"] = settle(activity(panel.data, ["period"], panel.indicators))
    return panel.known["activity"]


def usable_rows(panel: Panel) -> DataFrame:
    """Rows complete in every indicator that is active in their period; adds ``has_*``."""
    columns = panel.indicators
    rows = panel.data.join(period_activity(panel), "period")
    has = [F.col(f"has_{c}") for c in columns]
    return rows.where(all_of(F.col(c).isNotNull() | ~h for c, h in zip(columns, has)) & any_of(has))


def composite(columns: Sequence[str], weight) -> Column:
    """Weighted mean over the columns present; NULL only if all are missing."""
    seen = total(F.when(F.col(c).isNotNull(), weight(c)) for c in columns)
    return ratio(total(F.col(c) * weight(c) for c in columns), seen)


def two_level_weights(panel: Panel, per_period: bool = False) -> TwoLevelWeights:
    """CRITIC inside each criterion, then CRITIC of the criterion composites per
    regime (rows with the same criteria missing), blended by regime size.

    The panel is read four times; settle it first if it is costly to derive."""
    h: Hierarchy = panel.hierarchy
    rows = usable_rows(panel).drop(*[f"has_{c}" for c in h.indicators])
    rows = rows.withColumn(FIT, F.col("period") if per_period else F.lit(0))
    local = local_weights(rows, h)
    placed = rows.join(local.select(FIT, *[f"local_{c}" for c in h.indicators]), FIT)
    z = placed.select(
        FIT,
        *[composite(h.groups[k], lambda c: F.col(f"local_{c}")).alias(k) for k in h.criteria],
    )
    regimes = regime_weights(z, h.criteria)
    blended = blend_regimes(regimes, h.criteria)
    return TwoLevelWeights(h, rows, local, regimes, settle(global_weights(local, blended, h)), per_period)


def criterion_rows(rows: DataFrame, h: Hierarchy, ids: Sequence[str]) -> DataFrame:
    """One row per (ids, criterion) with any indicator present.

    The indicators of a criterion sit in slots ``x1, x2, ..``, so that one set of
    aggregates serves every criterion and the plan does not grow with their
    number. ``pattern`` says which slots are present, as text of 0 and 1.
    """
    cells = []
    for k in h.criteria:
        cols = h.groups[k]
        pad = slots(h) - len(cols)
        values = [F.col(c) for c in cols] + [F.lit(None).cast("double")] * pad
        bits = [F.when(F.col(c).isNotNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols]
        cell = F.struct(
            F.lit(k).alias("criterion"),
            F.concat(*bits, F.lit("0" * pad)).alias("pattern"),
            *[v.alias(f"x{i + 1}") for i, v in enumerate(values)],
        )
        cells.append(F.when(any_of(F.col(c).isNotNull() for c in cols), cell))
    return rows.select(*ids, F.inline(F.filter(F.array(*cells), lambda s: s.isNotNull())))


def slots(h: Hierarchy) -> int:
    return max(len(h.groups[k]) for k in h.criteria)


def slot_names(h: Hierarchy) -> list[str]:
    return [f"x{i + 1}" for i in range(slots(h))]


def local_weights(rows: DataFrame, h: Hierarchy) -> DataFrame:
    """Level 1: weights inside each criterion, per fit, on rows complete in that criterion.

    One pass gives the statistics per (fit, criterion, pattern of present slots). An
    indicator is active in a fit if any of its patterns has it; the complete rows are
    those whose pattern has every active slot.
    """
    names = slot_names(h)
    stats = critic_statistics(criterion_rows(rows, h, [FIT]), [FIT, "criterion", "pattern"], {"m": names}).select(
        FIT, "criterion", "pattern", *[f"weight_{x}" for x in names]
    )
    out = []
    for k in h.criteria:
        mine = F.col("criterion") == k
        for i, c in enumerate(h.groups[k]):
            has = F.max(F.when(mine, F.substring("pattern", i + 1, 1))) == "1"
            out.append(F.coalesce(has, F.lit(False)).alias(f"has_{c}"))
    # patterns x criteria rows per fit; the weights of every pattern come along as a map
    weights = F.map_from_entries(
        F.collect_list(
            F.struct(
                F.concat("criterion", F.lit("|"), "pattern"), F.array(*[F.col(f"weight_{x}") for x in names])
            )
        )
    )
    wide = stats.groupBy(FIT).agg(*out, weights.alias("_weights"))
    done: dict[str, Column] = {}
    for k in h.criteria:
        cols = h.groups[k]
        bits = [F.when(F.col(f"has_{c}"), F.lit("1")).otherwise(F.lit("0")) for c in cols]
        done[f"_w_{k}"] = F.try_element_at(
            "_weights", F.concat(F.lit(f"{k}|"), *bits, F.lit("0" * (slots(h) - len(cols))))
        )
    wide = wide.withColumns(done)
    local: dict[str, Column] = {}
    for k in h.criteria:
        cols = h.groups[k]
        n_has = total(F.when(F.col(f"has_{c}"), lit(1)) for c in cols)
        for i, c in enumerate(cols):
            # weights of a pattern sum to 1 over its slots; no complete row: equal shares
            share = F.coalesce(F.col(f"_w_{k}")[i], ratio(lit(1), n_has))
            local[f"local_{c}"] = F.when(F.col(f"has_{c}"), share).otherwise(lit(0))
    return settle(wide.select(FIT, *[v.alias(n) for n, v in local.items()]))


def regime_weights(z: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """Level 2 per regime; the regime key spells which criteria are present."""
    key = F.concat(*[F.when(F.col(k).isNull(), F.lit("0")).otherwise(F.lit("1")) for k in criteria])
    keyed = z.withColumn("regime", key).where(present(F.col(k) for k in criteria) > 0)
    stats = critic_statistics(keyed, [FIT, "regime"], {"criteria": list(criteria)})
    n = F.greatest(*[F.col(f"_n_{k}") for k in criteria]) if len(criteria) > 1 else F.col(f"_n_{criteria[0]}")
    return stats.select(
        FIT, "regime", n.alias("n_rows"), *[F.col(f"weight_{k}").alias(f"crit_{k}") for k in criteria]
    )


def blend_regimes(regimes: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """Mean of the regime weights by row count, renormalised."""
    sums = regimes.groupBy(FIT).agg(
        F.sum("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_regimes"),
        *[F.sum(F.col(f"crit_{k}") * F.col("n_rows")).alias(f"_s_{k}") for k in criteria],
    )
    whole = total(F.col(f"_s_{k}") for k in criteria)
    cols = {
        f"crit_{k}": F.when(whole > 0, ratio(F.col(f"_s_{k}"), whole)).otherwise(lit(1 / len(criteria)))
        for k in criteria
    }
    return sums.select(FIT, "n_rows", "n_regimes", *[c.alias(n) for n, c in cols.items()])


def global_weights(local: DataFrame, blended: DataFrame, h: Hierarchy) -> DataFrame:
    """Local x criterion weight, renormalised over all indicators."""
    both = local.select(FIT, *[f"local_{c}" for c in h.indicators]).join(blended, FIT)
    raw = {c: F.col(f"local_{c}") * F.col(f"crit_{k}") for c, k in h.criterion_of.items()}
    whole = total(raw.values())
    return both.withColumns({f"global_{c}": F.when(whole > 0, ratio(raw[c], whole)).otherwise(lit(0)) for c in raw})


class TwoLevelWeights:
    """The tables of one weighting run; every one has a ``fit`` key (a period, or 0 if pooled)."""

    def __init__(self, h: Hierarchy, rows: DataFrame, local: DataFrame, regimes: DataFrame, table: DataFrame,
                 per_period: bool):
        self.hierarchy, self.rows, self.local, self.regimes, self.table = h, rows, local, regimes, table
        self.per_period = per_period

    def long(self) -> DataFrame:
        """``(fit, criterion, indicator, local_weight, criterion_weight, weight)``."""
        rows = F.array(
            *[
                F.struct(
                    F.lit(k).alias("criterion"),
                    F.lit(c).alias("indicator"),
                    F.col(f"local_{c}").alias("local_weight"),
                    F.col(f"crit_{k}").alias("criterion_weight"),
                    F.col(f"global_{c}").alias("weight"),
                )
                for c, k in self.hierarchy.criterion_of.items()
            ]
        )
        return self.table.select(FIT, F.inline(rows))

    def criteria_long(self) -> DataFrame:
        """``(fit, criterion, weight)``."""
        rows = F.array(
            *[
                F.struct(F.lit(k).alias("criterion"), F.col(f"crit_{k}").alias("weight"))
                for k in self.hierarchy.criteria
            ]
        )
        return self.table.select(FIT, F.inline(rows))


def adaptive_weights(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Drop empty rows, then empty columns, then CRITIC; dropped columns weigh 0.

    Incomplete rows left after that are excluded by the complete-case rule.
    """
    by = list(by) or ["_fit"]
    rows = df if by != ["_fit"] else df.withColumn("_fit", F.lit(0))
    rows = rows.where(present(F.col(c) for c in columns) > 0)
    active = settle(activity(rows, by, columns))
    placed = rows.join(active, by)
    masked = mask_incomplete(placed, columns, {c: F.col(f"has_{c}") for c in columns})
    stats = critic_statistics(placed.select(*by, *[m.alias(c) for c, m in masked.items()]), by, {"m": list(columns)}, scale=False)
    return stats if by != ["_fit"] else stats.drop("_fit")


def adaptive_two_level(
    indicators: DataFrame, criteria: DataFrame, h: Hierarchy, by: Sequence[str]
) -> DataFrame:
    """``(by.., criterion, indicator, local_weight, criterion_weight, weight)`` from a table
    of indicators and a table of criterion scores, each weighted by :func:`adaptive_weights`.

    A criterion whose indicators give no weights gets equal ones."""
    by = list(by)
    out = adaptive_weights(criteria, h.criteria, by).select(*by, *[F.col(f"weight_{k}").alias(f"_c_{k}") for k in h.criteria])
    for k in h.criteria:
        cols = h.groups[k]
        local = adaptive_weights(indicators, cols, by).select(*by, *[F.col(f"weight_{c}").alias(f"_l_{c}") for c in cols])
        out = out.join(local, by, "left")
    cells = []
    for k in h.criteria:
        cols = h.groups[k]
        whole = total(F.col(f"_l_{c}") for c in cols)
        for c in cols:
            share = F.when(whole > 0, ratio(F.col(f"_l_{c}"), whole)).otherwise(lit(1 / len(cols)))
            cells.append(
                F.struct(
                    F.lit(k).alias("criterion"), F.lit(c).alias("indicator"), share.alias("local_weight"),
                    F.coalesce(F.col(f"_c_{k}"), lit(0)).alias("criterion_weight"),
                )
            )
    rows = out.select(*by, F.inline(F.array(*cells)))
    return rows.withColumn("weight", F.col("local_weight") * F.col("criterion_weight"))


def weigh(df: DataFrame, columns: Sequence[str], method: str = "critic", by: Sequence[str] = ()) -> DataFrame:
    """Entry point by method name: ``critic``, ``adaptive`` or ``equal``."""
    if method == "critic":
        return unpivot_weights(critic_matrix(df, columns, by), by, columns)
    if method == "adaptive":
        return unpivot_weights(adaptive_weights(df, columns, by), by, columns)
    if method == "equal":
        share = F.array(
            *[F.struct(F.lit(c).alias("indicator"), lit(1 / len(columns)).alias("weight")) for c in columns]
        )
        return df.select(*by).distinct().select(*by, F.inline(share)) if by else df.limit(1).select(F.inline(share))
    raise ValueError(f"unknown weighting method {method!r}")
