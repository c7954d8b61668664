"""Diagnosis of missing values, and imputation of panels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.guards import all_of, lit, present, ratio, total
from panelwise.functions.noise import normal
from panelwise.functions.special import chi2_tail
from panelwise.operators.neighbours import nearest_entities
from panelwise.operators.linear import covariance, moment_rows, solve_ridge
from panelwise.operators.ordered import group_quantiles
from panelwise.operators.passes import with_stats
from panelwise.operators.patterns import PatternRows
from panelwise.panel import ENTITY, PERIOD, to_long
from panelwise.session import settle

# -------------------------------------------------------------- simple fills


def fill_with_means(df: DataFrame, columns: Sequence[str], fallback: dict[str, float] | None = None, mask: bool = False) -> DataFrame:
    """Missing cells get the given values, else the column mean, else 0. ``mask`` adds
    ``<column>_missing``."""
    out = with_stats(df, [], {f"_avg_{c}": F.avg(c) for c in columns})
    cells: dict[str, Column] = {}
    for c in columns:
        given = lit(fallback[c]) if fallback and c in fallback else F.lit(None).cast("double")
        cells[c] = F.coalesce(F.col(c), given, F.col(f"_avg_{c}"), lit(0))
        if mask:
            cells[f"{c}_missing"] = F.col(c).isNull().cast("long")
    names = [*df.columns, *[n for n in cells if n not in df.columns]]
    return out.withColumns(cells).select(*names)


def fill_with_means_so_far(df: DataFrame, columns: Sequence[str], level: dict[str, str] | None = None) -> DataFrame:
    """Missing cells get the column's mean over all rows up to their own period; if there is none, that of the
    column named in ``level``; else 0. The means are one row for each period."""
    per = settle(df.groupBy(PERIOD).agg(*[F.sum(c).alias(f"_s_{c}") for c in columns], *[F.count(c).alias(f"_n_{c}") for c in columns]))
    w = Window.partitionBy(F.lit(0)).orderBy(PERIOD).rowsBetween(Window.unboundedPreceding, 0)
    means = settle(per.select(PERIOD, *[F.try_divide(F.sum(f"_s_{c}").over(w), F.sum(f"_n_{c}").over(w)).alias(f"_avg_{c}") for c in columns]))
    cells = {c: F.coalesce(F.col(c), F.col(f"_avg_{c}"), F.col(f"_avg_{(level or {}).get(c, c)}"), lit(0)) for c in columns}
    return df.join(means, PERIOD).withColumns(cells).select(*df.columns)


def missing_indicators(df: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """0/1 flags, only for columns that have a gap somewhere."""
    gaps = df.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in columns]).first().asDict()
    return df.select(*ids, *[F.col(c).isNull().cast("long").alias(f"{c}_missing") for c in columns if gaps[c]])


def fallback_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.coalesce(F.avg(c), lit(0)).alias(c) for c in columns])


# ------------------------------------------------------------------ mechanism


def pattern(columns: Sequence[str]) -> Column:
    """Which columns are missing, as text of 0 and 1."""
    return F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])


def little_statistic(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``(chi2, df, n_patterns)``: group means by missing pattern against the
    overall means, over the mean variance. One aggregation to a row per pattern."""
    columns = list(columns)
    rows = df.withColumn("_pattern", pattern(columns))
    groups = rows.groupBy("_pattern").agg(
        *[F.count(c).alias(f"_n_{c}") for c in columns], *[F.avg(c).alias(f"_m_{c}") for c in columns]
    )
    whole = rows.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.var_pop(c).alias(f"_v_{c}") for c in columns])
    both = groups.withColumn("_k", F.lit(1)).join(settle(whole.withColumn("_k", F.lit(1))), "_k")
    seen = {c: F.count(f"_m_{c}") for c in columns}
    stat = total(
        F.when(seen[c] >= 2, F.sum(F.col(f"_n_{c}") * F.pow(F.col(f"_m_{c}") - F.col(f"_a_{c}"), lit(2)))) for c in columns
    )
    degrees = total(F.when(seen[c] >= 2, (seen[c] - 1).cast("double")) for c in columns)
    variance = ratio(
        total(F.first(f"_v_{c}") for c in columns), total(F.count(f"_a_{c}").cast("boolean").cast("double") for c in columns)
    )
    return both.agg(
        F.when(variance > 1e-12, ratio(stat, variance)).otherwise(stat).alias("chi2"),
        degrees.cast("long").alias("df"),
        F.count(F.lit(1)).alias("n_patterns"),
    )


def little_test(df: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> dict:
    row = little_statistic(df, columns).first()
    if row["n_patterns"] <= 1 or not row["df"]:
        return {"chi2": 0.0, "df": 0, "p": 1.0, "mcar": True}
    p = chi2_tail(row["chi2"], row["df"])
    return {"chi2": row["chi2"], "df": row["df"], "p": p, "mcar": p >= alpha}


def selection_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(indicator, shift)``: |mean over complete rows - mean over present values| / sd.
    The largest one is the suspicion of values missing because of their size."""
    full = all_of(F.col(c).isNotNull() for c in columns)
    row = df.agg(
        *[F.avg(F.when(full, F.col(c))).alias(f"_c_{c}") for c in columns],
        *[F.avg(c).alias(f"_a_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("indicator"),
                F.when(
                    F.col(f"_s_{c}") > 1e-12, ratio(F.abs(F.col(f"_c_{c}") - F.col(f"_a_{c}")), F.col(f"_s_{c}"))
                ).alias("shift"),
            )
            for c in columns
        ]
    )
    return row.select(F.inline(cells))


def flag_regressions(df: DataFrame, columns: Sequence[str], minimum: int = 30, cut: float = 0.1) -> DataFrame:
    """``(indicator, r2, predictors, left_out, reason)``: logistic regression of each missing flag on the
    other columns, McFadden R2 and predictors with a standardised coefficient above ``cut``.

    Rows must be complete in the predictors, so those missing in half of the rows or more are left out and named. A flag with
    fewer than ``minimum`` such rows, or with one outcome only, is not fitted: its R2 is null and ``reason`` says why."""
    spark = df.sparkSession
    out = []
    for target in columns:
        others = [c for c in columns if c != target]
        gaps = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in others]).first().asDict()
        # a predictor that is itself missing in half of the rows would leave no rows
        used = [c for c in others if gaps[c] is not None and gaps[c] < 0.5]
        rows = df.where(all_of(F.col(c).isNotNull() for c in used)).select(
            *used, F.col(target).isNull().cast("double").alias("label")
        )
        shape = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("p")).first()
        left_out = ",".join(c for c in others if c not in used)
        if shape["n"] < minimum or not 0 < (shape["p"] or 0) < 1:
            out.append((target, None, None, left_out, "few rows" if shape["n"] < minimum else "one outcome"))
            continue
        data = settle(with_stats(rows, [], {f"_m_{c}": F.avg(c) for c in used} | {f"_s_{c}": F.stddev_pop(c) for c in used}).select(
            "label", *[F.coalesce(ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), lit(0)).alias(c) for c in used]
        ))
        vectors = VectorAssembler(inputCols=used, outputCol="features").transform(data)
        model = LogisticRegression(maxIter=100, regParam=0.01).fit(vectors)
        p1 = F.least(F.greatest(vector_to_array("probability")[1], lit(1e-12)), lit(1 - 1e-12))
        loss = model.transform(vectors).agg(
            F.sum(F.when(F.col("label") == 1, F.log(p1)).otherwise(F.log(1 - p1))).alias("ll")
        ).first()["ll"]
        p = shape["p"]
        null = shape["n"] * (p * np.log(p) + (1 - p) * np.log(1 - p))
        named = [c for c, b in zip(used, model.coefficients.toArray()) if abs(b) > cut]
        out.append((target, float(max(0.0, 1 - loss / null)), ",".join(named), left_out, None))
    return spark.createDataFrame(out, "indicator string, r2 double, predictors string, left_out string, reason string")


def mechanism(df: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """One row: p of the MCAR test, mean McFadden R2, selection index, verdict."""
    spark = df.sparkSession
    df = settle(df.select(*columns))
    cells = df.agg(
        (F.sum(total(F.col(c).isNull().cast("double") for c in columns)) / (F.count(F.lit(1)) * len(columns))).alias("rate"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not cells["rate"]:
        line = (1.0, 0.0, 0.0, "MCAR", cells["n"], 0.0)
    else:
        test = little_test(df, columns, alpha)
        r2 = flag_regressions(df, columns).agg(F.coalesce(F.avg("r2"), lit(0))).first()[0]
        shift = selection_index(df, columns).agg(F.coalesce(F.max("shift"), lit(0))).first()[0]
        if test["mcar"] and r2 < 0.1:
            verdict = "MCAR"
        elif r2 >= 0.1:
            verdict = "MAR"
        else:
            verdict = "MNAR_suspected" if shift > 0.5 else "MAR"
        line = (float(test["p"]), float(r2), float(shift), verdict, cells["n"], float(cells["rate"]))
    return spark.createDataFrame(
        [line], "p_mcar double, r2 double, selection double, verdict string, n_rows long, missing_rate double"
    )


# ----------------------------------------------------------------- imputation


def interpolate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Linear in time per entity, nearest value at both ends. Positions count the
    entity's rows; the window is one entity's periods."""
    w = Window.partitionBy(ENTITY).orderBy(PERIOD)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = df.withColumn("_i", F.row_number().over(w).cast("double"))
    out = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("_i"))
        x0, i0 = F.last(c, True).over(before), F.last(at, True).over(before)
        x1, i1 = F.first(c, True).over(after), F.first(at, True).over(after)
        line = x0 + (x1 - x0) * ratio(F.col("_i") - i0, i1 - i0)
        out[c] = F.coalesce(F.col(c), line, x0, x1)
    return rows.withColumns(out).drop("_i")


@dataclass
class Chain:
    """Chained equations that have come to rest: pattern maps, the fits of the last round and the last change."""

    rows: PatternRows
    scaled: DataFrame
    scale: dict[str, tuple[float, float]]
    gaps: list[str]
    fits: dict[str, tuple[float, np.ndarray, float]]
    penalty: float
    change: float

    def weights(self, fits: dict[str, tuple[float, np.ndarray, float]]) -> np.ndarray:
        """A column for each column of the panel: intercept and slopes of its fit (nothing for one without gaps)."""
        used = self.rows.columns
        out = np.zeros((len(used) + 1, len(used)))
        for c, (intercept, beta, _) in fits.items():
            y = used.index(c)
            out[0, y] = intercept
            out[[i + 1 for i in range(len(used)) if i != y], y] = beta
        return out

    def unscaled(self, df: DataFrame, order: Sequence[str]) -> DataFrame:
        back = {c: (F.col(c) * s + m).alias(c) for c, (m, s) in self.scale.items()}
        return df.select(*[back.get(c, F.col(c)) for c in order])


def fit_chain(
    df: DataFrame, columns: Sequence[str], rounds: int = 10, penalty: float = 1e-3, tolerance: float = 1e-4, numbers: int | None = None,
) -> Chain | None:
    """The rounds of :func:`chained_equations`, or None if nothing can be filled.

    Rows are read for the column statistics and once for the sums of products of each pattern of gaps; rounds work on those."""
    columns = list(columns)
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
                   *[F.count(c).alias(f"n_{c}") for c in columns], F.count(F.lit(1)).alias("n")).first()
    used = [c for c in columns if stats[f"n_{c}"]]
    gaps = [c for c in used if stats[f"n_{c}"] < stats["n"]]
    if not gaps:
        return None
    scale = {c: (stats[f"m_{c}"], stats[f"s_{c}"] or 1.0) for c in used}
    long = to_long(df.select(*used), used, keep_missing=False, ids=())
    middle = {r["indicator"]: r["q"] for r in group_quantiles(settle(long), ["indicator"], "value", {"q": 0.5}).collect()}
    z = {c: ((F.col(c) - m) / lit(s)).alias(c) for c, (m, s) in scale.items()}
    scaled = df.select(*[z.get(c, F.col(c)) for c in df.columns])
    rows = PatternRows(scaled, used, [(middle[c] - scale[c][0]) / scale[c][1] for c in used], numbers=numbers)
    chain = Chain(rows, scaled, scale, gaps, {}, penalty, 0.0)
    turns = sorted(gaps, key=lambda c: (-stats[f"n_{c}"], used.index(c)))  # fewest gaps first
    for _ in range(rounds):
        moved = 0.0
        for c in turns:
            chain.fits[c] = _ridge_fit(rows.totals[used.index(c)], used.index(c), penalty)
            moved += max(rows.advance(chain.weights({c: chain.fits[c]}), used.index(c)), 0.0)
        chain.change = float(np.sqrt(moved / (stats["n"] * len(gaps))))
        if chain.change < tolerance:
            break
    return chain


def _ridge_fit(m: np.ndarray, y: int, penalty: float) -> tuple[float, np.ndarray, float]:
    """Intercept, slopes on all other columns and residual variance of column ``y``."""
    x = [i for i in range(len(m) - 1) if i != y]
    intercept, beta = solve_ridge(m, x, y, penalty)
    _, cov, _ = covariance(m)
    resid = cov[y, y] - 2 * beta @ cov[x, y] + beta @ cov[np.ix_(x, x)] @ beta
    return intercept, beta, max(float(resid), 0.0)


def chained_equations(
    df: DataFrame, columns: Sequence[str], rounds: int = 10, penalty: float = 1e-3, tolerance: float = 1e-4,
    change_as: str | None = None, numbers: int | None = None,
) -> DataFrame:
    """Every column with gaps in turn, that with the fewest first, is regressed on all others as they stand, its gaps are
    replaced by the prediction, and this repeats until the changes are small.

    Start: column medians. Columns are standardised, fits are ridge regressions over the rows where the column is
    present. All rounds run on sums of products by pattern of gaps (:class:`PatternRows`); rows are read for those and
    once more to be filled. A column without any value stays missing. ``change_as`` names a column with the last round's
    change (0 without gaps), which is under ``tolerance`` unless the rounds ran out."""
    chain = fit_chain(df, columns, rounds, penalty, tolerance, numbers)
    if chain is None:
        return with_change(df, change_as, 0.0)
    return with_change(chain.unscaled(chain.rows.filled(chain.scaled), df.columns), change_as, chain.change)


def with_change(df: DataFrame, name: str | None, change: float) -> DataFrame:
    return df if name is None else df.withColumn(name, F.lit(float(change)))


def impute_panel(df: DataFrame, columns: Sequence[str], rounds: int = 10, change_as: str | None = None, k: int = 5) -> DataFrame:
    """Interpolation in time per entity, then the ``k`` nearest entities of the period, then chained equations for what is left."""
    return chained_equations(settle(nearest_entities(settle(interpolate(df, columns)), columns, k)), columns, rounds, change_as=change_as)


def soft_impute(
    df: DataFrame, columns: Sequence[str], shrink: float = 0.5, rounds: int = 30, tolerance: float = 1e-4, change_as: str | None = None, numbers: int | None = None,
) -> DataFrame:
    """Low-rank completion per period: singular values of the scaled matrix are reduced by
    ``shrink`` times the largest, observed cells are kept.

    Z V f(S) V' needs only the p x p matrix Z'Z of each period. All rounds run on sums of products by period and pattern
    of gaps (:class:`PatternRows`); rows are read for those and once more to be filled."""
    columns = list(columns)
    stats = {f"_m_{c}": F.avg(c) for c in columns} | {f"_s_{c}": F.stddev_pop(c) for c in columns}
    sd = {c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(lit(1)) for c in columns}
    scaled = settle(with_stats(df, [], stats).withColumns({c: ratio(F.col(c) - F.col(f"_m_{c}"), sd[c]) for c in columns}))
    rows = PatternRows(scaled, columns, [0.0] * len(columns), group=PERIOD, by_cell=False, numbers=numbers)
    n, change = max(sum(m[0, 0] for m in rows.totals.values()), 1.0), 0.0
    for _ in range(rounds):
        change = float(np.sqrt(max(rows.advance({k: _projection(m, shrink) for k, m in rows.totals.items()}), 0.0) / n))
        if change < tolerance:
            break
    back = {c: F.col(c) * sd[c] + F.col(f"_m_{c}") for c in columns}
    return with_change(rows.filled(scaled).withColumns(back).select(*df.columns), change_as, change)


def _projection(m: np.ndarray, shrink: float) -> np.ndarray:
    """Weights of (1, cells) for the cells on the shrunken singular vectors."""
    values, vectors = np.linalg.eigh(m[1:, 1:])
    s = np.sqrt(np.maximum(values, 0.0))
    keep = np.maximum(s - shrink * s.max(), 0.0) / np.where(s > 0, s, 1.0)
    return np.vstack([np.zeros(len(s)), vectors @ np.diag(keep) @ vectors.T])


def drift(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(indicator, ..)``: mean, sd and median before and after imputation, and their shift in sd."""
    parts = []
    for tag, df in (("before", before), ("after", after)):
        rows = settle(to_long(df, columns, keep_missing=False, ids=()).withColumn("value", F.round("value", 8)))
        m = rows.groupBy("indicator").agg(F.avg("value").alias(f"mean_{tag}"), F.stddev_pop("value").alias(f"sd_{tag}"))
        q = group_quantiles(rows, ["indicator"], "value", {f"median_{tag}": 0.5}).withColumnRenamed("n", f"n_{tag}")
        parts.append(m.join(q, "indicator"))
    both = parts[0].join(parts[1], "indicator")
    scale = F.col("sd_before")
    return both.withColumns(
        {
            "mean_shift": F.coalesce(ratio(F.abs(F.col("mean_after") - F.col("mean_before")), scale), lit(0)),
            "sd_ratio": ratio(F.col("sd_after"), scale),
        }
    )


def correlation_drift(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, r_before, r_after, change)`` on pairwise complete rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def one(df: DataFrame, name: str) -> DataFrame:
        aggs = []
        for a, b in pairs:
            x = F.when(F.col(b).isNotNull(), F.col(a))
            y = F.when(F.col(a).isNotNull(), F.col(b))
            aggs.append(ratio(F.covar_samp(a, b), F.stddev_samp(x) * F.stddev_samp(y)).alias(f"{a}|{b}"))
        row = df.agg(*aggs)
        cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias(name)) for a, b in pairs]
        return row.select(F.inline(F.array(*cells)))

    both = one(before, "r_before").join(one(after, "r_after"), ["a", "b"])
    return both.withColumn("change", F.abs(F.col("r_after") - F.col("r_before")))


def kept_cells_changed(before: DataFrame, after: DataFrame, columns: Sequence[str], keys: Sequence[str] = (ENTITY, PERIOD)) -> DataFrame:
    """Leakage check: observed cells that an imputation altered (must be none)."""
    a = to_long(before, columns, keep_missing=False, ids=keys)
    b = to_long(after, columns, ids=keys).withColumnRenamed("value", "new")
    return a.join(b, [*keys, "indicator"]).where(~F.col("value").eqNullSafe(F.col("new")) & (F.abs(F.col("value") - F.col("new")) > 1e-9 * F.greatest(F.abs("value"), lit(1))))


def completeness(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells by period and indicator, before and after."""
    def count(df: DataFrame, name: str) -> DataFrame:
        wide = df.groupBy(PERIOD).agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in columns])
        return wide.unpivot([PERIOD], list(columns), "indicator", name)

    return count(before, "missing_before").join(count(after, "missing_after"), [PERIOD, "indicator"])


def drawn_fit(m: np.ndarray, y: int, penalty: float, rng: np.random.Generator) -> tuple[float, np.ndarray, float]:
    """A draw of (intercept, slopes, residual variance) of column ``y`` on all others from their posterior: the variance
    from a scaled inverse chi-square, the coefficients from a normal about the ridge fit, by the Cholesky factor of the
    sums of products."""
    x = [i for i in range(len(m) - 1) if i != y]
    intercept, beta, resid = _ridge_fit(m, y, penalty)
    mean, cov, n = covariance(m)
    free = n - len(x) - 1
    if free <= 0:
        return intercept, beta, resid
    variance = resid * n / rng.chisquare(free)
    lower = np.linalg.cholesky(n * (cov[np.ix_(x, x)] + penalty * np.eye(len(x))))
    slopes = beta + np.sqrt(variance) * np.linalg.solve(lower.T, rng.standard_normal(len(x)))
    centre = mean[y] + np.sqrt(variance / n) * rng.standard_normal()
    return float(centre - mean[x] @ slopes), slopes, float(variance)


def multiple_imputations(
    df: DataFrame, columns: Sequence[str], seeds: Sequence[int], rounds: int = 10, penalty: float = 1e-3, tolerance: float = 1e-4,
    change_as: str | None = None, numbers: int | None = None,
) -> DataFrame:
    """Proper multiple imputations stacked under an ``imputation`` column.

    The chained equations run once. For each seed, coefficients and residual variances are drawn from their posterior given
    the chain's last sums (:func:`drawn_fit`), a round with them gives the mean of each gap, and a normal draw with the
    drawn variance is added, by the MD5 of seed, column and the row's other columns. Observed cells are kept."""
    chain = fit_chain(df, columns, rounds, penalty, tolerance, numbers)
    if chain is None:
        copies = F.explode(F.array(*[F.lit(i) for i in range(len(seeds))])).alias("imputation")
        return with_change(df, change_as, 0.0).select("*", copies)
    used, others = chain.rows.columns, [c for c in df.columns if c not in columns]
    out = None
    for i, seed in enumerate(seeds):
        drawn = {c: drawn_fit(chain.rows.totals[used.index(c)], used.index(c), penalty, np.random.default_rng([seed, used.index(c)])) for c in chain.gaps}
        flagged = chain.scaled.withColumns({f"_gap_{c}": F.col(c).isNull() for c in chain.gaps})
        rows = chain.rows.filled(flagged, chain.rows.maps(chain.weights(drawn)))
        noise = {c: F.when(F.col(f"_gap_{c}"), F.col(c) + lit(drawn[c][2] ** 0.5) * normal(seed, F.lit(c), *[F.col(o) for o in others])).otherwise(F.col(c)) for c in chain.gaps}
        one = with_change(chain.unscaled(rows.withColumns(noise), df.columns), change_as, chain.change).withColumn("imputation", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def pooled_regression(stacked: DataFrame, target: str, predictors: Sequence[str], penalty: float = 0.0) -> DataFrame:
    """``(term, pooled, within, between, total, missing_information)``: a regression for each ``imputation`` from one pass
    over the rows, its coefficients and their variances pooled by Rubin's rules."""
    columns, spark = [*predictors, target], stacked.sparkSession
    found: dict[int, np.ndarray] = {}
    for r in moment_rows(stacked, columns, ["imputation"]).collect():  # a matrix for each imputation
        m = found.setdefault(r["imputation"], np.zeros((len(columns) + 1,) * 2))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    rows = []
    k = len(predictors) + 1
    for m in found.values():
        gram = m[:k, :k] + penalty * m[0, 0] * np.diag([0.0] + [1.0] * (k - 1))
        inverse = np.linalg.pinv(gram)
        beta = inverse @ m[:k, k]
        loss = m[k, k] - 2 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta
        variance = max(loss, 0.0) / max(m[0, 0] - k, 1.0) * np.diag(inverse)
        rows += [(name, float(b), float(v)) for name, b, v in zip(["(intercept)", *predictors], beta, variance, strict=True)]
    return pool(spark.createDataFrame(rows, "term string, estimate double, variance double"), ["term"])


def pool(estimates: DataFrame, group: Sequence[str], value: str = "estimate", variance: str = "variance") -> DataFrame:
    """Rubin's rules: pooled mean, within, between and total variance, share of
    information lost to gaps."""
    m = F.count(F.lit(1)).cast("double")
    agg = estimates.groupBy(*group).agg(
        F.avg(value).alias("pooled"),
        F.avg(variance).alias("within"),
        F.coalesce(F.var_samp(value), lit(0)).alias("between"),
        m.alias("_m"),
    )
    whole = F.col("within") + (1 + 1 / F.col("_m")) * F.col("between")
    return agg.select(
        *group,
        "pooled",
        "within",
        "between",
        whole.alias("total"),
        F.coalesce(ratio((1 + 1 / F.col("_m")) * F.col("between"), whole), lit(0)).alias("missing_information"),
    )


def present_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(present(F.col(c) for c in columns) > 0)


