"""Ranking methods on a decision matrix, for every group at once.

Each method is a program of :mod:`passes`: it names the column statistics it
needs and returns row expressions. ``x(c)`` is the value column (NULL outside
the matrix), ``w(c)`` its weight. A column that is NULL for a whole group adds
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwise.functions.guards import all_of, any_of, largest, lit, ratio, score_key, total
from panelwise.operators.critic import critic_matrix
from panelwise.operators.ordered import add_ranks
from panelwise.operators.passes import Program, Step, attach, run_programs
from panelwise.session import settle

Getter = Callable[[str], Column]


def in_matrix(columns: Sequence[str], x: Getter) -> Column:
    return any_of(x(c).isNotNull() for c in columns)


def column_ranges(columns: Sequence[str], x: Getter) -> dict[str, Column]:
    return {f"min_{c}": F.min(x(c)) for c in columns} | {f"max_{c}": F.max(x(c)) for c in columns}


def ranking_scale(columns: Sequence[str], x: Getter, cost: frozenset[str]) -> Program:
    """Min-max to [0, 1], cost columns inverted, 0.5 where the column is flat."""
    s = yield Step(stats=column_ranges(columns, x))
    out = {}
    for c in columns:
        low, high = s(f"min_{c}"), s(f"max_{c}")
        rng = high - low
        up = (high - x(c)) if c in cost else (x(c) - low)
        out[c] = F.when(x(c).isNotNull(), F.when(rng < 1e-12, lit(0.5)).otherwise(ratio(up, rng)))
    return out


def topsis(
    columns: Sequence[str], x: Getter, w: Getter, cost: frozenset[str] = frozenset(), normalization: str = "vector"
) -> Program:
    """Closeness to the ideal: d- / (d+ + d-)."""
    stats = column_ranges(columns, x)
    if normalization == "vector":
        stats |= {f"ss_{c}": F.sum(x(c) * x(c)) for c in columns}
    s = yield Step(stats=stats)

    def norm(c: str, value: Column) -> Column:
        if normalization == "vector":
            n = F.sqrt(s(f"ss_{c}"))
            return value / F.when(n == 0, lit(1)).otherwise(n)
        if normalization == "minmax":
            r = s(f"max_{c}") - s(f"min_{c}")
            return (value - s(f"min_{c}")) / F.when(r == 0, lit(1)).otherwise(r)
        if normalization == "max":
            m = s(f"max_{c}")
            return value / F.when(m == 0, lit(1)).otherwise(m)
        raise ValueError(f"unknown normalization {normalization!r}")

    placed = {}
    for c in columns:
        high, low = norm(c, s(f"max_{c}")) * w(c), norm(c, s(f"min_{c}")) * w(c)
        if normalization == "max":  # a negative maximum turns the order of a column around
            high, low = F.greatest(high, low), F.least(high, low)
        best, worst = (low, high) if c in cost else (high, low)
        placed |= {f"v_{c}": norm(c, x(c)) * w(c), f"best_{c}": best, f"worst_{c}": worst}
    p = yield Step(rows=placed)
    away = {
        end: F.sqrt(total(F.pow(p(f"v_{c}") - p(f"{ref}_{c}"), lit(2)) for c in columns))
        for end, ref in (("d_pos", "best"), ("d_neg", "worst"))
    }
    d = yield Step(rows=away)
    return {"d_pos": d("d_pos"), "d_neg": d("d_neg"), "score": closeness(d("d_pos"), d("d_neg"))}


def closeness(d_pos: Column, d_neg: Column) -> Column:
    both = d_pos + d_neg
    return F.when(both > 1e-14, ratio(d_neg, both)).otherwise(lit(0.5))


def vikor(
    columns: Sequence[str], x: Getter, w: Getter, cost: frozenset[str] = frozenset(), v: float = 0.5
) -> Program:
    """Group utility S, largest regret R, and their blend Q (lower is better)."""
    s = yield Step(stats=column_ranges(columns, x))
    regrets = []
    for c in columns:
        best, worst = (s(f"min_{c}"), s(f"max_{c}")) if c in cost else (s(f"max_{c}"), s(f"min_{c}"))
        span = best - worst
        regrets.append(w(c) * (best - x(c)) / F.when(F.abs(span) < 1e-10, lit(1e-10)).otherwise(span))
    inside = in_matrix(columns, x)
    rows = {
        "S": F.when(inside, total(regrets)),
        "R": F.when(inside, largest([lit(0), *regrets])),
    }
    t = yield Step(
        rows=rows,
        stats={
            f"{end}_{name}": (lambda look, f=f, name=name: f(look(name)))
            for name in ("S", "R")
            for end, f in (("min", F.min), ("max", F.max))
        },
    )

    def spread(name: str) -> Column:
        gap = t(f"max_{name}") - t(f"min_{name}")
        return (t(name) - t(f"min_{name}")) / F.when(gap == 0, lit(1e-10)).otherwise(gap)

    return {"S": t("S"), "R": t("R"), "Q": v * spread("S") + (1 - v) * spread("R")}


def copras(columns: Sequence[str], x: Getter, w: Getter, cost: frozenset[str] = frozenset()) -> Program:
    """Relative significance Q and utility degree (percent of the best)."""
    s = yield Step(
        stats={f"sum_{c}": F.sum(x(c)) for c in columns} | {f"n_{c}": F.count(x(c)) for c in columns}
    )

    def share(c: str) -> Column:
        t = F.abs(s(f"sum_{c}"))
        flat = F.when(x(c).isNotNull(), ratio(lit(1), s(f"n_{c}")))
        return F.when(t > 0, ratio(x(c), t)).otherwise(flat) * w(c)

    inside = in_matrix(columns, x)
    gain = [c for c in columns if c not in cost]
    pay = [c for c in columns if c in cost]
    plus = F.when(inside, total(share(c) for c in gain) if gain else lit(0))
    minus = F.when(inside, total(share(c) for c in pay) if pay else lit(0))
    if pay:
        safe = F.when(minus == 0, lit(1e-10)).otherwise(minus)
        p = yield Step(
            rows={"S_plus": plus, "S_minus": minus, "safe": safe},
            stats={
                "sum_minus": lambda look: F.sum(look("S_minus")),
                "sum_inverse": lambda look: F.sum(1 / look("safe")),
            },
        )
        q = F.when(
            p("sum_minus") > 0, p("S_plus") + ratio(p("sum_minus"), p("safe") * p("sum_inverse"))
        ).otherwise(p("S_plus"))
    else:
        q = plus
    u = yield Step(
        rows={"Q": q} | ({} if pay else {"S_plus": plus, "S_minus": minus}),
        stats={"max_Q": lambda look: F.max(look("Q"))},
    )
    degree = F.when(u("max_Q") > 0, ratio(u("Q"), u("max_Q")) * 100).otherwise(lit(0))
    return {
        "S_plus": u("S_plus"),
        "S_minus": u("S_minus"),
        "Q": u("Q"),
        "utility": F.when(u("Q").isNotNull(), degree),
    }


def edas(
    columns: Sequence[str],
    x: Getter,
    w: Getter,
    cost: frozenset[str] = frozenset(),
    centre: Mapping[str, Column] | None = None,
) -> Program:
    """Distances above and below the average solution, appraisal score AS.

    ``centre`` replaces the plain mean (trimmed-mean variant)."""
    if centre is None:
        s = yield Step(stats={f"avg_{c}": F.avg(x(c)) for c in columns})
        centre = {c: s(f"avg_{c}") for c in columns}
    above, below = [], []
    for c in columns:
        av = centre[c]
        scale = F.greatest(F.abs(av), lit(1e-10))
        up, down = x(c) - av, av - x(c)
        if c in cost:
            up, down = down, up
        above.append(F.when(x(c).isNotNull(), w(c) * F.greatest(up, lit(0)) / scale))
        below.append(F.when(x(c).isNotNull(), w(c) * F.greatest(down, lit(0)) / scale))
    inside = in_matrix(columns, x)
    t = yield Step(
        rows={"SP": F.when(inside, total(above)), "SN": F.when(inside, total(below))},
        stats={f"max_{n}": (lambda look, n=n: F.max(look(n))) for n in ("SP", "SN")},
    )
    nsp = F.when(t("max_SP") > 0, ratio(t("SP"), t("max_SP"))).otherwise(lit(0))
    nsn = F.when(t("max_SN") > 0, 1 - ratio(t("SN"), t("max_SN"))).otherwise(lit(1))
    return {"SP": t("SP"), "SN": t("SN"), "AS": F.when(t("SP").isNotNull(), (nsp + nsn) / 2)}


def saw(
    columns: Sequence[str], x: Getter, w: Getter, cost: frozenset[str] = frozenset(), normalization: str = "minmax"
) -> Program:
    """Simple additive weighting after min-max, max or sum scaling."""
    stats = column_ranges(columns, x) | {f"sum_{c}": F.sum(x(c)) for c in columns}
    stats |= {f"inv_{c}": F.sum(1 / F.greatest(x(c), lit(1e-10))) for c in columns if c in cost}
    s = yield Step(stats=stats)

    def norm(c: str) -> Column:
        low, high = s(f"min_{c}"), s(f"max_{c}")
        if normalization == "minmax":
            rng = high - low
            return ((high - x(c)) if c in cost else (x(c) - low)) / F.when(rng == 0, lit(1)).otherwise(rng)
        if normalization == "max":
            if c in cost:
                from_zero = F.when(high > 0, ratio(high - x(c), high)).otherwise(lit(0))
                return F.when(low > 0, ratio(low, x(c))).otherwise(from_zero)
            return x(c) / F.when(high == 0, lit(1)).otherwise(high)
        if normalization == "sum":
            if c in cost:
                return ratio(1 / F.greatest(x(c), lit(1e-10)), s(f"inv_{c}"))
            t = s(f"sum_{c}")
            return x(c) / F.when(t == 0, lit(1)).otherwise(t)
        raise ValueError(f"unknown normalization {normalization!r}")

    return {"score": F.when(in_matrix(columns, x), total(w(c) * norm(c) for c in columns))}


def base(columns: Sequence[str], x: Getter) -> Column:
    """Plain sum of the raw values."""
    return F.when(in_matrix(columns, x), total(x(c) for c in columns))


def unit_scale(score: Column, higher_is_better: bool = True) -> Program:
    """Scores to [0, 1], 1 best; 0.5 where the group is flat."""
    s = yield Step(rows={"raw": score}, stats={"min": lambda k: F.min(k("raw")), "max": lambda k: F.max(k("raw"))})
    rng = s("max") - s("min")
    up = (s("raw") - s("min")) if higher_is_better else (s("max") - s("raw"))
    return {"score": F.when(s("raw").isNotNull(), F.when(rng < 1e-12, lit(0.5)).otherwise(ratio(up, rng)))}


METHODS = {"topsis": topsis, "vikor": vikor, "copras": copras, "edas": edas, "saw": saw}
# order column of each method, and whether higher is better
ORDER = {
    "topsis": ("score", True),
    "vikor": ("Q", False),
    "copras": ("Q", True),
    "edas": ("AS", True),
    "saw": ("score", True),
}


def place_weights(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], weights: Mapping[str, float] | DataFrame | None
) -> tuple[DataFrame, Getter]:
    """Weights as literals, as a table ``(by.., weight_<column>)``, or (default)
    CRITIC of the matrix itself. A column without a weight gets 1/p."""
    if isinstance(weights, Mapping):
        return df, lambda c: lit(weights.get(c, 1 / len(columns)))
    if weights is None:
        weights = settle(
            critic_matrix(df, columns, by).select(*by, *[f"weight_{c}" for c in columns])
            if by
            else critic_matrix(df.withColumn("_m", F.lit(0)), columns, ["_m"]).select(*[f"weight_{c}" for c in columns])
        )
    if not by:
        weights, df = weights.withColumn("_m", F.lit(0)), df.withColumn("_m", F.lit(0))
    given = set(weights.columns)
    keep = [f"weight_{c}" for c in columns if f"weight_{c}" in given]
    df = attach(df, weights.select(*(by or ["_m"]), *keep), by or ["_m"])
    return df, lambda c: F.coalesce(F.col(f"weight_{c}"), lit(1 / len(columns))) if f"weight_{c}" in given else lit(1 / len(columns))


def rank_matrix(
    df: DataFrame,
    method: str,
    columns: Sequence[str],
    by: Sequence[str] = (),
    weights: Mapping[str, float] | DataFrame | None = None,
    cost: frozenset[str] = frozenset(),
    **options,
) -> DataFrame:
    """One method on the complete rows of ``df``; adds its result columns and ``rank``."""
    by = list(by)
    kept = df.where(all_of(F.col(c).isNotNull() for c in columns))
    ids = list(kept.columns)
    placed, w = place_weights(kept, columns, by, weights)
    out, results = run_programs(placed, by, {method: METHODS[method](columns, F.col, w, cost, **options)})
    cols = results[method]
    order, higher = ORDER[method]
    scored = out.select(*ids, *[c.alias(n) for n, c in cols.items()]).withColumn("_key", score_key(F.col(order)))
    grouped = scored if by else scored.withColumn("_all", F.lit(0))
    ranks = {"rank": ("_key", higher, "truncated")}
    if method == "vikor":
        grouped = grouped.withColumns({"_s": score_key(F.col("S")), "_r": score_key(F.col("R"))})
        ranks |= {"rank_S": ("_s", False, "truncated"), "rank_R": ("_r", False, "truncated")}
    return add_ranks(grouped, by or ["_all"], ranks).drop("_key", "_all", "_s", "_r")


def trimmed_centre(df: DataFrame, columns: Sequence[str], by: Sequence[str], trim: float = 0.1) -> DataFrame:
    """``(by.., centre_<column>)``: mean without the int(trim * n) lowest and highest values
    of each column, from running counts of distinct values."""
    from panelwise.operators.ordered import running_sums, value_counts
    from panelwise.panel import to_long

    by = list(by)
    rows = df.where(all_of(F.col(c).isNotNull() for c in columns))
    long = to_long(rows, columns, ids=by)
    key = [*by, "indicator"]
    counts = settle(value_counts(long, key, "value"))
    sizes = settle(counts.groupBy(*key).agg(F.sum("_n").alias("_all")))
    run = running_sums(counts, key, "value", {"_upto": F.col("_n")}).join(sizes, key)
    cut = F.floor(F.col("_all") * F.lit(trim) + lit(1e-9))
    # how many copies of this value lie between position cut and n - cut
    kept = F.greatest(
        F.least(F.col("_upto"), F.col("_all") - cut) - F.greatest(F.col("_upto") - F.col("_n"), cut), F.lit(0)
    )
    means = run.groupBy(*by).agg(
        *[
            ratio(
                F.sum(F.when(F.col("indicator") == c, kept * F.col("value"))),
                F.sum(F.when(F.col("indicator") == c, kept)).cast("double"),
            ).alias(f"centre_{c}")
            for c in columns
        ]
    )
    return settle(means)


def edas_trimmed(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str],
    weights: Mapping[str, float] | DataFrame | None = None,
    cost: frozenset[str] = frozenset(),
    trim: float = 0.1,
) -> DataFrame:
    """EDAS around the trimmed mean; adds SP, SN, AS and ``rank``."""
    by = list(by)
    kept = df.where(all_of(F.col(c).isNotNull() for c in columns))
    placed, w = place_weights(attach(kept, trimmed_centre(kept, columns, by, trim), by), columns, by, weights)
    centre = {c: F.col(f"centre_{c}") for c in columns}
    out, found = run_programs(placed, by, {"edas": edas(columns, F.col, w, cost, centre)})
    scored = out.select(*kept.columns, *[c.alias(n) for n, c in found["edas"].items()])
    keyed = scored.withColumn("_key", score_key(F.col("AS")))
    return add_ranks(keyed, by, {"rank": ("_key", True, "truncated")}).drop("_key")
