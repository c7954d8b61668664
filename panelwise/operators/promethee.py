"""Outranking flows without comparing pairs.

The flow of a row is a sum of a preference function over all other rows. For
the piecewise linear functions that sum needs only how many values, and what
total, lie below x, x - q, x - p (and above x, x + q, x + p). These are running
counts and sums over the sorted distinct values with the shifted values mixed
in as probes: one sort, O(n log n), split into buckets for large groups. The
Gaussian function uses the series of exp(xy/s^2) around the middle of [0, 1],
so its flows are running sums of powers; below s = 0.1 of the range, where that
series grows, the sums are taken by cells (``narrow_bells``).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelwise.functions.guards import lit, score_key
from panelwise.operators.narrow_bells import narrow_flows
from panelwise.operators.ordered import add_ranks, running_sums
from panelwise.session import settle


#: Below this sigma the series has too many terms.
NARROW = 0.1
#: Values lie on a grid of 1e-11; the bell of a sigma up to this is zero between any two of them.
NO_BELL = 1e-12


@dataclass(frozen=True)
class Preference:
    """Preference function and thresholds, in units of the scaled [0, 1] range."""

    kind: str = "vshape"
    p: float = 0.3
    q: float = 0.1
    sigma: float = 0.2


def _grid(x: Column) -> Column:
    """Scaled values on a 1e-11 grid, so that a difference equal to a threshold is
    equal in every engine and not decided by the last bit."""
    return F.round(x, 11)


def _shifts(pref: Preference) -> list[float]:
    return {
        "usual": [0.0],
        "ushape": [pref.q],
        "vshape": [0.0, pref.p],
        "level": [pref.q, pref.p],
        "vshape_i": [pref.q, pref.p] if pref.p > pref.q else [pref.q],
        "gaussian": [0.0],
    }[pref.kind]


def _terms(sigma: float) -> int:
    """Series terms until the remainder is below 1e-15 of the leading factor."""
    z, k, term = 0.25 / sigma**2, 0, 1.0
    while k < z or term > 1e-15:
        k += 1
        term *= z / k
    return k


def _flow(pref: Preference, side: str, x: Column, at: dict[float, dict[str, Column]], n: Column) -> Column:
    """Sum of preferences over the rows on one side of x.

    ``at[shift]`` holds count and sum of the values up to and including
    x -/+ shift (``upto``) and strictly below it (``below``)."""
    up = side == "plus"

    def beyond(shift: float) -> Column:
        """Rows whose distance is more than ``shift``."""
        return at[shift]["below_n"] if up else n - at[shift]["upto_n"]

    def ramp(lo: float, hi: float) -> Column:
        """Sum of (d - lo) over rows with lo < d <= hi."""
        if up:
            count = at[lo]["below_n"] - at[hi]["below_n"]
            value = at[lo]["below_s"] - at[hi]["below_s"]
            return (x - lo) * count - value
        count = at[hi]["upto_n"] - at[lo]["upto_n"]
        value = at[hi]["upto_s"] - at[lo]["upto_s"]
        return value - (x + lo) * count

    if pref.kind == "usual":
        return beyond(0.0).cast("double")
    if pref.kind == "ushape":
        return beyond(pref.q).cast("double")
    if pref.kind == "vshape":
        return beyond(pref.p) + ramp(0.0, pref.p) / lit(pref.p)
    if pref.kind == "level":
        return 0.5 * beyond(pref.q) + 0.5 * beyond(pref.p)
    if pref.kind == "vshape_i":
        if pref.p <= pref.q:
            return beyond(pref.q).cast("double")
        return beyond(pref.p) + ramp(pref.q, pref.p) / lit(pref.p - pref.q)
    raise ValueError(f"unknown preference function {pref.kind!r}")


def value_flows(
    values: DataFrame, group: Sequence[str], pref: Preference, limit: int | None = None
) -> DataFrame:
    """``(group.., x, plus, minus, rows)`` for every distinct x: summed preferences over
    the others, and against x, and the rows of the group. ``values`` has ``group.., x``."""
    group = list(group)
    if pref.kind == "gaussian" and pref.sigma <= NO_BELL:
        pref = Preference("usual")
    counts = settle(values.groupBy(*group, "x").agg(F.count(F.lit(1)).alias("n")))
    sizes = settle(counts.groupBy(*group).agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_values")))
    distinct = sizes.agg(F.max("_values")).first()[0] or 0
    if pref.kind == "gaussian" and pref.sigma < NARROW:
        return narrow_flows(counts, sizes, group, pref.sigma, limit, distinct)
    if pref.kind == "gaussian":
        return _gaussian_flows(counts, sizes, group, pref, limit, distinct)
    shifts = _shifts(pref)
    names: dict[tuple[str, float], str] = {}
    points = []
    for i, s in enumerate(shifts):
        for side, at in (("plus", _grid(F.col("x") - s)), ("minus", _grid(F.col("x") + s))):
            names[(side, s)] = f"{side}{i}"
            points.append(F.struct(at.alias("key"), F.lit(f"{side}{i}").alias("probe")))
    probe = counts.select(*group, "x", F.inline(F.array(*points)))
    data = counts.select(*group, F.col("x").alias("key"), "n", (F.col("x") * F.col("n")).alias("s"))
    asked = probe.select(*group, "key", F.lit(0).cast("long").alias("n"), lit(0).alias("s"))
    line = data.unionByName(asked).groupBy(*group, "key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = {"upto_n": F.col("n"), "upto_s": F.col("s")}
    run = running_sums(line, group, "key", sums, limit, distinct * (1 + len(points)))
    looked = probe.join(run, [*group, "key"]).groupBy(*group, "x").agg(
        *[
            F.max(F.when(F.col("probe") == name, F.col(c) - F.col(d) if d else F.col(c))).alias(f"{name}_{tag}")
            for name in names.values()
            for tag, c, d in (
                ("upto_n", "upto_n", None),
                ("upto_s", "upto_s", None),
                ("below_n", "upto_n", "n"),
                ("below_s", "upto_s", "s"),
            )
        ]
    )
    full = looked.join(sizes, group)
    sides = {}
    for side in ("plus", "minus"):
        at = {
            s: {tag: F.col(f"{names[(side, s)]}_{tag}") for tag in ("upto_n", "upto_s", "below_n", "below_s")}
            for s in shifts
        }
        sides[side] = _flow(pref, side, F.col("x"), at, F.col("_rows"))
    return full.select(*group, "x", sides["plus"].alias("plus"), sides["minus"].alias("minus"), F.col("_rows").alias("rows"))


def _gaussian_flows(counts: DataFrame, sizes: DataFrame, group: list[str], pref: Preference, limit: int | None, distinct: int) -> DataFrame:
    """1 - exp(-(x-y)^2 / 2s^2) summed over y < x and over y > x."""
    terms, var = _terms(pref.sigma), pref.sigma**2
    u = F.col("x") - 0.5
    bell = F.exp(-u * u / lit(2 * var))
    moments = {f"m{k}": F.col("n") * bell * F.pow(u, lit(k)) for k in range(terms)}
    line = counts.withColumns(moments)
    sums = {"c": F.col("n")} | {f"r{k}": F.col(f"m{k}") for k in range(terms)}
    run = running_sums(line, group, "x", sums, limit, distinct)
    whole = settle(line.groupBy(*group).agg(*[F.sum(f"m{k}").alias(f"t{k}") for k in range(terms)]))
    full = run.join(sizes, group).join(whole, group)

    def bells(moment) -> Column:
        out = lit(0)
        for k in range(terms):
            out = out + moment(k) * F.pow(u / lit(var), lit(k)) / lit(math.factorial(k))
        return bell * out

    plus = (F.col("c") - F.col("n")) - bells(lambda k: F.col(f"r{k}") - F.col(f"m{k}"))
    minus = (F.col("_rows") - F.col("c")) - bells(lambda k: F.col(f"t{k}") - F.col(f"r{k}"))
    return full.select(*group, "x", plus.alias("plus"), minus.alias("minus"), F.col("_rows").alias("rows"))


def flows(
    scaled: DataFrame,
    by: Sequence[str],
    entity: str,
    preferences: Mapping[str, Preference] | Preference = Preference(),
    limit: int | None = None,
) -> DataFrame:
    """Outranking flows. ``scaled`` is long: ``by.., entity, indicator, x, w`` with x in
    [0, 1]; it is read twice, so settle it first if it is costly.

    Returns ``(by.., entity, phi_plus, phi_minus, phi)``."""
    by = list(by)
    if not by:
        return flows(scaled.withColumn("_all", F.lit(0)), ["_all"], entity, preferences, limit).drop("_all")
    rows = scaled.where(F.col("x").isNotNull()).withColumn("x", _grid(F.col("x")))
    kinds: dict[Preference, list[str] | None] = {}
    if isinstance(preferences, Preference):
        kinds[preferences] = None
    else:
        for indicator, pref in preferences.items():
            kinds.setdefault(pref, []).append(indicator)
    parts = []
    for pref, indicators in kinds.items():
        some = rows if indicators is None else rows.where(F.col("indicator").isin(indicators))
        table = value_flows(some.select(*by, "indicator", "x"), [*by, "indicator"], pref, limit)
        parts.append(some.join(table, [*by, "indicator", "x"]))
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    per_entity = joined.groupBy(*by, entity).agg(
        F.sum(F.col("w") * F.col("plus")).alias("_plus"),
        F.sum(F.col("w") * F.col("minus")).alias("_minus"),
        F.max("rows").alias("_rows"),
    )
    others = F.when(F.col("_rows") > 1, F.col("_rows") - 1).otherwise(F.lit(1))
    return per_entity.select(
        *by,
        entity,
        (F.col("_plus") / others).alias("phi_plus"),
        (F.col("_minus") / others).alias("phi_minus"),
        ((F.col("_plus") - F.col("_minus")) / others).alias("phi"),
    )


def flow_ranks(flow_table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Net-flow rank (complete order) and the two ranks of the partial order."""
    keyed = flow_table.withColumns(
        {"_net": score_key(F.col("phi")), "_p": score_key(F.col("phi_plus")), "_m": score_key(F.col("phi_minus"))}
    )
    return add_ranks(
        keyed,
        by,
        {
            "rank": ("_net", True, "truncated"),
            "rank_plus": ("_p", True, "truncated"),
            "rank_minus": ("_m", False, "truncated"),
        },
    ).drop("_net", "_p", "_m")


def preference(pref: Preference, d: Column) -> Column:
    """The preference function itself, for one difference d."""
    if pref.kind == "usual":
        up = lit(1)
    elif pref.kind == "ushape":
        up = F.when(d > pref.q, lit(1)).otherwise(lit(0))
    elif pref.kind == "vshape":
        up = F.least(d / lit(pref.p), lit(1))
    elif pref.kind == "level":
        up = F.when(d > pref.p, lit(1)).when(d > pref.q, lit(0.5)).otherwise(lit(0))
    elif pref.kind == "vshape_i":
        if pref.p > pref.q:
            up = F.greatest(F.least((d - pref.q) / lit(pref.p - pref.q), lit(1)), lit(0))
        else:
            up = F.when(d > pref.q, lit(1)).otherwise(lit(0))
    elif pref.kind == "gaussian":
        up = 1 - F.exp(-d * d / lit(2 * pref.sigma**2)) if pref.sigma > 0 else lit(1)
    else:
        raise ValueError(f"unknown preference function {pref.kind!r}")
    return F.when(d > 0, up).otherwise(lit(0))


def preference_rows(
    scaled: DataFrame, focus: DataFrame, by: Sequence[str], entity: str, pref: Preference = Preference()
) -> DataFrame:
    """Rows of the preference matrix for the entities in ``focus`` (``by.., entity``,
    a few per group, such as a top-k): k x n rows, not n x n."""
    by = list(by)
    rows = settle(scaled.where(F.col("x").isNotNull()))
    mine = settle(rows.join(focus.select(*by, entity), [*by, entity], "left_semi"))
    a = mine.select(*by, "indicator", F.col(entity).alias("a"), F.col("x").alias("_xa"), "w")
    b = rows.select(*by, "indicator", F.col(entity).alias("b"), F.col("x").alias("_xb"))
    pairs = b.join(a, [*by, "indicator"]).where(F.col("a") != F.col("b"))
    return pairs.groupBy(*by, "a", "b").agg(
        F.sum(F.col("w") * preference(pref, F.col("_xa") - F.col("_xb"))).alias("preference"),
        F.sum(F.col("w") * preference(pref, F.col("_xb") - F.col("_xa"))).alias("against"),
    )


def outranking(flow_table: DataFrame, focus: DataFrame, by: Sequence[str], entity: str) -> DataFrame:
    """Relation of each focus entity to every other one in its group."""
    by = list(by)
    table = settle(flow_table.select(*by, entity, score_key(F.col("phi_plus")).alias("_p"), score_key(F.col("phi_minus")).alias("_m")))
    mine = settle(table.join(focus.select(*by, entity), [*by, entity], "left_semi"))
    a = mine.select(*by, F.col(entity).alias("a"), F.col("_p").alias("_pa"), F.col("_m").alias("_ma"))
    b = table.select(*by, F.col(entity).alias("b"), F.col("_p").alias("_pb"), F.col("_m").alias("_mb"))
    pairs = b.join(a, by).where(F.col("a") != F.col("b"))
    at_least = (F.col("_pa") >= F.col("_pb")) & (F.col("_ma") <= F.col("_mb"))
    at_most = (F.col("_pa") <= F.col("_pb")) & (F.col("_ma") >= F.col("_mb"))
    relation = (
        F.when(at_least & at_most, F.lit("indifferent"))
        .when(at_least, F.lit("outranks"))
        .when(at_most, F.lit("outranked"))
        .otherwise(F.lit("incomparable"))
    )
    return pairs.select(*by, "a", "b", relation.alias("relation"))
