"""Sums of narrow bells exp(-(x-y)^2 / 2s^2) over the values on either side of x.

Values fall into cells as wide as s. Values of the same cell meet through running sums of
powers around its middle. All values of another cell act through a Hermite expansion of
``TERMS`` sums, which is moved to the middle of the cell that asks: the distance of two cells
is a whole number of s, so the matrix that moves an expansion depends on that number alone.
Cells more than ``REACH`` apart add less than 3e-18 a pair and do not meet. Only cells are
joined with cells; a row reads the one expansion of its own cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelwise.functions.guards import lit
from panelwise.operators.ordered import running_sums
from panelwise.session import settle

#: Sums kept of a cell; what is left out stays below 1e-16 a pair.
TERMS = 24
#: Powers needed between values of one cell, at most s / 2 from its middle.
OWN_TERMS = 15
#: Cells to either side whose bells are not yet zero.
REACH = 9


def _hermite(t: float, n: int) -> np.ndarray:
    """h_0(t) .. h_{n-1}(t), the derivatives of exp(-t^2) with alternating sign."""
    h = np.zeros(n)
    h[0], h[1] = math.exp(-t * t), 2 * t * math.exp(-t * t)
    for k in range(1, n - 1):
        h[k + 1] = 2 * t * h[k] - 2 * k * h[k - 1]
    return h


def movers() -> dict[int, np.ndarray]:
    """For each distance in cells (positive: the asking cell lies above) the matrix from a cell's
    sums of v^k / k! to the coefficients of powers of the asking row's place."""
    out = {}
    for d in (*range(-REACH, 0), *range(1, REACH + 1)):
        h = _hermite(d / math.sqrt(2), 2 * TERMS)
        out[d] = np.array([[(-1) ** j / math.factorial(j) * h[j + k] for k in range(TERMS)] for j in range(TERMS)])
    return out


def _expansions(cells: DataFrame, group: list[str]) -> DataFrame:
    """``(group.., _cell, _left, _right)``: coefficients of the bells of the cells below and above."""
    matrices = movers()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def moved(d: pd.Series, sums: pd.Series) -> pd.Series:
        given, out = np.stack(sums.to_numpy()), np.empty((len(d), TERMS))
        for k, matrix in matrices.items():
            mine = (d == k).to_numpy()
            out[mine] = given[mine] @ matrix.T
        return pd.Series(list(out))

    steps = F.array(*[F.lit(d) for d in matrices])
    sent = cells.select(*group, "_cell", "_sums", F.explode(steps).alias("_d")).withColumn("_cell", F.col("_cell") + F.col("_d"))
    asked = sent.join(cells.select(*group, "_cell"), [*group, "_cell"], "left_semi")
    heard = asked.withColumn("_m", moved("_d", "_sums"))
    sides = {"_left": F.col("_d") > 0, "_right": F.col("_d") < 0}
    added = heard.groupBy(*group, "_cell").agg(
        *[F.sum(F.when(where, F.col("_m")[j]).otherwise(lit(0))).alias(f"{side}{j}") for side, where in sides.items() for j in range(TERMS)]
    )
    return added.select(*group, "_cell", *[F.array(*[F.col(f"{side}{j}") for j in range(TERMS)]).alias(side) for side in sides])


def _powers(coefficients, at: Column, n: int) -> Column:
    """Horner's rule; ``coefficients(k)`` is a column."""
    out = coefficients(n - 1)
    for k in range(n - 2, -1, -1):
        out = out * at + coefficients(k)
    return out


def narrow_flows(counts: DataFrame, sizes: DataFrame, group: list[str], sigma: float, limit: int | None, distinct: int) -> DataFrame:
    """``(group.., x, plus, minus, rows)``: 1 - bell summed over the values below x, and over those above.

    ``counts`` has each distinct ``x`` of a group with its ``n``, ``sizes`` the ``_rows`` of a group."""
    cell = F.floor(F.col("x") / lit(sigma)).cast("long")
    u = F.col("x") / lit(sigma) - F.col("_cell") - 0.5  # from the middle, in units of sigma
    v = F.col("_u") / lit(math.sqrt(2))
    line = counts.withColumn("_cell", cell).withColumn("_u", u).withColumn("_bell", F.exp(-F.col("_u") * F.col("_u") / 2))
    line = line.withColumns({f"_m{k}": F.col("n") * F.col("_bell") * F.pow("_u", lit(k)) for k in range(OWN_TERMS)})
    line = settle(line)
    cells = settle(
        line.groupBy(*group, "_cell").agg(
            F.array(*[F.sum(F.col("n") * F.pow(v, lit(k))) / lit(math.factorial(k)) for k in range(TERMS)]).alias("_sums"),
            F.array(*[F.sum(f"_m{k}") for k in range(OWN_TERMS)]).alias("_own"),
        )
    )
    place = [*group, "_cell"]
    below = running_sums(counts, group, "x", {"_c": F.col("n")}, limit, distinct).select(*group, "x", "_c")
    inside = running_sums(line, place, "x", {f"_r{k}": F.col(f"_m{k}") for k in range(OWN_TERMS)}, limit, distinct)
    full = inside.join(below, [*group, "x"]).join(cells.drop("_sums"), place).join(_expansions(cells, group), place, "left").join(sizes, group)

    def own(moment) -> Column:
        return F.col("_bell") * _powers(lambda k: moment(k) / lit(math.factorial(k)), F.col("_u"), OWN_TERMS)

    def far(side: str) -> Column:
        return F.coalesce(_powers(lambda k: F.col(side)[k], v, TERMS), lit(0))

    near_below = own(lambda k: F.col(f"_r{k}") - F.col(f"_m{k}"))
    near_above = own(lambda k: F.col("_own")[k] - F.col(f"_r{k}"))
    plus = (F.col("_c") - F.col("n")) - near_below - far("_left")
    minus = (F.col("_rows") - F.col("_c")) - near_above - far("_right")
    return full.select(*group, "x", plus.alias("plus"), minus.alias("minus"), F.col("_rows").alias("rows"))
