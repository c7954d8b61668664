"""Cells of positive numbers whose ends stand in a fixed ratio: counts of them add up, whatever the scale."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from panelwise.functions.guards import lit

#: The upper end of a cell is above its values by this part at most.
ERROR = 2e-3


def cell_of_zero(error: float = ERROR) -> int:
    """The lowest cell; it holds nothing but 0."""
    return math.floor(math.log(5e-324) / math.log1p(error)) - 1


def cell_of(x: Column, error: float = ERROR) -> Column:
    """Number of the cell of ``x`` >= 0, in the order of the values."""
    at = F.ceil(F.round(F.log(x) / lit(math.log1p(error)), 6)).cast("long")
    return F.when(x > 0, at).otherwise(F.lit(cell_of_zero(error)).cast("long"))


def upper_end(cell: Column, error: float = ERROR) -> Column:
    """Largest value of a cell; 0 for the cell of zeros."""
    return F.when(cell > cell_of_zero(error), F.exp(cell * lit(math.log1p(error)))).otherwise(lit(0))


def end_value(cell: int, error: float = ERROR) -> float:
    """:func:`upper_end` of one number."""
    return math.exp(cell * math.log1p(error)) if cell > cell_of_zero(error) else 0.0
