"""Adaptive interval widths with state kept for each group by Structured Streaming itself.

The state of a group is its level alpha_t, the counts of residual cells of all closed periods and those of the
open one, so it grows with the cells that occur and not with the rows. It lies in the query's
checkpoint: a query that starts again, or a task that runs twice, goes on from the last finished batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelwise.functions.relative_cells import ERROR, cell_of, end_value
from panelwise.operators.adaptive import moved, rank_of
from panelwise.operators.evaluate import known
from panelwise.panel import PERIOD

STATE = "alpha double, period long, cells array<long>, counts array<long>, open_cells array<long>, open_counts array<long>"


def _counts(cells: Sequence[int], counts: Sequence[int]) -> Counter:
    return Counter(dict(zip((int(c) for c in cells), (int(n) for n in counts), strict=True)))


def _width_cell(seen: Counter, alpha_t: float) -> int:
    """The cell of the conformal quantile of the residuals seen."""
    cells = sorted(seen)
    upto = np.cumsum([seen[c] for c in cells])
    return cells[int(np.searchsorted(upto, rank_of(alpha_t, float(upto[-1])) - 1e-9))]


def keyed_widths(
    forecasts: DataFrame, group: Sequence[str], alpha: float = 0.1, gamma: float = 0.05, error: float = ERROR
) -> DataFrame:
    """``(group.., period, alpha_t, half_width, miss)`` of a stream of forecasts with their truths, as
    :func:`panelwise.operators.adaptive.adaptive_widths` gives for a table.

    A period's row comes when a row of a later period does, for until then more of its own may
    arrive, over any number of batches. Rows of a period already closed count for later widths; its row stands as it was
    given. Rows without truth, forecast or period are left out. Every task counts its rows by cell before they are shuffled,
    so that a group that holds most rows sends few. Write the result in append mode."""
    group = list(group)
    rows = known(forecasts).where(F.col(PERIOD).isNotNull()).select(
        *group, F.col(PERIOD).cast("long").alias(PERIOD), cell_of(F.abs(F.col("y") - F.col("yhat")), error).alias("cell"), F.lit(1).cast("long").alias("n")
    )
    keys = [*group, PERIOD, "cell"]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(keys, dropna=False, as_index=False)["n"].sum()

    few = rows.mapInPandas(counted, rows.schema)
    out = T.StructType(
        [rows.schema[name] for name in group]
        + [T.StructField(PERIOD, T.LongType())]
        + [T.StructField(name, T.DoubleType()) for name in ("alpha_t", "half_width", "miss")]
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh: dict[int, Counter] = {}
        for batch in batches:
            for period, part in batch.groupby(PERIOD):
                add = part.groupby("cell")["n"].sum()
                fresh.setdefault(int(period), Counter()).update(_counts(add.index, add))
        if state.exists:
            a, at, cells, counts, open_cells, open_counts = state.get
            seen, current = _counts(cells, counts), _counts(open_cells, open_counts)
        else:
            a, at, seen, current = alpha, min(fresh), Counter(), Counter()
        done = []
        for period in sorted(fresh):
            if period < at:
                seen.update(fresh[period])
                continue
            if period > at:
                if seen:
                    wide = _width_cell(seen, a)
                    miss = sum(n for c, n in current.items() if c > wide) / sum(current.values())
                    done.append((*key, at, a, end_value(wide, error), miss))
                    a = moved(a, miss, alpha, gamma)
                seen.update(current)
                at, current = period, Counter()
            current.update(fresh[period])
        state.update((a, at, list(seen), list(seen.values()), list(current), list(current.values())))
        yield pd.DataFrame(done, columns=out.names)

    return few.groupBy(*group).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)
