"""Iterated linear imputation without passes over rows.

In a method that starts from constants and replaces gaps by linear functions of the whole row, again and again, a
row is at every moment an affine function of its observed cells, the same one for all rows with the same pattern of
gaps. So the rows are read once, into one matrix of sums of products for each pattern; rounds move one matrix for each
pattern; and a last pass fills the rows. Patterns are at most 2 ** columns, and no more than rows: up to ``LOCAL_NUMBERS``
numbers they are held here, beyond that they stay in Spark and a round is one pass over them. Both do the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelwise.functions.guards import lit
from panelwise.operators.linear import moment_rows
from panelwise.session import settle

#: Numbers of all patterns' matrices that are held in one process: 16 MB.
LOCAL_NUMBERS = 2_000_000
PATTERN = "_pattern"


def pattern_of(columns: Sequence[str]) -> Column:
    """1 for each column that is missing, 0 for the others, as a string."""
    return F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])


def moved(sums: np.ndarray, maps: np.ndarray, gaps: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """(new maps, sum of squared changes of cells) when each gap becomes the row times ``weights``, a column for each cell.

    ``sums``: sums of products of (1, observed cells or 0) by pattern; ``maps``: from those to (1, all cells)."""
    new = maps.copy()
    new[:, :, 1:] = np.where(gaps[:, None, :], maps @ weights, maps[:, :, 1:])
    d = (new - maps)[:, :, 1:]
    return new, float(np.einsum("kac,kab,kbc->", d, sums, d, optimize=True))


def full_sums(sums: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Sums of products of (1, all cells) by pattern."""
    return np.swapaxes(maps, 1, 2) @ sums @ maps


@dataclass(frozen=True)
class Layout:
    """How the rows of a pattern table become matrices, and what is summed over them."""

    key: str
    by_cell: bool
    start: np.ndarray

    @property
    def size(self) -> int:
        return len(self.start) + 1

    def read(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group, gaps, sums, maps) of rows of a pattern table."""
        n, q = len(pdf), self.size
        upper = np.triu_indices(q)
        sums, maps = np.zeros((n, q, q)), np.tile(np.eye(q), (n, 1, 1))
        if n:
            sums[:, upper[0], upper[1]] = np.stack(pdf["sums"].to_numpy())
            sums[:, upper[1], upper[0]] = sums[:, upper[0], upper[1]]
        gaps = np.array([[c == "1" for c in p] for p in pdf[PATTERN]], bool).reshape(n, q - 1)
        if "maps" in pdf and n:
            maps = np.stack(pdf["maps"].to_numpy()).reshape(n, q, q)
        elif n:
            row, cell = np.nonzero(gaps)
            maps[row, cell + 1, cell + 1] = 0
            maps[row, 0, cell + 1] = self.start[cell]
        return pdf[self.key].to_numpy(), gaps, sums, maps

    def totals(self, keys: np.ndarray, gaps: np.ndarray, sums: np.ndarray, maps: np.ndarray) -> dict:
        whole = full_sums(sums, maps)
        if self.by_cell:
            return {c: whole[~gaps[:, c]].sum(axis=0) for c in range(self.size - 1)}
        return {k: whole[keys == k].sum(axis=0) for k in pd.unique(keys)}

    def advance(self, state: tuple, weights: np.ndarray | dict, only: int | None = None) -> tuple[tuple, float]:
        keys, gaps, sums, maps = state
        if not len(keys):
            return state, 0.0
        own = np.stack([weights[k] for k in keys]) if isinstance(weights, dict) else weights
        maps, change = moved(sums, maps, gaps if only is None else gaps & (np.arange(gaps.shape[1]) == only), own)
        return (keys, gaps, sums, maps), change

    def round(self, weights: np.ndarray | dict | None, only: int | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Patterns with their new maps (part -1), then the task's sums (part: the column, or 0 with the group)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            change, totals = 0.0, {}
            for pdf in batches:
                state = self.read(pdf)
                if weights is not None:
                    state, added = self.advance(state, weights, only)
                    change += added
                for k, m in self.totals(*state).items():
                    totals[k] = totals.get(k, 0.0) + m
                yield pdf[[self.key, PATTERN, "sums"]].assign(maps=list(state[3].reshape(len(pdf), -1)), part=-1, change=0.0)
            none = {self.key: pd.Series([None], dtype=object), PATTERN: [None], "maps": [None], "change": [0.0]}
            for k, m in totals.items():
                own = {"part": [k]} if self.by_cell else {self.key: [k], "part": [0]}
                yield pd.DataFrame({**none, "sums": [m.ravel()], **own})
            yield pd.DataFrame({**none, "sums": [None], "part": [-2], "change": [change]})

        return run


class PatternRows:
    """All rows of ``df`` by ``group`` (a column or none) and pattern of gaps in ``columns``; gaps start at ``start``.

    ``totals``: sums of products of (1, all cells), with ``by_cell`` for each column (its index) over the rows where it is
    present, else for each group (its value) over all its rows. ``numbers``: what is held here, see ``LOCAL_NUMBERS``."""

    def __init__(self, df: DataFrame, columns: Sequence[str], start: Sequence[float], group: str | None = None, by_cell: bool = True, numbers: int | None = None):
        self.columns, self.group = list(columns), group
        self.key = df.schema[group] if group else T.StructField("_group", T.IntegerType())
        self.layout = Layout(self.key.name, by_cell, np.asarray(start, float))
        own = F.col(group) if group else F.lit(0).alias("_group")
        rows = df.select(own, pattern_of(columns).alias(PATTERN), *[F.coalesce(c, lit(0)).alias(c) for c in self.columns])
        cells = F.sort_array(F.collect_list(F.struct("i", "j", "s")))  # as many as a matrix has
        found = moment_rows(rows, self.columns, [self.key.name, PATTERN]).groupBy(self.key.name, PATTERN).agg(cells.getField("s").alias("sums"))
        self.state = settle(found)
        self.local = self.state.count() * self.layout.size**2 <= (LOCAL_NUMBERS if numbers is None else numbers)
        if self.local:
            self.held = self.layout.read(self.state.toPandas())
            self.totals = self.layout.totals(*self.held)
        else:
            self.totals, _ = self._pass(None)

    def advance(self, weights: np.ndarray | dict, only: int | None = None) -> float:
        """Every gap (of one column, if ``only`` names its index) becomes its row times its column of ``weights`` (one matrix,
        or one for each group); returns the sum of squared changes."""
        if self.local:
            self.held, change = self.layout.advance(self.held, weights, only)
            self.totals = self.layout.totals(*self.held)
        else:
            self.totals, change = self._pass(weights, only)
        return change

    def _pass(self, weights: np.ndarray | dict | None, only: int | None = None) -> tuple[dict, float]:
        """A round over the patterns in Spark: written with their new maps, next to the tasks' sums."""
        numbers = T.ArrayType(T.DoubleType())
        fields = [T.StructField(self.key.name, self.key.dataType), T.StructField(PATTERN, T.StringType()), T.StructField("sums", numbers),
                  T.StructField("maps", numbers), T.StructField("part", T.IntegerType()), T.StructField("change", T.DoubleType())]
        out = settle(self.state.mapInPandas(self.layout.round(weights, only), T.StructType(fields)))
        self.state = out.filter("part = -1").drop("part", "change")
        cells = out.filter("part >= 0").select("part", F.col(self.key.name).alias("own"), F.posexplode("sums").alias("at", "s"))
        q, totals = self.layout.size, {}
        for r in cells.groupBy("part", "own", "at").agg(F.sum("s").alias("s")).collect():  # (columns or groups) * q * q
            totals.setdefault(r["part"] if self.layout.by_cell else r["own"], np.zeros(q * q))[r["at"]] = r["s"]
        return {k: v.reshape(q, q) for k, v in totals.items()}, out.agg(F.sum("change")).first()[0] or 0.0

    def maps(self, weights: np.ndarray | None = None) -> DataFrame:
        """``(group, pattern, maps)`` of the patterns with gaps: for each column the weights of (1, observed cells or 0), after
        one more round with ``weights`` if given (the state stays as it is)."""
        layout, key, q = self.layout, self.key, self.layout.size
        schema = T.StructType([T.StructField(key.name, key.dataType), T.StructField(PATTERN, T.StringType()), T.StructField("maps", T.ArrayType(T.ArrayType(T.DoubleType())))])

        def columns_of(keys: np.ndarray, gaps: np.ndarray, sums: np.ndarray, maps: np.ndarray) -> pd.DataFrame:
            names = ["".join("01"[int(g)] for g in row) for row in gaps]
            return pd.DataFrame({key.name: keys, PATTERN: names, "maps": [list(m[:, 1:].T) for m in maps]})[gaps.any(axis=1)]

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                state = layout.read(pdf)
                yield columns_of(*(state if weights is None else layout.advance(state, weights)[0]))

        if not self.local:
            return settle(self.state.mapInPandas(spread, schema))
        table = columns_of(*(self.held if weights is None else layout.advance(self.held, weights)[0]))
        rows = [(k, p, [[float(v) for v in c] for c in m]) for k, p, m in zip(table[key.name].tolist(), table[PATTERN], table["maps"], strict=True)]
        return settle(self.state.sparkSession.createDataFrame(rows, schema))

    def filled(self, df: DataFrame, maps: DataFrame | None = None) -> DataFrame:
        """``df`` with every gap of the columns filled; one pass, joined by pattern (and group). ``maps``: others than its own."""
        rows = df.withColumn(PATTERN, pattern_of(self.columns))
        on = [PATTERN]
        if self.group:
            on = [self.group, PATTERN]
        table = self.maps() if maps is None else maps
        joined = rows.join(table if self.group else table.drop(self.key.name), on, "left")
        row = F.array(lit(1), *[F.coalesce(c, lit(0)) for c in self.columns])
        product = lambda weights: F.aggregate(F.zip_with(row, weights, lambda a, b: a * b), lit(0), lambda total, v: total + v)
        cells = {c: F.coalesce(c, product(F.element_at("maps", i + 1))) for i, c in enumerate(self.columns)}
        return joined.select(*[cells[c].alias(c) if c in cells else F.col(c) for c in df.columns], *[c for c in joined.columns if c not in (*df.columns, PATTERN, "maps")])
