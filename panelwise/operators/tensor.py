"""Completion of the entity x period x indicator array by a low-rank model.

x[e, t, j] is approximated by sum_r A[e, r] B[t, r] C[j, r], fitted to the observed
cells by alternating least squares. B and C have a row per period and per
indicator and live on the driver. A has a row per entity, which is a linear function
of its observed cells, the same one for all entities observed at the same places. So
rounds need only the sums of products of such entities' cells: as many made-up
entities as they have cells stand for them (:func:`_condensed`), and entities are read
once before the rounds and once to be filled. Up to ``LOCAL_NUMBERS`` numbers these
are held here, beyond that they stay in Spark and a round is two passes over them.
Both do the same."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from panelwise.functions.guards import lit
from panelwise.operators.passes import with_stats
from panelwise.operators.patterns import LOCAL_NUMBERS
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle


def _sums(index: np.ndarray, cells: np.ndarray, size: int) -> np.ndarray:
    """Column sums of ``cells`` by ``index``."""
    return np.column_stack([np.bincount(index, column, size) for column in cells.T])


def _products(z: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What a cell adds to its normal equations: z z' and z x."""
    return np.column_stack([(z[:, :, None] * z[:, None, :]).reshape(len(z), -1), z * x[:, None]])


def _entity_factors(x: np.ndarray, t: np.ndarray, e: np.ndarray, n: int, b: np.ndarray, c: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge solutions of ``n`` entities' factors from their observed cells."""
    r, j = np.nonzero(~np.isnan(x))
    return _factors(x[r, j], t[r], j, e[r], n, b, c, penalty)


def _factors(x: np.ndarray, t: np.ndarray, j: np.ndarray, e: np.ndarray, n: int, b: np.ndarray, c: np.ndarray, penalty: float) -> np.ndarray:
    """:func:`_entity_factors` from a list of cells."""
    rank = b.shape[1]
    sums = _sums(e, _products(b[t] * c[j], x), n)
    return np.linalg.solve(sums[:, : rank * rank].reshape(n, rank, rank) + penalty * np.eye(rank), sums[:, rank * rank :, None])[..., 0]


def complete_tensor(
    df: DataFrame, columns: Sequence[str], rank: int = 3, rounds: int = 10, penalty: float = 0.1, seed: int = 7,
    tolerance: float = 1e-4, change_as: str | None = None, numbers: int | None = None,
) -> DataFrame:
    """Fill the missing cells of a wide panel; observed cells are kept. ``numbers``: what is held here, see ``LOCAL_NUMBERS``."""
    columns = list(columns)
    stats = {f"_m_{c}": F.avg(c) for c in columns} | {f"_s_{c}": F.stddev_pop(c) for c in columns}
    base = with_stats(df, [], stats)
    scale = {c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(lit(1)) for c in columns}
    periods = [r[0] for r in df.select(PERIOD).distinct().orderBy(PERIOD).collect()]  # a factor row each
    z = base.withColumns({f"_z_{c}": (F.col(c) - F.col(f"_m_{c}")) / scale[c] for c in columns})
    # an entity's rows (one per period) meet once
    packed = settle(
        z.groupBy(ENTITY).agg(
            F.collect_list(F.struct(PERIOD, F.array(*[F.col(f"_z_{c}") for c in columns]).alias("v"))).alias("rows")
        )
    )
    few = settle(_alike_once(packed, periods, len(columns)))
    local = few.count() * len(periods) * len(columns) <= (LOCAL_NUMBERS if numbers is None else numbers)
    held = _arrays(sorted((r["places"], r["x"]) for r in few.collect()), len(periods) * len(columns)) if local else None
    rng = np.random.default_rng(seed)
    b = rng.normal(0, 0.5, (len(periods), rank)) + 1.0 / rank
    c = rng.normal(0, 0.5, (len(columns), rank)) + 1.0 / rank
    for turn in range(rounds):
        old = np.concatenate([b.ravel(), c.ravel()])
        for mode in ("period", "indicator"):
            target = b if mode == "period" else c
            sums = _held_sums(*held, mode, b, c, penalty) if local else _normal_equations(few, mode, b, c, penalty)
            for k in range(len(sums)):
                g, y = sums[k, : rank * rank].reshape(rank, rank), sums[k, rank * rank :]
                target[k] = np.linalg.solve(g + penalty * np.eye(rank), y)
        new = np.concatenate([b.ravel(), c.ravel()])
        change = np.linalg.norm(new - old) / max(np.linalg.norm(old), 1e-12)
        if change < tolerance:
            break

    key = next(f for f in df.schema.fields if f.name == ENTITY)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p, x, t, e in _pieces(batches, periods):
            a = _entity_factors(x, t, e, batch.num_rows, b, c, penalty)
            fit = (a[e] * b[t]) @ c.T
            fit = pa.ListArray.from_arrays(np.arange(0, fit.size + 1, len(c), np.int32), pa.array(fit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(ENTITY).take(pa.array(e)), p, fit], names=[ENTITY, PERIOD, "fit"])

    schema = T.StructType([key, df.schema[PERIOD], T.StructField("fit", T.ArrayType(T.DoubleType()))])
    fits = packed.mapInArrow(fill, schema)
    joined = base.join(fits, [ENTITY, PERIOD], "left")
    filled = {
        col: F.coalesce(F.col(col), F.col("fit")[i] * scale[col] + F.col(f"_m_{col}")) for i, col in enumerate(columns)
    }
    out = joined.withColumns(filled).select(*df.columns)
    return out if change_as is None else out.withColumn(change_as, F.lit(float(change)))


def _pieces(batches: Iterator[pa.RecordBatch], periods: list, most: int = 1000) -> Iterator[tuple]:
    """``(batch, period, x, t, e)`` for ``most`` entities at a time: a row of ``x`` for each of their rows, its period,
    the period's place and the entity's place in the batch."""
    known = np.array([p for p in periods if p is not None])
    for whole in batches:
        for start in range(0, whole.num_rows, most):
            batch = whole.slice(start, most)
            rows = batch.column("rows")
            p, v = rows.flatten().flatten()
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1).astype(float)
            missing = np.asarray(p.is_null())
            t = np.searchsorted(known, p.fill_null(0).to_numpy()) + len(periods) - len(known)
            t = np.where(missing, 0, t)  # the null period is the first
            yield batch, p, x, t, np.repeat(np.arange(batch.num_rows), rows.value_lengths().to_numpy())


def _fewer(x: np.ndarray) -> np.ndarray:
    """Rows with the sums of products of ``x``, no more than it has columns."""
    return x if len(x) <= x.shape[1] else np.linalg.qr(x, mode="r")


def _condensed(found: Iterable[tuple[bytes, np.ndarray]], most: int = LOCAL_NUMBERS) -> Iterator[pa.RecordBatch]:
    """places, x: entities that stand for all entities with cells ``x`` at the same ``places``. Beyond ``most`` numbers held
    they are given away as they are; others with these places then stay apart, which changes no sum."""
    held, numbers = defaultdict(list), 0

    def given() -> Iterator[pa.RecordBatch]:
        rows = [(places, row.tobytes()) for places, parts in held.items() for row in _fewer(np.concatenate(parts))]
        held.clear()
        for start in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.binary()) for column in zip(*rows[start : start + 1000], strict=True)], names=["places", "x"])

    for places, x in found:
        parts = held[places]
        parts.append(x)
        numbers += x.size
        if sum(map(len, parts)) > 2 * x.shape[1]:
            numbers -= sum(part.size for part in parts)
            parts[:] = [_fewer(np.concatenate(parts))]
            numbers += parts[0].size
        if numbers > most:
            yield from given()
            numbers = 0
    yield from given()


def _alike_once(packed: DataFrame, periods: list, width: int) -> DataFrame:
    """places (period's place times ``width`` plus the indicator's, ascending, 32-bit), x (a double for each): see :func:`_condensed`."""

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray]]:
        for batch, _, x, t, e in _pieces(batches, periods):
            r, j = np.nonzero(~np.isnan(x))
            places = (t[r] * width + j).astype(np.int32)
            order = np.lexsort((places, e[r]))
            places, cells = places[order], x[r, j][order]
            ends = np.cumsum(np.bincount(e[r], minlength=batch.num_rows))
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if end > start:  # one without cells adds nothing
                    yield places[start:end].tobytes(), cells[None, start:end]

    def condensed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for batch in batches for pair in zip(batch.column("places").to_pylist(), batch.column("x").to_pylist(), strict=True))
        return _condensed((places, np.frombuffer(x)[None]) for places, x in pairs)

    schema = "places binary, x binary"
    return packed.select("rows").mapInArrow(lambda batches: _condensed(entities(batches)), schema).repartition("places").mapInArrow(condensed, schema)


def _cells(found: list[tuple[bytes, bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """``(x, t, j, e, n)``: cells of ``n`` entities as lists of the value, the period's place, the indicator's and the entity."""
    places = np.frombuffer(b"".join(p for p, _ in found), np.int32)
    x = np.frombuffer(b"".join(x for _, x in found))
    return x, places // width, places % width, np.repeat(np.arange(len(found)), [len(x) // 8 for _, x in found]), len(found)


def _normal_sums(
    x: np.ndarray, t: np.ndarray, j: np.ndarray, e: np.ndarray, n: int, mode: str, b: np.ndarray, c: np.ndarray, penalty: float
) -> np.ndarray:
    """Sums of the normal equations of every period or indicator, a row each, over :func:`_cells`."""
    a = _factors(x, t, j, e, n, b, c, penalty)
    z = a[e] * (c[j] if mode == "period" else b[t])
    return _sums(t if mode == "period" else j, _products(z, x), len(b) if mode == "period" else len(c))


def _arrays(found: list[tuple[bytes, bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(x, counts, of, starts)`` of sorted entities: a row of sums of cells by place for each entity, a row of how many cells
    a place has for each list of places, the entities' lists, and where each list's entities start."""
    x, lists = np.zeros((len(found), size)), {}
    for i, (places, cells) in enumerate(found):
        lists.setdefault(places, i)
        np.add.at(x[i], np.frombuffer(places, np.int32), np.frombuffer(cells))
    counts = np.array([np.bincount(np.frombuffer(places, np.int32), minlength=size) for places in lists], float).reshape(-1, size)
    starts = np.array(list(lists.values()), int)
    return x, counts, np.repeat(np.arange(len(starts)), np.diff([*starts, len(found)])), starts


def _held_sums(
    x: np.ndarray, counts: np.ndarray, of: np.ndarray, starts: np.ndarray, mode: str, b: np.ndarray, c: np.ndarray, penalty: float
) -> np.ndarray:
    """:func:`_normal_sums` over :func:`_arrays`."""
    rank = b.shape[1]
    pairs = lambda v: (v[..., :, None] * v[..., None, :]).reshape(*v.shape[:-1], rank * rank)
    z = (b[:, None] * c).reshape(-1, rank)
    g = (counts @ pairs(z)).reshape(-1, rank, rank) + penalty * np.eye(rank)
    a = np.linalg.solve(g[of], (x @ z)[..., None])[..., 0]
    seen = (counts.T @ np.add.reduceat(pairs(a), starts)).reshape(len(b), len(c), -1)
    y = (x.T @ a).reshape(len(b), len(c), -1)
    axis, other = (1, c) if mode == "period" else (0, b[:, None])
    return np.concatenate([(seen * pairs(other)).sum(axis), (y * other).sum(axis)], axis=1)


def _normal_equations(few: DataFrame, mode: str, b: np.ndarray, c: np.ndarray, penalty: float) -> np.ndarray:
    """:func:`_normal_sums` in Spark. Each task sends its sums as one value, so a pass is one stage."""
    rank, size, width = b.shape[1], len(b) if mode == "period" else len(c), len(c)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, rank * rank + rank))
        for batch in batches:
            found = list(zip(batch.column("places").to_pylist(), batch.column("x").to_pylist(), strict=True))
            sums += _normal_sums(*_cells(found, width), mode, b, c, penalty)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["s"])

    out = [np.frombuffer(r["s"]).reshape(size, -1) for r in few.mapInArrow(partial, "s binary").collect()]
    return sum(out, np.zeros((size, rank * rank + rank)))
