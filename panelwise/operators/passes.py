"""Row-wise programs that need group statistics, run in shared passes.

A program is a generator. It yields ``Step(rows, stats)``: new row columns and
aggregates over them, and gets back a lookup for both. All programs advance
together, so each pass over the data is ONE aggregation for every method and
every criterion, with partial sums on the map side; the result has one row per
group, is written to shared storage, and is joined back to the rows. The rows
themselves are never shuffled while the group table is small enough for
Spark's own broadcast check, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from panelwise.functions.guards import join_groups
from panelwise.session import settle


@dataclass
class Step:
    rows: dict[str, Column] = field(default_factory=dict)
    stats: dict[str, Column | Callable] = field(default_factory=dict)


Lookup = Callable[[str], Column]
Program = Generator[Step, Lookup, dict[str, Column]]

ONE_GROUP = "_all_rows"


def run_programs(
    df: DataFrame, by: Sequence[str], programs: Mapping[str, Program]
) -> tuple[DataFrame, dict[str, dict[str, Column]]]:
    """Advance all programs; return the rows with every helper column, and each
    program's result expressions."""
    by = list(by)
    if not by:
        df, by = df.withColumn(ONE_GROUP, F.lit(0)), [ONE_GROUP]
    results: dict[str, dict[str, Column]] = {}
    waiting: dict[str, tuple[Program, Lookup | None]] = {k: (g, None) for k, g in programs.items()}
    while waiting:
        df, stats, waiting = _advance(df, waiting, results)
        if stats:
            df = attach(df, settle(df.groupBy(*by).agg(*stats)), by)
    return df, results


def _advance(df: DataFrame, waiting: dict, results: dict):
    """Run every program up to its next request for statistics; steps that only
    add row columns cost no pass."""
    stats: list[Column] = []
    asking: dict[str, tuple[Program, Lookup]] = {}
    while waiting:
        rows: dict[str, Column] = {}
        layer: dict[str, tuple[Program, Lookup]] = {}
        requests: list[tuple[str, Step, Lookup]] = []
        for key, (program, lookup) in waiting.items():
            try:
                step = program.send(lookup)
            except StopIteration as stop:
                results[key] = stop.value
                continue

            def look(name: str, key: str = key) -> Column:
                return F.col(f"`{key}:{name}`")

            rows |= {f"{key}:{name}": col for name, col in step.rows.items()}
            if step.stats:
                requests.append((key, step, look))
                asking[key] = (program, look)
            else:
                layer[key] = (program, look)
        if rows:
            df = df.withColumns(rows)
        for key, step, look in requests:
            for name, agg in step.stats.items():
                stats.append((agg if isinstance(agg, Column) else agg(look)).alias(f"{key}:{name}"))
        waiting = layer
    return df, stats, asking


def attach(df: DataFrame, table: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join a settled per-group table back to the rows on NULL-safe keys.

    No broadcast hint: the planner knows the file size and broadcasts below
    ``spark.sql.autoBroadcastJoinThreshold``, else sort-merges with AQE's skew split.
    """
    return join_groups(df, table, list(by), how)


def with_stats(df: DataFrame, by: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """One aggregation joined back to the rows, under the given names."""
    by = list(by)
    if not by:
        one = settle(df.groupBy(F.lit(0).alias(ONE_GROUP)).agg(*[c.alias(n) for n, c in stats.items()]))
        return df.withColumn(ONE_GROUP, F.lit(0)).join(one, ONE_GROUP, "left").drop(ONE_GROUP)
    return attach(df, settle(df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])), by)
