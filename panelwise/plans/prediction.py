"""Rank a matrix of predictions with six methods and their median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwise.functions.guards import all_of, score_key
from panelwise.operators import methods as M
from panelwise.operators import promethee as P
from panelwise.operators.critic import critic_matrix
from panelwise.operators.passes import run_programs
from panelwise.panel import ENTITY
from panelwise.session import settle

SIX = ("topsis", "vikor", "promethee", "copras", "edas", "saw")


def prediction_scores(matrix: DataFrame, columns: Sequence[str], cost: frozenset[str] = frozenset()) -> DataFrame:
    """``(entity, topsis, vikor, promethee, copras, edas, saw, median)`` on complete rows.

    Weights are CRITIC of the matrix. VIKOR counts as 1 - Q, COPRAS as utility / 100,
    the net flow is scaled to [0, 1]."""
    by = ["_m"]
    rows = settle(matrix.where(all_of(F.col(c).isNotNull() for c in columns)).select(F.lit(0).alias("_m"), ENTITY, *columns))
    weights = settle(critic_matrix(rows, columns, by).select("_m", *[f"weight_{c}" for c in columns]))
    placed = rows.join(weights, "_m")

    def w(c: str):
        return F.col(f"weight_{c}")

    programs = {m: M.METHODS[m](columns, F.col, w, cost) for m in SIX if m != "promethee"}
    programs["scale"] = M.ranking_scale(columns, F.col, cost)
    out, found = run_programs(placed, by, programs)
    cells = F.array(
        *[F.struct(F.lit(c).alias("indicator"), found["scale"][c].alias("x"), w(c).alias("w")) for c in columns]
    )
    long = settle(out.select("_m", ENTITY, F.inline(cells)))
    flow = settle(P.flows(long, by, ENTITY))
    scaled, net = run_programs(flow, by, {"promethee": M.unit_scale(F.col("phi"))})
    table = out.select(
        ENTITY,
        found["topsis"]["score"].alias("topsis"),
        (1 - found["vikor"]["Q"]).alias("vikor"),
        (found["copras"]["utility"] / 100).alias("copras"),
        found["edas"]["AS"].alias("edas"),
        found["saw"]["score"].alias("saw"),
    ).join(scaled.select(ENTITY, net["promethee"]["score"].alias("promethee")), ENTITY)
    ordered = F.array_sort(F.array(*[F.col(m) for m in SIX]))
    return table.select(ENTITY, *SIX, ((ordered[2] + ordered[3]) / 2).alias("median"))


def rank_predictions(matrix: DataFrame, columns: Sequence[str], n: int = 10, cost: frozenset[str] = frozenset()) -> DataFrame:
    """The n best by median score, with their position."""
    from pyspark.sql import Window

    best = prediction_scores(matrix, columns, cost).orderBy(score_key(F.col("median")).desc(), ENTITY).limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy(score_key(F.col("median")).desc(), ENTITY)
    return best.withColumn("rank", F.row_number().over(w))
