"""Work that must not be repeated for each replicate, tree or entity."""

import numpy as np
import pytest

from panelwise.operators import combine, models, stability, tensor


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scenarios_are_not_shuffled_to_be_summed(spark):
    means = spark.createDataFrame(
        [(2000, 1, "a", 1.0), (2000, 1, "b", 2.0), (2000, 2, "a", None), (2000, 2, "b", 4.0), (2000, 3, "a", None), (2000, 4, "z", 1.0)],
        "period int, entity int, criterion string, mean double",
    )
    scenarios = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 1.0)], "scenario int, criterion string, w double")
    out = combine.reweigh(means, scenarios, ranked=False)
    assert "hashpartitioning(scenario" not in plan(out)
    got = {(r["scenario"], r["entity"]): r["composite"] for r in out.collect()}
    assert got == {(1, 1): 1.75, (1, 2): 3.0, (1, 3): None, (2, 1): 1.0, (2, 2): None, (2, 3): None}


def test_ranks_without_noise_are_made_once(spark):
    means = spark.createDataFrame([(2000, e, "a", e % 7 / 7) for e in range(40)], "period int, entity int, criterion string, mean double")
    out = stability.criterion_sensitivity(means, 3, replicates=5)
    assert "_x#" not in plan(out)
    assert [r["sensitivity"] for r in out.collect()] == [1.0]


def test_leaf_cells_are_not_shuffled(spark):
    rows = spark.createDataFrame([(e, 1, float(e % 9), float(e % 9 + e % 4)) for e in range(90)], "entity int, period int, f double, y double")
    forest = models.quantile_forest(rows, ["f"], "y", ["entity", "period"], trees=3, depth=2)
    out = forest.quantiles(rows, ["entity", "period"], {"low": 0.1, "high": 0.9})
    assert "cells" not in plan(out)
    got = out.collect()
    assert len(got) == 90 and all(r["low"] <= r["mean"] <= r["high"] for r in got)


def test_factors_of_many_entities_at_once():
    rng = np.random.default_rng(1)
    b, c, t, e = rng.normal(size=(4, 3)), rng.normal(size=(5, 3)), np.array([0, 2, 3, 1, 1, 0]), np.array([0, 0, 0, 1, 1, 3])
    x = rng.normal(size=(6, 5))
    x[rng.random(x.shape) < 0.3] = np.nan
    got = tensor._entity_factors(x, t, e, 4, b, c, 0.1)
    for entity in range(4):
        own = e == entity
        r, j = np.nonzero(~np.isnan(x[own]))
        z = b[t[own][r]] * c[j]
        want = np.linalg.solve(z.T @ z + 0.1 * np.eye(3), z.T @ x[own][r, j])
        assert got[entity] == pytest.approx(want)


def odd_panel(spark):
    """Many entities of two patterns, some with gaps of their own; a row without a period, one without an entity, one that
    comes twice, one without cells."""
    rng = np.random.default_rng(4)
    rows = []
    for e in range(80):
        for p in range(4):
            v = [float(x) for x in rng.normal(size=3) + e % 7 - p]
            rows.append((e, p, *[None if e % 3 == 1 and p == 2 and k or e > 70 and rng.random() < 0.4 else x for k, x in enumerate(v)]))
    rows += [(None, 1, 2.0, None, 1.0), (3, None, 0.5, 1.5, None), rows[5], (90, 2, None, None, None)]
    return spark.createDataFrame(rows, "entity int, period int, a double, b double, c double").repartition(3), rows


def plain_rounds(rows, rounds, rank=2, penalty=0.1):
    """b and c after so many rounds over all entities and cells, one after another."""
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows])
    x = (x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0)
    t = np.array([0 if r[1] is None else r[1] + 1 for r in rows])
    e = np.unique([-1 if r[0] is None else r[0] for r in rows], return_inverse=True)[1]
    rng = np.random.default_rng(7)
    b, c = rng.normal(0, 0.5, (5, rank)) + 1.0 / rank, rng.normal(0, 0.5, (3, rank)) + 1.0 / rank
    r, j = np.nonzero(~np.isnan(x))
    fit = lambda z, y: np.linalg.solve(z.T @ z + penalty * np.eye(rank), z.T @ y)
    for _ in range(rounds):
        for target, other, own, its in ((b, c, t[r], j), (c, b, j, t[r])):
            a = np.stack([fit((b[t[r]] * c[j])[e[r] == k], x[r, j][e[r] == k]) for k in range(e.max() + 1)])
            for k in range(len(target)):
                target[k] = fit((a[e[r]] * other[its])[own == k], x[r, j][own == k])
    return b, c


@pytest.mark.parametrize("numbers", [None, 0])
def test_rounds_over_alike_entities_are_rounds_over_all(spark, monkeypatch, numbers):
    df, rows = odd_panel(spark)
    met = []
    name = "_held_sums" if numbers is None else "_normal_equations"
    made = getattr(tensor, name)
    monkeypatch.setattr(tensor, name, lambda *settings: met.append((settings[-3].copy(), settings[-2].copy())) or made(*settings))
    out = tensor.complete_tensor(df, ["a", "b", "c"], rank=2, rounds=5, tolerance=0.0, numbers=numbers)
    for k in (1, 4):
        b, c = plain_rounds(rows, k)
        assert np.allclose(met[2 * k][0], b, atol=1e-9) and np.allclose(met[2 * k][1], c, atol=1e-9)
    assert out.filter("a is null and entity is not null and period is not null").count() == 0


def test_rounds_need_no_jobs(spark):
    """Entities are read before the rounds; these run over as many as have cells of their own."""
    def jobs(rounds):
        spark.sparkContext.setJobGroup(group := f"tensor-{rounds}", "")
        tensor.complete_tensor(odd_panel(spark)[0], ["a", "b", "c"], rank=2, rounds=rounds, tolerance=0.0)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(40) == jobs(1)
    places = np.array([0, 1], np.int32).tobytes()
    x = np.random.default_rng(2).normal(size=(300, 2))
    some = [np.frombuffer(v) for batch in tensor._condensed((places, row[None]) for row in x) for v in batch.column("x").to_pylist()]
    assert len(some) == 2 and np.allclose(np.stack(some).T @ np.stack(some), x.T @ x)
