import numpy as np
import pytest

from panelwise.operators import neighbours
from panelwise.operators.missing import impute_panel
from panelwise.operators.neighbours import nearest_entities

COLUMNS = ["x", "y", "z", "w"]
SCHEMA = "entity string, period int, x double, y double, z double, w double, note string"


def rows(n=90, seed=3):
    r = np.random.default_rng(seed)
    out = []
    for period in (1, 2, 4):
        base = np.round(r.normal(size=(n, 4)) + r.integers(0, 3, (n, 1)) * 4, 1)  # clusters, and ties
        base[r.random((n, 4)) < 0.2] = np.nan
        base[5:9] = base[4]  # equal rows
        if period == 4:
            base[:, 3] = np.nan  # a column that the period lacks
        base[0] = np.nan
        out += [(f"e{i:03d}", period, *[None if np.isnan(v) else float(v) for v in row], "n") for i, row in enumerate(base)]
    return out


def plain(table, donors, k):
    """All distances, row by row."""
    value = lambda t: np.array([[np.nan if v is None else v for v in r[2:6]] for r in t])
    q, d = value(table), value(donors)
    sd = np.nanstd(d, axis=0)
    known = sorted({r[1] for r in donors})
    out = q.copy()
    for i, r in enumerate(table):
        period = min(known, key=lambda y: (abs(y - r[1]), y))
        mine = [j for j, s in enumerate(donors) if s[1] == period]
        for c in np.flatnonzero(np.isnan(q[i])):
            near = []
            for j in mine:
                both = ~np.isnan(q[i]) & ~np.isnan(d[j])
                if not np.isnan(d[j, c]) and both.any():
                    near.append((round((((q[i] - d[j]) / sd)[both] ** 2).sum() * 4 / both.sum(), 9), donors[j][0], d[j, c]))
            if near:
                out[i, c] = np.mean([v for *_, v in sorted(near)[:k]])
    return {(r[0], r[1]): out[i] for i, r in enumerate(table)}


def check(got, want):
    got = got.collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose([np.nan if r[c] is None else r[c] for c in COLUMNS], want[r["entity"], r["period"]], equal_nan=True, atol=1e-9)


@pytest.mark.parametrize("size,k", [(512, 5), (6, 3), (6, 40)])
def test_nearest_against_all_distances(spark, size, k):
    table = rows()
    check(nearest_entities(spark.createDataFrame(table, SCHEMA).repartition(4), COLUMNS, k, rows_per_block=size, first=1), plain(table, table, k))


def test_periods_that_donors_lack(spark):
    table, donors = rows(seed=3), [r for r in rows(seed=8) if r[1] != 2]
    check(nearest_entities(spark.createDataFrame(table, SCHEMA), COLUMNS, 4, spark.createDataFrame(donors, SCHEMA), rows_per_block=16), plain(table, donors, 4))


def test_far_blocks_never_meet(spark, monkeypatch):
    """With clusters far apart most pairs of blocks are ruled out."""
    r = np.random.default_rng(2)
    table = [(f"e{i:04d}", 1, *(r.normal(size=3) + 1000.0 * (i % 8)).tolist(), None if i % 5 == 0 else 1.0 * i, "n") for i in range(800)]
    met = []
    old = neighbours.meet

    def counted(pairs, *rest):
        met.append(pairs.select("block", "cell").distinct().count())
        return old(pairs, *rest)

    monkeypatch.setattr(neighbours, "meet", counted)
    df = spark.createDataFrame(table, SCHEMA).coalesce(1)
    check(nearest_entities(df, COLUMNS, 3, rows_per_block=20), plain(table, table, 3))
    assert sum(met) < 8 * 32 / 2


def test_nothing_to_fill_and_empty(spark):
    full = [(f"e{i}", 1, 1.0 * i, 2.0, 3.0, 4.0, "n") for i in range(5)]
    df = spark.createDataFrame(full, SCHEMA)
    assert sorted(map(tuple, nearest_entities(df, COLUMNS).collect())) == full
    assert nearest_entities(df.limit(0), COLUMNS).count() == 0


def test_panel_imputation_uses_neighbours(spark):
    table = [("a", 1, 1.0, None, 5.0, 1.0, "n"), ("b", 1, 1.1, 7.0, 5.0, 1.0, "n"), ("c", 1, 9.0, 70.0, 50.0, 9.0, "n")]
    got = {r["entity"]: r["y"] for r in impute_panel(spark.createDataFrame(table, SCHEMA), COLUMNS, k=1).collect()}
    assert got == pytest.approx({"a": 7.0, "b": 7.0, "c": 70.0})
