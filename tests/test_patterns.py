import numpy as np
import pytest

from panelwise.operators import missing as J

COLUMNS = ["x", "y", "z"]


def table(n=60, seed=5):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, 1)) + 0.4 * r.normal(size=(n, 3))
    base[:, 1] = 3.0 * base[:, 1] + 7.0
    base[r.random((n, 3)) < 0.25] = np.nan
    base[0] = np.nan
    return base


def panel(spark, cells):
    rows = [(i // 4, i % 4, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(cells)]
    return spark.createDataFrame(rows, "entity int, period int, x double, y double, z double").repartition(3)


def cells_of(df, columns=COLUMNS):
    rows = sorted(df.collect(), key=lambda r: (r["entity"], r["period"]))
    return np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in rows])


def plain_chain(x, rounds, penalty=1e-3, tolerance=1e-4):
    """The rounds over all rows."""
    gaps, mean, sd = np.isnan(x), np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z = (np.where(gaps, np.nanmedian(x, axis=0), x) - mean) / sd
    for _ in range(rounds):
        new = z.copy()
        for c in sorted(range(x.shape[1]), key=lambda c: gaps[:, c].sum()):
            o = [i for i in range(x.shape[1]) if i != c]
            a, y = new[~gaps[:, c]][:, o], new[~gaps[:, c], c]
            cov = np.cov(a.T, ddof=0).reshape(len(o), len(o)) + penalty * np.eye(len(o))
            beta = np.linalg.solve(cov, ((a - a.mean(0)) * (y - y.mean())[:, None]).mean(0))
            new[gaps[:, c], c] = y.mean() + (new[gaps[:, c]][:, o] - a.mean(0)) @ beta
        change = np.sqrt(((new - z) ** 2).sum() / z.size)
        z = new
        if change < tolerance:
            break
    return z * sd + mean, change


@pytest.mark.parametrize("numbers", [None, 0])
@pytest.mark.parametrize("rounds", [3, 400])
def test_chained_equations_against_rounds_over_rows(spark, numbers, rounds):
    if numbers == 0 and rounds > 3:
        rounds = 6
    x = table()
    want, change = plain_chain(x, rounds)
    got = J.chained_equations(panel(spark, x), COLUMNS, rounds, change_as="last", numbers=numbers)
    assert np.allclose(cells_of(got), want, atol=1e-8)
    assert got.first()["last"] == pytest.approx(change, abs=1e-9)
    assert rounds < 400 or change < 1e-4


def plain_soft(x, period, shrink, rounds, tolerance=1e-4):
    gaps = np.isnan(x)
    mean, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z = np.where(gaps, 0.0, (x - mean) / sd)
    for _ in range(rounds):
        new = z.copy()
        for p in set(period):
            mine = period == p
            u, s, v = np.linalg.svd(z[mine], full_matrices=False)
            low = u @ np.diag(np.maximum(s - shrink * s.max(), 0)) @ v
            new[mine] = np.where(gaps[mine], low, z[mine])
        change = np.sqrt(((new - z) ** 2).sum() / len(z))
        z = new
        if change < tolerance:
            break
    return z * sd + mean


@pytest.mark.parametrize("numbers", [None, 0])
def test_soft_impute_against_singular_values(spark, numbers):
    x = table()
    rounds = 4 if numbers == 0 else 500
    got = J.soft_impute(panel(spark, x), COLUMNS, 0.3, rounds, change_as="last", numbers=numbers)
    assert np.allclose(cells_of(got), plain_soft(x, np.arange(len(x)) % 4, 0.3, rounds), atol=1e-7)
    assert numbers == 0 or got.first()["last"] < 1e-4


def test_imputations_vary_as_their_posterior(spark):
    """Drawn coefficients scatter about the fit with the variance of a regression."""
    r = np.random.default_rng(1)
    a = r.normal(size=(400, 2))
    y = 1 + a @ [2.0, -1.0] + 0.5 * r.normal(size=400)
    m = np.column_stack([np.ones(400), a, y])
    m = m.T @ m
    draws = [J.drawn_fit(m, 2, 0.0, np.random.default_rng([s, 2])) for s in range(4000)]
    slopes, variance = np.array([d[1] for d in draws]), np.array([d[2] for d in draws])
    design = np.column_stack([np.ones(400), a])
    beta, loss, *_ = np.linalg.lstsq(design, y, rcond=None)
    s2 = loss[0] / (400 - 3)
    want = s2 * np.linalg.inv(design.T @ design)
    assert np.allclose(slopes.mean(0), beta[1:], atol=0.005)
    assert np.allclose(np.cov(slopes.T), want[1:, 1:], rtol=0.12, atol=1e-5)
    assert variance.mean() == pytest.approx(s2 * 397 / 395, rel=0.02)


def test_multiple_imputations(spark):
    x = table(240)
    df = panel(spark, x)
    stacked = J.multiple_imputations(df, COLUMNS, [1, 2, 3, 4], rounds=300, change_as="last")
    assert stacked.count() == 4 * 240
    parts = [cells_of(stacked.filter(f"imputation = {i}")) for i in range(4)]
    seen = ~np.isnan(x)
    assert not any(np.isnan(p).any() for p in parts) and all(np.allclose(p[seen], x[seen]) for p in parts)
    centre, _ = plain_chain(x, 300)
    spread = np.std([p[~seen] for p in parts], axis=0)
    assert (spread > 0).all()
    z = (np.mean(parts, axis=0) - centre)[~seen] / np.nanstd(x, axis=0)[np.nonzero(~seen)[1]]
    assert abs(z.mean()) < 0.15
    pooled = {r["term"]: r for r in J.pooled_regression(stacked, "z", ["x", "y"]).collect()}
    fits = [np.linalg.lstsq(np.column_stack([np.ones(240), p[:, :2]]), p[:, 2], rcond=None) for p in parts]
    for k, term in enumerate(["(intercept)", "x", "y"]):
        values = [f[0][k] for f in fits]
        assert pooled[term]["pooled"] == pytest.approx(np.mean(values)) and pooled[term]["between"] == pytest.approx(np.var(values, ddof=1))


def test_nothing_to_fill(spark):
    x = np.arange(12.0).reshape(4, 3)
    df = panel(spark, x)
    assert np.allclose(cells_of(J.chained_equations(df, COLUMNS)), x)
    assert J.multiple_imputations(df, COLUMNS, [1, 2]).count() == 8
    assert J.chained_equations(df.limit(0), COLUMNS).count() == 0
