"""CRITIC on known matrices, regimes and gaps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwise.operators import critic as C
from panelwise.operators import stability as S
from panelwise.panel import Hierarchy, Panel
from panelwise.session import settle


def critic_numpy(x):
    sd = x.std(axis=0, ddof=1)
    r = np.corrcoef(x.T)
    info = sd * (1 - r).sum(axis=0)
    return info / info.sum()


@pytest.fixture(scope="module")
def gap_panel(spark):
    """Criterion B is absent in the first two periods."""
    rng = np.random.default_rng(11)
    rows = []
    for p in range(1, 6):
        for e in range(12):
            v = rng.uniform(0, 3, 5).round(4).tolist()
            if p <= 2:
                v[2] = v[3] = v[4] = None
            if p == 4 and e == 3:
                v[0] = None
            rows.append((f"e{e:02d}", p, *v))
    df = spark.createDataFrame(rows, "entity string, period int, a1 double, a2 double, b1 double, b2 double, b3 double")
    return Panel(settle(df), Hierarchy({"A": ("a1", "a2"), "B": ("b1", "b2", "b3")}))


def test_matrix_weights(spark):
    x = np.random.default_rng(1).uniform(0, 1, (20, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = {r["indicator"]: r["weight"] for r in C.weigh(df, ["a", "b", "c", "d"]).collect()}
    assert [got[c] for c in "abcd"] == pytest.approx(critic_numpy(x).tolist())


def test_row_weights_of_one_change_only_the_divisor(spark):
    x = np.random.default_rng(2).uniform(0, 1, (15, 3))
    df = spark.createDataFrame([(*map(float, r), 2.0) for r in x], "a double, b double, c double, w double")
    plain = C.unpivot_weights(C.critic_matrix(df, ["a", "b", "c"]), [], ["a", "b", "c"])
    heavy = C.unpivot_weights(C.critic_matrix(df, ["a", "b", "c"], row_weight="w"), [], ["a", "b", "c"])
    a, b = ({r["indicator"]: r["weight"] for r in d.collect()} for d in (plain, heavy))
    assert a == pytest.approx(b)


def test_degenerate_matrices(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert {r["weight"] for r in C.weigh(one, ["a", "b"]).collect()} == {0.5}
    flat = spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double")
    assert [r["weight"] for r in C.weigh(flat, ["a", "b"]).collect()] == pytest.approx([0.5, 0.5])
    half = spark.createDataFrame([(float(i), 2.0) for i in range(4)], "a double, b double")
    assert sum(r["weight"] for r in C.weigh(half, ["a", "b"]).collect()) == pytest.approx(1)


def test_regimes(gap_panel):
    w = C.two_level_weights(gap_panel)
    rows = {r["regime"]: r for r in w.regimes.collect()}
    assert set(rows) == {"10", "11"}
    assert rows["10"]["crit_A"] == pytest.approx(1.0) and rows["10"]["crit_B"] == 0
    assert (rows["10"]["n_rows"], rows["11"]["n_rows"]) == (24, 35)
    long = w.long().collect()
    assert sum(r["weight"] for r in long) == pytest.approx(1)
    assert sum(r["local_weight"] for r in long if r["criterion"] == "B") == pytest.approx(1)


def test_weights_per_period(gap_panel):
    w = C.two_level_weights(gap_panel, per_period=True)
    by = {(r["fit"], r["criterion"]): r["weight"] for r in w.criteria_long().collect()}
    assert by[(1, "B")] == 0 and by[(1, "A")] == pytest.approx(1)
    for p in range(1, 6):
        assert by[(p, "A")] + by[(p, "B")] == pytest.approx(1)


def test_perturbation_is_reproducible(spark):
    weights = spark.createDataFrame([(y, k, v) for y in (1, 2) for k, v in zip("abcd", (0.1, 0.2, 0.3, 0.4))], "fit int, criterion string, weight double")
    a = S.weight_sensitivity(weights, seed=1, replicates=20)[0].orderBy("tier").collect()
    b = S.weight_sensitivity(weights.repartition(5), seed=1, replicates=20)[0].orderBy("tier").collect()
    assert [(r["tier"], r["robustness"]) for r in a] == [(r["tier"], r["robustness"]) for r in b]
    by = {r["tier"]: r for r in a}
    assert by["conservative"]["mean_disruption"] <= by["aggressive"]["mean_disruption"]
    assert all(0 <= r["min_disruption"] <= r["max_disruption"] <= 1 for r in a)
    flat = weights.withColumn("weight", F.lit(0.25))
    assert S.weight_sensitivity(flat, seed=1, replicates=5)[0].count() == 0


def test_compat_form_runs(spark):
    weights = spark.createDataFrame([(1, k, v) for k, v in zip("abcd", (0.1, 0.2, 0.3, 0.4))], "fit int, criterion string, weight double")
    tiers, per = S.weight_sensitivity(weights, seed=1, replicates=10, compat=True)
    assert tiers.count() == 3 and per.count() == 12
    assert S.most_sensitive(per, 2).count() == 6


def test_windows(spark):
    rows = [(y, k, v) for y in range(6) for k, v in zip("abc", (0.2, 0.3, 0.5))]
    w = S.window_means(spark.createDataFrame(rows, "fit int, criterion string, weight double"))
    assert S.consecutive_rho(w).first()["rho"] == pytest.approx(1)
    assert S.windows_kendall_w(w).first()["kendall_w"] == pytest.approx(1)


def test_numpy_agrees_on_two_levels(gap_panel):
    """The pooled run by NumPy, regime by regime."""
    pdf = gap_panel.data.toPandas()
    early = pdf["period"] <= 2
    rows = pdf[(early & pdf[["a1", "a2"]].notna().all(axis=1)) | pdf.notna().all(axis=1)]
    unit = lambda d: (d - d.min()) / (d.max() - d.min())
    local = {"A": critic_numpy(unit(rows[["a1", "a2"]]).to_numpy()), "B": critic_numpy(unit(rows[["b1", "b2", "b3"]].dropna()).to_numpy())}
    z = pd.DataFrame({"A": rows[["a1", "a2"]] @ local["A"], "B": rows[["b1", "b2", "b3"]] @ local["B"]})
    full = z.dropna()
    second = critic_numpy(unit(full).to_numpy())
    n1, n2 = len(z) - len(full), len(full)
    want_a = (n1 * 1.0 + n2 * second[0]) / (n1 + n2)
    got = {r["criterion"]: r["weight"] for r in C.two_level_weights(gap_panel).criteria_long().collect()}
    assert got["A"] == pytest.approx(want_a)
