import numpy as np

from panelwise.functions.fourier import frequencies, waves
from panelwise.operators.local_intervals import locally_weighted
from panelwise.operators.tube_fit import bounding, epsilon_insensitive


def test_waves_approach_the_kernel():
    r = np.random.default_rng(0)
    a = r.normal(size=(30, 3))
    want = np.exp(-((a[:, None] - a[None]) ** 2).sum(axis=2) / (2 * 1.5**2))
    w = waves(a, frequencies(3, 512, 1.5))
    assert np.abs(w @ w.T - want).max() < 0.1


def test_parabola_touches_and_bounds():
    r = np.linspace(-3, 3, 601)
    loss = np.maximum(np.abs(r) - 0.1, 0)
    for at in (-2.0, -0.05, 0.0, 0.3, 1.7):
        w, c = bounding(np.array([at]), 0.1)
        gap = w * (r - c) ** 2 - loss
        assert gap.min() >= (w * (at - c) ** 2 - max(abs(at) - 0.1, 0))[0] - 1e-9


def plain_objective(z, y, cost, epsilon, rounds=5000, rho=1.0):
    """Alternating directions with the loss's proximal step."""
    ridge = np.eye(z.shape[1])
    ridge[0, 0] = 1e-9
    inverse = np.linalg.inv(rho * z.T @ z + ridge)
    s, u = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(rounds):
        b = inverse @ (rho * z.T @ (y - s + u))
        v = y - z @ b + u
        over = np.abs(v) - epsilon
        s = np.where(over <= 0, v, np.sign(v) * (epsilon + np.maximum(over - cost / rho, 0)))
        u = v - s
    return cost * np.maximum(np.abs(y - z @ b) - epsilon, 0).sum() + b[1:] @ b[1:] / 2


def test_loss_against_a_plain_solver(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=(300, 2)) * [1, 10]
    y = np.sin(a[:, 0]) * 3 + 0.1 * a[:, 1] + 0.3 * r.standard_t(2, size=300)
    rows = [(i, float(p), float(q), None if i % 10 == 0 else float(t), None) for i, ((p, q), t) in enumerate(zip(a, y))]
    df = spark.createDataFrame([*rows, (999, None, 1.0, 2.0, None)], "id int, a double, b double, y double, none double").repartition(3)
    predictions, fits = epsilon_insensitive(df, ["a", "b"], ["y", "none"], number=10, tolerance=1e-5)
    got = {f["target"]: f for f in fits.collect()}
    v = (a - a.mean(0)) / a.std(0)
    has = np.arange(300) % 10 != 0
    # the operator scales by all rows with features; the target by its known values among them
    t = (y[has] - y[has].mean()) / y[has].std()
    z = np.column_stack([np.ones(300), waves(v, frequencies(2, 10, 1.0))])[has]
    want = plain_objective(z, t, 1.0, 0.1)
    assert got["y"]["n"] == 270 and got["none"]["n"] == 0
    assert want * 0.999 <= got["y"]["objective"] <= want * 1.01
    out = {p["id"]: p for p in predictions.collect()}
    assert len(out) == 301 and out[999]["yhat_y"] is None and all(p["yhat_none"] is None for p in out.values())
    assert np.median([abs(out[i]["yhat_y"] - y[i]) for i in range(300)]) < 0.6


def test_local_widths_against_the_exact_kernel(spark):
    r = np.random.default_rng(3)
    n = 600
    a = r.normal(size=(n, 2))
    res = r.normal(size=n) * np.where(a[:, 0] > 0, 1.0, 0.2) * 1e6
    cal = [("m", int(i % 60), int(i // 60), float(p), float(q), float(e), 0.0) for i, ((p, q), e) in enumerate(zip(a, res))]
    schema = "model string, entity int, period int, a double, b double, y double, yhat double"
    asked = [("m", i, 10, float(a[i, 0]), float(a[i, 1]), None, 1.0) for i in range(30)]
    asked += [("m", 1000, 10, 500.0, 0.0, None, 1.0), ("m", 1001, 10, None, 0.0, None, 1.0), ("other", 1, 10, 0.0, 0.0, None, 1.0)]
    got = locally_weighted(spark.createDataFrame(cal, schema).repartition(3), spark.createDataFrame(asked, schema), ["a", "b"], ["model"], 0.2).collect()
    out = {(g["model"], g["entity"]): g for g in got}
    assert len(out) == 33 and out["m", 1001]["half_width"] is None and out["other", 1]["half_width"] is None
    v = (a - a.mean(0)) / a.std(0)
    absolute = np.abs(res)
    far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    h = np.median(far[np.triu_indices(n, 1)])
    for i in range(30):
        w = np.exp(-far[i] ** 2 / (2 * h * h)) * np.where(np.arange(n) % 60 == i, 2.0, 1.0)
        width = out["m", i]["half_width"]
        assert abs(w[absolute <= width].sum() / w.sum() * n / (n + 1) - 0.8) < 0.05  # the weighted share that the width covers
        assert out["m", i]["upper"] == 1.0 + width
    plain = np.sort(absolute)[int(np.ceil(0.8 * (n + 1))) - 1]
    assert plain <= out["m", 1000]["half_width"] <= plain * 1.2
    assert np.mean([out["m", i]["half_width"] for i in range(30) if a[i, 0] > 1]) > np.mean([out["m", i]["half_width"] for i in range(30) if a[i, 0] < -1])
