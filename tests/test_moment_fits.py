import numpy as np
import pytest

from panelwise.operators import moment_fits as K, models as M
from panelwise.operators.evaluate import metric_summary
from panelwise.operators.splits import walk_forward

X = ["a", "b", "c"]


def table(spark, n=40, periods=7):
    r = np.random.default_rng(4)
    out = []
    for e in range(n):
        for t in range(periods):
            a, b, c = r.normal(size=3) * [1, 5, 0.1] + [0, 1000, 3]
            y = 2 * a - 0.1 * b + 4 * c + 0.3 * r.normal()
            z = a + 0.02 * b + 0.3 * r.normal()
            out.append((e, t, float(a), float(b), float(c), None if r.random() < 0.1 else float(y), None if r.random() < 0.3 else float(z)))
    out.append((n, 0, None, 1.0, 1.0, 2.0, None))
    return spark.createDataFrame(out, "entity int, period int, a double, b double, c double, y double, z double").repartition(3)


def arrays(df, columns):
    rows = sorted(df.collect(), key=lambda r: (r["entity"], r["period"]))
    return np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in rows], float)


def test_grid_against_a_fit_for_each_setting_and_fold(spark):
    df = table(spark)
    got = {(r["setting"], r["fold"]): r for r in K.penalty_grid(df, X, "y", max_folds=2).collect()}
    tagged = walk_forward(df.where("y IS NOT NULL"), "period", 3, 2)
    assert len(got) == 18
    settings = [(p, l) for p in (0.001, 0.01, 0.1) for l in (0.1, 0.5, 0.9)]
    for i in (0, 4, 8):
        for fold in (0, 1):
            part = tagged.where(f"fold = {fold}")
            model = M.elastic_net(part.where("role = 'train'"), X, "y", *settings[i])
            want = metric_summary(model.predict(part.where("role = 'validate'")).select("y", "yhat")).first()
            row = got[i, fold]
            assert (row["penalty"], row["l1"]) == settings[i] and row["n"] == want["n"]
            assert row["r2"] == pytest.approx(want["r2"], abs=1e-5) and row["rmse"] == pytest.approx(want["rmse"], rel=1e-4)


def test_joint_descent_against_proximal_steps():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 6)) @ r.normal(size=(6, 6))
    y = x[:, :2] @ r.normal(size=(2, 3)) + 0.1 * r.normal(size=(200, 3))
    gram, target = x.T @ x / 200, x.T @ y / 200
    l21, l2 = 0.4, 0.05
    b, step = np.zeros((6, 3)), 1 / (np.linalg.eigvalsh(gram).max() + l2)
    for _ in range(20_000):
        moved = b - step * (gram @ b - target + l2 * b)
        norm = np.linalg.norm(moved, axis=1, keepdims=True)
        b = np.maximum(1 - step * l21 / np.maximum(norm, 1e-300), 0) * moved
    got = K.joint_descent(gram, target, l21, l2)
    assert np.allclose(got, b, atol=1e-6) and (np.abs(got).sum(axis=1) == 0).any()


def test_multi_task_weights_and_units(spark):
    df = table(spark)
    predictions, coefficients = K.multi_task_elastic_net(df, X, ["y", "z"], 1e-9)
    data = arrays(df, [*X, "y", "z"])
    data = data[~np.isnan(data[:, :3]).any(axis=1)]
    weight = (~np.isnan(data[:, 3:])).mean(axis=1)
    keep = weight > 0
    means = np.nanmean(arrays(df, ["y", "z"]), axis=0)
    targets = np.where(np.isnan(data[:, 3:]), means, data[:, 3:])[keep]
    design = np.column_stack([np.ones(keep.sum()), data[keep, :3]])
    root = np.sqrt(weight[keep])[:, None]
    want = np.linalg.lstsq(design * root, targets * root, rcond=None)[0]
    table_ = {(r["target"], r["feature"]): r for r in coefficients.collect()}
    for k, t in enumerate(["y", "z"]):
        assert [table_[t, f]["coefficient"] for f in ["(intercept)", *X]] == pytest.approx(want[:, k].tolist(), rel=1e-4)
        loss = (weight[keep] * (targets[:, k] - design @ want[:, k]) ** 2).sum() / weight[keep].sum()
        assert table_[t, "a"]["sigma"] == pytest.approx(np.sqrt(loss), rel=1e-4)
    rows = predictions.collect()
    assert len(rows) == df.count() and sum(r["yhat_y"] is None for r in rows) == 1
    sparse = K.multi_task_elastic_net(df, X, ["y", "z"], 0.6, 1.0)[1].collect()
    dropped = {t: {r["feature"] for r in sparse if r["target"] == t and r["coefficient"] == 0} for t in ("y", "z")}
    assert dropped["y"] == dropped["z"] and dropped["y"]


def test_downdating_equals_refitting(spark):
    df = table(spark, n=12, periods=4)
    got = sorted(map(tuple, K.leave_one_entity_out(df, X, "y", 2.0).collect()))
    rows = sorted((r["entity"], r["period"], r["a"], r["b"], r["c"], r["y"]) for r in df.collect() if r["y"] is not None and r["a"] is not None)
    data = np.array(rows)
    v = (data[:, 2:] - data[:, 2:].mean(0)) / data[:, 2:].std(0)
    want = []
    for e in sorted(set(data[:, 0])):
        o, m = v[data[:, 0] != e], v[data[:, 0] == e]
        c = o - o.mean(0)
        beta = np.linalg.solve(c[:, :3].T @ c[:, :3] + 2.0 * np.eye(3), c[:, :3].T @ c[:, 3])
        want += ((o.mean(0)[3] + (m[:, :3] - o.mean(0)[:3]) @ beta) * data[:, 5].std() + data[:, 5].mean()).tolist()
    assert [g[:2] for g in got] == [r[:2] for r in rows] and [g[2] for g in got] == pytest.approx([r[5] for r in rows])
    assert [g[3] for g in got] == pytest.approx(want, rel=1e-8)


def test_one_entity_and_empty(spark):
    df = table(spark)
    one = K.leave_one_entity_out(df.where("entity = 3"), X, "y").collect()
    assert one and all(r["yhat"] is None for r in one)
    assert K.leave_one_entity_out(df.limit(0), X, "y").count() == 0
    assert K.penalty_grid(df.limit(0), X, "y").count() == 0
