"""Files, views, scaling, missing values, features on literal inputs."""

import math

import pytest
from pyspark.sql import functions as F

from panelwise.functions.special import chi2_tail, t_cdf, t_quantile
from panelwise.operators import features as X
from panelwise.operators import missing as J
from panelwise.operators import scaling as Z
from panelwise.operators import views as V
from panelwise.panel import Hierarchy, Panel
from panelwise.sources.files import check_unique, hierarchy_from, read_codebook, read_period_files, read_prediction_matrix, write_all

H = Hierarchy({"A": ("a1", "a2"), "B": ("b1",)})


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "2020.csv").write_text("entity,a1,a2,b1\nx, 1 ,2,3\ny,4,oops,\n ,9,9,9\n")
    (tmp_path / "2021.csv").write_text("entity,b1,a1\nx,7,0.0\nz,nan,5\n")
    (tmp_path / "book.csv").write_text("code,name,criterion\n a1 ,n1,A\na2,n2,A\nb1,n3,B\n,,\n")
    return str(tmp_path)


def test_read_files(spark, files):
    book = read_codebook(spark, f"{files}/book.csv", ["code", "criterion"])
    assert hierarchy_from(book, "code", "criterion") == H
    with pytest.raises(ValueError, match="lacks"):
        read_codebook(spark, f"{files}/book.csv", ["other"])
    panel = check_unique(read_period_files(spark, files, H))
    rows = {(r["entity"], r["period"]): (r["a1"], r["a2"], r["b1"]) for r in panel.data.collect()}
    assert rows == {("x", 2020): (1, 2, 3), ("y", 2020): (4, None, None), ("x", 2021): (0, None, 7), ("z", 2021): (5, None, None)}
    twice = panel.with_data(panel.data.unionByName(panel.data))
    with pytest.raises(ValueError, match="duplicate"):
        check_unique(twice)


def test_prediction_matrix_and_sinks(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,K1,K2\n x ,1.5,bad\ny,2,3\n")
    m = read_prediction_matrix(spark, str(tmp_path / "p.csv"))
    assert sorted(tuple(r) for r in m.collect()) == [("x", 1.5, None), ("y", 2.0, 3.0)]
    for fmt in ("parquet", "csv", "json"):
        manifest = write_all({"m": m}, str(tmp_path / fmt), fmt, digits=4)
        assert [(r["name"], r["n_rows"]) for r in manifest.collect()] == [("m", 2)]


def test_views(spark, files):
    panel = read_period_files(spark, files, H)
    assert {(r["period"], r["criterion"], r["entity"]) for r in V.complete_cases(panel).collect()} == {
        (2020, "A", "x"), (2020, "B", "x"), (2021, "A", "x"), (2021, "A", "z"), (2021, "B", "x")}
    report = {r["period"]: r for r in V.availability_report(panel).collect()}
    assert report[2021]["excluded_indicators"] == "a2" and report[2020]["excluded_indicators"] == ""
    with pytest.raises(ValueError, match="too small"):
        V.prepare_matrix(panel.data, panel.indicators, ["period"], min_rows=5)


def test_fill_and_scaling(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0), (3, 3.0, 4.0)], "entity int, a double, b double")
    assert [r["b"] for r in J.fill_with_means(df, ["a", "b"]).orderBy("entity").collect()] == [3.5, 3.0, 4.0]
    flat = spark.createDataFrame([(1, 1, 1.0, 5.0), (2, 1, 2.0, 5.0), (3, 1, 3.0, 5.0)], "entity int, period int, a double, b double")
    saw = Z.period_min_max(flat, ["a", "b"], ["period"]).orderBy("entity").collect()
    assert [(r["a"], r["b"]) for r in saw] == [(0, 0), (0.5, 0), (1, 0)]
    rank = Z.ranking_min_max(flat, ["a", "b"], ["period"]).orderBy("entity").collect()
    assert [(r["a"], r["b"]) for r in rank] == [(0, 0.5), (0.5, 0.5), (1, 0.5)]


def test_power_transform(spark):
    df = spark.createDataFrame([(float(math.exp(i / 10)),) for i in range(60)], "x double")
    fit = Z.fit_yeo_johnson(df, "x")
    z = df.select(Z.apply_yeo_johnson(F.col("x"), fit).alias("z"), "x")
    back = z.select("x", Z.undo_yeo_johnson(F.col("z"), fit).alias("b")).collect()
    assert all(r["x"] == pytest.approx(r["b"]) for r in back)
    row = z.agg(F.avg("z"), F.stddev_pop("z"), F.skewness("z")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1) and abs(row[2]) < 0.3


def test_interpolation(spark):
    rows = [("a", p, v) for p, v in enumerate([None, 1.0, None, None, 4.0, None])]
    df = spark.createDataFrame(rows, "entity string, period int, v double")
    assert [r["v"] for r in J.interpolate(df, ["v"]).orderBy("period").collect()] == [1, 1, 2, 3, 4, 4]


def test_chained_equations_recover_a_line(spark):
    rows = [(i, 1, float(i), None if i % 7 == 3 else 2.0 * i + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "entity int, period int, x double, y double")
    out = J.chained_equations(df, ["x", "y"], rounds=8).orderBy("entity").collect()
    for r in out:
        assert r["y"] == pytest.approx(2.0 * r["entity"] + 1, abs=0.3)
    kept = J.kept_cells_changed(df, J.chained_equations(df, ["x", "y"], rounds=2), ["x", "y"])
    assert kept.count() == 0


def test_low_rank_fill(spark):
    rows = [(i, 1, float(i), 2.0 * i, None if i == 5 else 3.0 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "entity int, period int, a double, b double, c double")
    got = {r["entity"]: r["c"] for r in J.soft_impute(df, ["a", "b", "c"], shrink=0.05, rounds=20).collect()}
    assert got[4] == 12.0 and abs(got[5] - 15.0) < 6


def test_distribution_functions():
    assert chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5)
    assert t_cdf(0.0, 3) == pytest.approx(0.5)


def test_dense_grid_and_lags(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("b", 2, 5.0)], "entity string, period int, v double")
    grid = X.dense(df, ["v"])
    assert grid.count() == 6
    lag = {(r["entity"], r["period"]): (r["v_lag1"], r["v_lag1_missing"]) for r in X.lag_features(grid, ["v"]).collect()}
    assert lag[("a", 2)] == (1.0, 0) and lag[("a", 3)] == (5.0, 1) and lag[("b", 1)] == (1.0, 1)


def test_settle_needs_a_shared_folder(spark, monkeypatch):
    from panelwise import session

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("S", (), {"master": "yarn", "applicationId": "x", "getCheckpointDir": staticmethod(lambda: None)})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Cluster())
    assert "shared" in session.shared_folder(spark)


def test_panel_round_trip(spark):
    from panelwise.panel import to_wide

    df = spark.createDataFrame([("a", 1, 1.0, None, 2.0)], "entity string, period int, a1 double, a2 double, b1 double")
    assert to_wide(Panel(df, H).long(), H.indicators).collect() == df.collect()


def test_tensor_completion(spark):
    """A rank-one array with holes is filled close to the truth; seen cells stay."""
    from panelwise.operators.tensor import complete_tensor

    truth = {(e, p): [(1 + e) * (2 + p) * w for w in (1.0, 0.5, 2.0)] for e in range(12) for p in range(6)}
    rows = [(e, p, *(None if (e + p + j) % 9 == 4 else v for j, v in enumerate(vs))) for (e, p), vs in truth.items()]
    df = spark.createDataFrame(rows, "entity int, period int, a double, b double, c double")
    out = complete_tensor(df, ["a", "b", "c"], rank=2, rounds=20, penalty=0.01)
    for r in out.collect():
        for name, v in zip("abc", truth[(r["entity"], r["period"])]):
            assert r[name] == pytest.approx(v, rel=0.25, abs=2.0)
    assert J.kept_cells_changed(df, out, ["a", "b", "c"]).count() == 0
