"""No row, column or group is lost: files of different width, NULL groups, incomplete rows, long panels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise import session
from panelwise.operators import features as X
from panelwise.operators import models as M
from panelwise.operators import ordered as O
from panelwise.operators.stacking import importance_weights
from panelwise.panel import Hierarchy
from panelwise.sources.files import read_period_files


@pytest.mark.parametrize("wide_first", [True, False])
def test_files_of_different_width(spark, tmp_path, wide_first):
    wide = "entity,a,b\nx,1,2\nentity,3,4\n"
    narrow = "b,entity\n" + "".join(f"{i},y{i}\n" for i in range(50))
    (tmp_path / "2000.csv").write_text(wide if wide_first else narrow)
    (tmp_path / "2001.csv").write_text(narrow if wide_first else wide)
    rows = read_period_files(spark, str(tmp_path), Hierarchy({"K": ("a", "b")}, frozenset())).data.collect()
    got = {(r["entity"], r["period"]): (r["a"], r["b"]) for r in rows}
    assert len(rows) == len(got) == 52
    year = 2000 if wide_first else 2001
    assert got["x", year] == (1.0, 2.0) and got["entity", year] == (3.0, 4.0) and got["y7", 4001 - year] == (None, 7.0)


def test_null_groups_rank_alike_on_both_paths(spark):
    df = spark.createDataFrame([(i, None if i % 3 else 1, float(i % 5)) for i in range(30)], "id int, g int, v double")
    spec = {"r": ("v", True, "truncated")}
    plain = {r["id"]: r["r"] for r in O.add_ranks(df, ["g"], spec).collect()}
    split = {r["id"]: r["r"] for r in O.add_ranks(df, ["g"], spec, limit=1).collect()}
    assert plain == split and None not in plain.values()
    for limit in (None, 1):
        found = {r["g"]: r["half"] for r in O.group_quantiles(df, ["g"], "v", {"half": 0.5}, limit=limit).collect()}
        assert set(found) == {None, 1}


def test_every_row_gets_an_answer(spark):
    rows = [(float(i), None if i % 4 == 0 else float(i * i % 7), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    got = M.elastic_net(df, ["a", "b"], "y").predict(df).collect()
    assert len(got) == 40 and sum(r["yhat"] is None for r in got) == 10
    weighted = importance_weights(df.withColumn("new", F.col("a") >= 30), ["a", "b"], "new").collect()
    assert len(weighted) == 30 and all(r["importance_weight"] is not None for r in weighted)


def test_weighted_means_of_a_long_panel(spark):
    rng = np.random.default_rng(1)
    values = [None if p % 7 == 3 or 300 < p < 900 else float(v) for p, v in enumerate(rng.normal(size=1500))]
    grid = spark.createDataFrame([(1, p, p, v) for p, v in enumerate(values)], "entity long, period int, position int, v double")
    got = [r["v_ewma3"] for r in X.trend_features(grid, ["v"], (3,)).orderBy("period").collect()]
    top = weight = 0.0
    for p, v in enumerate(values):
        top, weight = top / 2, weight / 2
        if v is not None:
            top, weight = top + v, weight + 1
        if weight > 1e-300 and (p < 850 or p > 905):
            assert got[p] == pytest.approx(top / weight, rel=1e-9)
    assert all(g is not None and np.isfinite(g) for g in got)


def test_release_deletes_settled_tables(spark):
    session.release(spark)
    df = session.settle(spark.range(5))
    assert df.count() == 5 and session.release(spark) == 1 and session.release(spark) == 0
