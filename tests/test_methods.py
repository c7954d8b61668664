"""Hand-computed matrices, dominance, cost columns, degenerate groups."""

import math

import pytest
from pyspark.sql import functions as F

from panelwise.operators import combine as B
from panelwise.operators import methods as M
from panelwise.operators import promethee as P
from panelwise.plans.prediction import prediction_scores, rank_predictions

WEIGHTS = {"C1": 0.3, "C2": 0.7}


@pytest.fixture(scope="module")
def textbook(spark):
    return spark.createDataFrame([("A1", 1.0, 5.0), ("A2", 3.0, 3.0), ("A3", 5.0, 1.0)], "entity string, C1 double, C2 double")


@pytest.fixture(scope="module")
def dominated(spark):
    rows = [("A1", 0.9, 0.8, 0.7), ("A2", 0.6, 0.5, 0.5), ("A3", 0.3, 0.2, 0.1)]
    return spark.createDataFrame(rows, "entity string, C1 double, C2 double, C3 double")


@pytest.fixture(scope="module")
def with_cost(spark):
    rows = [("A", 0.9, 0.8, 0.2), ("B", 0.7, 0.6, 0.5), ("C", 0.5, 0.7, 0.8), ("D", 0.3, 0.4, 0.9)]
    return spark.createDataFrame(rows, "entity string, C1 double, C2 double, C3 double")


def by_entity(df, *cols):
    return {r["entity"]: tuple(r[c] for c in cols) for r in df.collect()}


def scaled(df, cols, weights):
    kept, w = M.place_weights(df, cols, [], weights)
    from panelwise.operators.passes import run_programs

    out, found = run_programs(kept, [], {"s": M.ranking_scale(cols, F.col, frozenset())})
    cells = [F.struct(F.lit(c).alias("indicator"), found["s"][c].alias("x"), w(c).alias("w")) for c in cols]
    return out.select("entity", F.inline(F.array(*cells)))


def test_topsis(textbook):
    got = by_entity(M.rank_matrix(textbook, "topsis", ["C1", "C2"], weights=WEIGHTS), "score", "d_pos", "rank")
    assert [round(got[a][0], 6) for a in ("A1", "A2", "A3")] == [0.70, 0.50, 0.30]
    assert got["A1"][1] * math.sqrt(35) == pytest.approx(1.2)
    assert got["A2"][1] * math.sqrt(35) == pytest.approx(math.sqrt(2.32))
    assert got["A3"][1] * math.sqrt(35) == pytest.approx(2.8)
    assert [got[a][2] for a in ("A1", "A2", "A3")] == [1, 2, 3]


def test_vikor(textbook):
    ranked = M.rank_matrix(textbook, "vikor", ["C1", "C2"], weights=WEIGHTS)
    got = by_entity(ranked, "S", "R", "Q")
    assert got["A1"] == pytest.approx((0.3, 0.3, 0.0))
    assert got["A2"] == pytest.approx((0.5, 0.35, 0.3125))
    assert got["A3"] == pytest.approx((0.7, 0.7, 1.0))
    rows = B.compromise_set(ranked.withColumn("g", F.lit(0)), ["g"], "entity").collect()
    assert sorted(r["entity"] for r in rows) == ["A1", "A2"]
    assert not rows[0]["advantage"] and rows[0]["stability"]


def test_edas(textbook):
    got = by_entity(M.rank_matrix(textbook, "edas", ["C1", "C2"], weights=WEIGHTS), "SP", "SN", "AS")
    assert got["A1"] == pytest.approx((7 / 15, 1 / 5, 11 / 14))
    assert got["A2"] == pytest.approx((0, 0, 0.5))
    assert got["A3"] == pytest.approx((1 / 5, 7 / 15, 3 / 14))


def test_copras(textbook):
    got = by_entity(M.rank_matrix(textbook, "copras", ["C1", "C2"], weights=WEIGHTS), "S_plus", "utility")
    assert got["A1"] == pytest.approx((38 / 90, 100))
    assert got["A2"] == pytest.approx((1 / 3, 78.947368), rel=1e-6)
    assert got["A3"] == pytest.approx((22 / 90, 57.894737), rel=1e-6)


def test_promethee_usual(textbook):
    out = P.flows(scaled(textbook, ["C1", "C2"], WEIGHTS), [], "entity", P.Preference("usual"))
    got = by_entity(out, "phi_plus", "phi_minus", "phi")
    assert got["A1"] == pytest.approx((0.7, 0.3, 0.4))
    assert got["A2"] == pytest.approx((0.5, 0.5, 0.0))
    assert got["A3"] == pytest.approx((0.3, 0.7, -0.4))


@pytest.mark.parametrize("method", sorted(M.METHODS))
def test_dominance(dominated, method):
    equal = {c: 1 / 3 for c in ("C1", "C2", "C3")}
    ranks = by_entity(M.rank_matrix(dominated, method, ["C1", "C2", "C3"], weights=equal), "rank")
    assert ranks["A1"][0] < ranks["A3"][0]


@pytest.mark.parametrize("method", sorted(M.METHODS))
def test_cost_column(with_cost, method):
    equal = {c: 1 / 3 for c in ("C1", "C2", "C3")}
    ranks = by_entity(
        M.rank_matrix(with_cost, method, ["C1", "C2", "C3"], weights=equal, cost=frozenset({"C3"})), "rank"
    )
    assert ranks["A"][0] == 1


@pytest.mark.parametrize("method", sorted(M.METHODS))
def test_one_row_and_one_column(textbook, method):
    one = M.rank_matrix(textbook.where("entity = 'A1'"), method, ["C1", "C2"], weights=WEIGHTS).collect()
    assert len(one) == 1 and one[0]["rank"] == 1
    assert len(M.rank_matrix(textbook, method, ["C1"], weights={"C1": 1.0}).collect()) == 3


def test_own_weights_and_groups(textbook):
    two = textbook.withColumn("g", F.lit(1)).unionByName(textbook.withColumn("g", F.lit(2)))
    rows = M.rank_matrix(two, "saw", ["C1", "C2"], ["g"]).collect()
    assert len(rows) == 6
    assert {r["score"] for r in rows if r["g"] == 1} == {r["score"] for r in rows if r["g"] == 2}


def test_truncated_ties(spark):
    df = spark.createDataFrame([(e, v) for e, v in zip("abcde", [3.0, 2.0, 2.0, 2.0, 1.0])], "entity string, C1 double")
    ranks = by_entity(M.rank_matrix(df, "saw", ["C1"], weights={"C1": 1.0}), "rank")
    assert [ranks[e][0] for e in "abcde"] == [1, 3, 3, 3, 5]


def test_prediction_ranking(dominated):
    rows = {r["entity"]: r for r in prediction_scores(dominated, ["C1", "C2", "C3"]).collect()}
    assert rows["A1"]["median"] > rows["A2"]["median"] > rows["A3"]["median"]
    assert [r["entity"] for r in rank_predictions(dominated, ["C1", "C2", "C3"], 2).orderBy("rank").collect()] == ["A1", "A2"]


def brute_flows(values, weight, pref):
    n = len(values)
    out = {}
    for a, x in values.items():
        plus = sum(pref(x - y) for b, y in values.items() if b != a)
        minus = sum(pref(y - x) for b, y in values.items() if b != a)
        out[a] = (weight * plus / (n - 1), weight * minus / (n - 1))
    return out


PREFS = {
    "usual": lambda d: 1.0 if d > 0 else 0.0,
    "ushape": lambda d: 1.0 if d > 0.1 + 1e-12 else 0.0,
    "vshape": lambda d: min(max(d, 0) / 0.3, 1.0),
    "level": lambda d: 0.0 if d <= 0.1 + 1e-12 else 1.0 if d > 0.3 + 1e-12 else 0.5,
    "vshape_i": lambda d: min(max((d - 0.1) / 0.2, 0.0), 1.0),
    "gaussian": lambda d: 1 - math.exp(-d * d / 0.08) if d > 0 else 0.0,
}


@pytest.mark.parametrize("limit", [None, 3])
@pytest.mark.parametrize("kind", sorted(PREFS))
def test_flows_equal_all_pairs(spark, kind, limit):
    """Also with many ties, thresholds met exactly, and windows cut into small buckets."""
    values = {f"e{i:02d}": round((i * 7 % 21) / 20, 2) for i in range(40)}
    rows = [(e, "C1", x, 1.0) for e, x in values.items()]
    df = spark.createDataFrame(rows, "entity string, indicator string, x double, w double")
    out = by_entity(P.flows(df, [], "entity", P.Preference(kind), limit), "phi_plus", "phi_minus")
    want = brute_flows(values, 1.0, PREFS[kind])
    for e in values:
        assert out[e] == pytest.approx(want[e], abs=1e-9), e


@pytest.mark.parametrize("limit", [None, 3])
@pytest.mark.parametrize("sigma", [0.0, 1e-12, 1e-9, 0.003, 0.01, 0.0999])
def test_narrow_bells_equal_all_pairs(spark, sigma, limit):
    """Ties, values at the border of a cell, values many cells apart, values closer than sigma."""
    values = {f"e{i:02d}": x for i, x in enumerate([0.0, 0.01, 0.01, 0.0100001, 0.013, 0.02, 0.0945, 0.1, 0.5, 0.503, 0.5031, 0.506, 0.997, 1.0, 1.0])}
    rows = [(e, "C1", x, 1.0) for e, x in values.items()]
    df = spark.createDataFrame(rows, "entity string, indicator string, x double, w double")
    out = by_entity(P.flows(df, [], "entity", P.Preference("gaussian", sigma=sigma), limit), "phi_plus", "phi_minus")
    want = brute_flows(values, 1.0, lambda d: 0.0 if d <= 0 else 1.0 if sigma == 0 else 1 - math.exp(-d * d / (2 * sigma**2)))
    for e in values:
        assert out[e] == pytest.approx(want[e], abs=1e-11), e


def test_net_flows_sum_to_zero(spark):
    rows = [(f"e{i}", "C1", (i * i % 17) / 16, 0.4) for i in range(30)] + [(f"e{i}", "C2", (i * 5 % 30) / 29, 0.6) for i in range(30)]
    df = spark.createDataFrame(rows, "entity string, indicator string, x double, w double")
    assert sum(r["phi"] for r in P.flows(df, [], "entity").collect()) == pytest.approx(0, abs=1e-12)
