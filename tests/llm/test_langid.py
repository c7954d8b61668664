import numpy as np

from panelwise.llm.langid import BITS, Settings, features, identify, recognised, train, weights

from . import fixtures

SYLLABLES = {"aa": "ka to mi ra su no", "bb": "sch ein ung ver ßen ich", "cc": "ión que los ñas ar mente"}


def text(lang, seed):
    r = np.random.default_rng(seed)
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(r.integers(3, 60)))


def corpus(spark, n=240):
    rows = [(i, text(list(SYLLABLES)[i % 3], i), list(SYLLABLES)[i % 3], 1) for i in range(n)]
    rows += [(1000, None, "aa", 1), (1001, "", "aa", 1), (1002, "12 !!", None, 1), (1003, text("bb", 7), None, 1), (None, text("cc", 8), "cc", 1), rows[4], (1004, text("aa", 9) * 300, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(4)


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in identify(docs, docs["doc_id"] % 4 != 1).collect()}
    held = [(i, list(SYLLABLES)[i % 3]) for i in range(240) if i % 4 == 1]
    assert np.mean([h in got for h in held]) >= 0.95
    assert {(1000, "und"), (1001, "und"), (1002, "und"), (1003, "bb"), (None, "cc"), (1004, "aa")} <= set(got)
    assert all(0 <= s <= 1 for s in got.values()) and got[1000, "und"] == 0


def test_labels_and_ids_are_no_inputs(spark):
    docs = corpus(spark)
    learn = docs["doc_id"] % 4 != 1
    one = {r["doc_id"]: tuple(r) for r in identify(docs, learn).collect()}
    hidden = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 4 = 1 THEN 'zz' ELSE lang END AS lang")
    assert {r["doc_id"]: tuple(r) for r in identify(hidden, hidden["doc_id"] % 4 != 1).collect()} == one


def test_sparse_and_calibrated(spark):
    model = train(corpus(spark).filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang"), Settings(l1=1.0))
    assert (model.weights == 0).mean() > 0.5 and model.temperature > 0
    assert (weights(np.array([0.5, -0.5, 3.0]), np.ones(3), Settings(l1=1.0)) == [0, 0, weights(np.array([3.0]), np.ones(1), Settings(l1=1.0))[0]]).all()


def test_features_have_length_one():
    at, values = features("Ab cé", np.ones(1 << BITS))
    assert np.isclose(values @ values, 1) and (np.diff(at) > 0).all()


def test_stage_and_empty(spark):
    docs = corpus(spark)
    kept = recognised(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not {1000, 1001, 1002} & ids and len([i for i in ids if i is not None and i < 240]) >= 235
    assert identify(fixtures.empty(spark)).count() == 0 and recognised(fixtures.empty(spark)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in identify(unlabelled).collect()} == {"und"}
    assert recognised(unlabelled).count() == unlabelled.count()
