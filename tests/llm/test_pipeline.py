import os

import pytest

import __spark_entry__
import corpus_pipeline
from panelwise.llm.langid import identify
from panelwise.llm.mixing import mix
from panelwise.llm.perplexity import judge
from panelwise.llm.queries import QUERIES, SQL
from tests.compare import differences, duck

from .test_similar import components

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        kept.append((docs, spark.read.parquet(str(tmp_path / str(i)))))
        docs = kept[-1][1]
    before, after = kept[0]
    assert ids(after) == ids(judge(before, spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("accepted"))
    before, after = kept[1]
    assert ids(after) == ids(identify(before).filter("lang_pred <> 'und' AND score >= 0.5"))
    before, after = kept[2]
    rows = sorted(before.select("doc_id", "text").collect())
    root = components([r["text"] for r in rows])
    assert ids(after) == sorted({rows[k]["doc_id"] for k in root})
    before, after = kept[3]
    assert ids(after) == ids(mix(before).select("row.doc_id"))
    before, after = kept[4]
    assert ids(after.filter("piece = 0")) == ids(before)
    assert after.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {"pipeline", *QUERIES} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_against_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), duck(FOLDER), SQL[name]) == []
