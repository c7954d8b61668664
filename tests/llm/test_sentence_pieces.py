import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from panelwise.llm.queries import QUERIES
from panelwise.llm.sentence_pieces import Pieces, decode_pieces, encode_pieces, pack_ids, pieces, unpack_ids
from panelwise.llm.tokens import vocabulary

from . import fixtures

NAME = "piece_bpe_32k.model"
LIBRARY = SentencePieceProcessor(model_file=vocabulary(NAME))
OWN = Pieces(vocabulary(NAME), cached=500)


def listed(values, ends):
    return [x.tolist() for x in np.split(values, ends[:-1])]


@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(st.sampled_from(list("abeth in  ▁\n\té中😀\x0010=-ß́Ж")), max_size=80)), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_and_texts_are_the_library_s(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, ends = OWN.encode(pa.array(texts, pa.string()))
    want = [LIBRARY.encode(t or "") for t in texts]
    assert listed(ids, ends) == want
    assert OWN.decode(ids, ends) == [LIBRARY.decode(w) for w in want]


@given(st.lists(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 260)), max_size=12), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_any_ids_decode_as_in_the_library(rows):
    flat = np.array([i for r in rows for i in r], np.int64)
    assert OWN.decode(flat, np.cumsum([len(r) for r in rows])) == [LIBRARY.decode(r) for r in rows]


def test_long_words():
    r = random.Random(3)
    words = [" " * 30_000, "a" * 30_000, "".join(r.choice("etaoinsh") for _ in range(20_000)), "中文国" * 5_000, "=" * 1_001 + "x" * 999]
    ids, ends = OWN.encode(pa.array(words))
    assert listed(ids, ends) == [LIBRARY.encode(w) for w in words]


def test_queue_form_equals_rounds():
    r = random.Random(4)
    OWN._prepare()
    for _ in range(50):
        word = "".join(r.choice("abeth=  ") for _ in range(60))
        start = OWN.of_char[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
        symbols, _ = OWN._rounds(start, np.zeros(len(word), np.int64))
        assert OWN._queue(start.tolist()) == symbols.tolist()


def test_packing():
    ids, ends = np.array([1, 70_000, 3], np.uint32), np.array([0, 2, 3])
    got, stops = unpack_ids(pack_ids(ids, ends).slice(1))
    assert got.tolist() == [1, 70_000, 3] and stops.tolist() == [2, 3]
    got, stops = unpack_ids(pa.array([None, b"\1\0\0\0"], pa.binary()))
    assert got.tolist() == [1] and stops.tolist() == [0, 1]


@pytest.mark.parametrize("begin,end", [(True, True), (False, True), (False, False)])
def test_table(spark, begin, end):
    docs = fixtures.documents(spark).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    coded = encode_pieces(docs, begin=begin, end=end)
    assert set(coded.columns) == set(docs.columns) - {"text"}
    rows = decode_pieces(coded).select("doc_id", "ids", "decoded", "label").collect()
    want = [(r["doc_id"], tuple(LIBRARY.encode(r["text"] or "", add_bos=begin, add_eos=end)), r["label"]) for r in docs.collect()]
    got = [(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["label"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r["decoded"] == LIBRARY.decode(np.frombuffer(r["ids"], "<u4").tolist()) for r in rows)


def test_empty_table(spark):
    assert decode_pieces(encode_pieces(fixtures.empty(spark))).count() == 0


def test_query_against_the_library(spark, tmp_path):
    fixtures.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op12_sentence_pieces"](spark, str(tmp_path)).collect()), key=str)
    want = []
    for r in fixtures.documents(spark).select("doc_id", "text").collect():
        ids = LIBRARY.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_one_vocabulary_a_process():
    assert pieces(NAME) is pieces(NAME)
