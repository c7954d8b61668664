import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from panelwise.llm.token_file import BLOCK, decode_words, encode_words, token_file, unframe, write_token_file
from panelwise.llm.tokens import Encoder, vocabulary

from . import fixtures

NAMES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ENCODERS = {}


def encoder(name, blanks):
    if name not in ENCODERS:
        ENCODERS[name] = Encoder(vocabulary(name), blanks, cached=50)
    return ENCODERS[name]


@given(st.lists(st.one_of(st.integers(0, 7), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
@settings(max_examples=150, deadline=None)
def test_words_come_back(ids):
    ids = np.array(ids, np.uint64)
    words, offsets = encode_words(ids)
    assert (decode_words(words, offsets, len(ids)) == ids).all()


def test_blocks_decode_alone():
    ids = np.arange(1000, dtype=np.uint64) ** 2
    words, offsets = encode_words(ids)
    for b in range(len(offsets) - 1):
        part = words[offsets[b] : offsets[b + 1]]
        n = min(BLOCK, len(ids) - b * BLOCK)
        assert (decode_words(part, np.array([0, len(part)]), n) == ids[b * BLOCK : b * BLOCK + n]).all()


def test_dense_words():
    assert len(encode_words(np.zeros(128, np.uint64))[0]) == 1
    assert len(encode_words(np.ones(120, np.uint64))[0]) == 2
    assert len(encode_words(np.full(3, 50_000, np.uint64))[0]) == 1


@pytest.mark.parametrize("name,blanks", NAMES)
@given(st.lists(st.text(st.sampled_from(list("ab eT.'\n\t1é́ 　\x1c\x85İ中ß<|>")) , max_size=25), min_size=1, max_size=8))
@settings(max_examples=120, deadline=None)
def test_encoder_is_the_library(name, blanks, texts):
    e = encoder(name, blanks)
    ids, ends = e.encode(pa.array(texts))
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_file_against_the_library(spark, tmp_path):
    docs = fixtures.documents(spark)
    path = str(tmp_path / "tokens")
    write_token_file(docs, path)
    got = token_file(docs, with_ids=True).collect()
    tokenizer = encoder(*NAMES[0]).tokenizer
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    texts = sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in got)
    assert texts == sorted((r["doc_id"] or -1, (*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0)) for r in rows)
    for r in spark.read.parquet(path).collect():
        names, lengths, ids = unframe(bytes(r["payload"]))
        assert len(ids) == r["n_ids"] == lengths.sum() and len(names) == len(lengths)


def test_empty_table(spark):
    assert token_file(fixtures.empty(spark)).count() == 0
