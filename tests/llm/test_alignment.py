import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from panelwise.llm.alignment import align, byte_values, link_statistics, shared_cuts
from panelwise.llm.queries import QUERIES
from panelwise.llm.tokens import vocabulary

from . import fixtures

A = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
A.encode_special_tokens = True
NAMES = {i: t for t, i in A.get_vocab().items()}
B = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
TABLE = byte_values()
MORE = ["<|endoftext|> and <s>", "▁ stands", "emoji 😀😀 中文 text", "résumé naïve", " " * 40 + "x", "\t\ttabs\r\n", "ab<0x41>"]


def bytes_a(i):
    return bytes(int(TABLE[ord(c)]) for c in NAMES[i])


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """(ids of A, ids of B, groups) of one text, by running through both."""
    if not text:
        return [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    whole = (" " + text).encode()
    if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
        return [], [], []
    ends_a, ends_b = np.cumsum([len(bytes_a(i)) for i in a]).tolist(), np.cumsum([len(bytes_b(i)) for i in b]).tolist()
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return a, b, groups


def expected(rows):
    """Rows of the query for (doc_id, text) rows."""
    found = [(d, *plain(t)) for d, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for *_, groups in found for g in groups)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for d, a, b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((d, len(a), len(b), len(groups), digest, len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links)))
    return sorted(out, key=str)


@given(st.lists(st.tuples(st.sets(st.integers(1, 60), max_size=40), st.sets(st.integers(1, 60), max_size=40), st.integers(61, 70)), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_cuts_are_all_common_ends(texts):
    a, b, starts, want, base = [], [], [], [], 0
    for x, y, end in texts:
        first = len(a), len(b)
        a += [base + e for e in sorted(x | {end})]
        b += [base + e for e in sorted(y | {end})]
        starts.append([first[0], len(a), first[1], len(b)])
        want += [(a.index(base + e), b.index(base + e)) for e in sorted((x & y) | {end})]
        base += end
    got = shared_cuts(np.array(a), np.array(b), np.array(starts))
    assert list(zip(*(g.tolist() for g in got), strict=True)) == want


def table(spark):
    docs = fixtures.documents(spark)
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(MORE)], "doc_id long, text string")
    return docs.unionByName(more, allowMissingColumns=True)


def test_query_against_brute_force(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_token_alignment"](spark, str(tmp_path))
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
    assert sorted(got.columns) == sorted(names)
    rows = [(r["doc_id"], r["text"]) for r in table(spark).collect()]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == expected(rows)


def test_operator_keeps_groups_and_columns(spark):
    docs = table(spark).withColumn("a_ids", F.lit(1)).withColumn("block", F.lit("x"))
    got = align(docs).collect()
    assert len(got) == docs.count() and "label" in got[0].asDict() and "text" not in got[0].asDict()
    for r in got:
        a, b, x, y = (np.frombuffer(r[c], "<u4").tolist() for c in ("a_ids", "b_ids", "a_upto", "b_upto"))
        assert len(x) == len(y) and (x[-1:], y[-1:]) == ([len(a)] if a else [], [len(b)] if b else [])


def test_two_steps_equal_one(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = link_statistics(align(table(spark)), ["doc_id"]).collect()
    want = QUERIES["op11_token_alignment"](spark, str(tmp_path)).select("doc_id", "n_links", "n_best", "count_sum").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_empty_table(spark):
    assert link_statistics(align(fixtures.empty(spark)), ["doc_id"]).count() == 0


@pytest.mark.parametrize("text,zero", [("▁", True), ("<|endoftext|>", False), ("", True)])
def test_texts_without_tokens(spark, text, zero):
    row = align(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (len(row["a_ids"]) == 0) is zero
