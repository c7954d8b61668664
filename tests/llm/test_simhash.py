import re

import numpy as np
import xxhash

from panelwise.llm import simhash
from panelwise.llm.simhash import block_count, keep_one, links, masks, near_duplicates

from . import fixtures

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    runs = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64(x, seed=42).intdigest() for x in runs]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def components(values, distance):
    values, root = np.array(values, np.uint64), list(range(len(values)))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= distance).tolist() for v in values]
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            low = min(root[j] for j in js)
            if low < root[i]:
                root[i], changed = low, True
    return root


def test_documents_against_brute_force(spark):
    docs = fixtures.documents(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain(r["text"]) for r in rows]
    for distance in (2, 6):
        root = components(prints, distance)
        least = {}
        for r, k in zip(rows, root, strict=True):
            if r["doc_id"] is not None:
                least[k] = min(least.get(k, 1 << 60), r["doc_id"])
        want = sorted((r["doc_id"] or -1, f"{p:016x}", least.get(k)) for r, p, k in zip(rows, prints, root, strict=True))
        got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in near_duplicates(docs, 3, distance).collect())
        assert [str(x) for x in got] == [str(x) for x in want]


def test_hot_buckets_lose_no_link(spark):
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**63, 6, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (400, 3), dtype=np.uint64)
    values = np.unique(centre[r.integers(0, 6, 400)] ^ np.bitwise_xor.reduce(np.where(r.random((400, 3)) < 0.7, flips, 0), axis=1).astype(np.uint64))
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long").repartition(4)
    for distance, blocks, bucket in ((2, 3, 40), (2, 4, 1 << 14), (1, 2, 30)):
        got = links(table, distance, blocks, bucket).collect()
        at = {int(v): i for i, v in enumerate(values.view(np.int64))}
        root = list(range(len(values)))
        for _ in range(40):
            for e in got:
                assert e["a"] == e["b"] or True
                low = min(root[at[e["a"]]], root[at[e["b"]]])
                root[at[e["a"]]] = root[at[e["b"]]] = low
        assert root == components(values, distance)


def test_masks_keep_close_pairs_together():
    r = np.random.default_rng(2)
    for distance in (1, 2, 3):
        kept = [m & (2**64 - 1) for m in masks(list(range(64)), distance, distance + 2)]
        for _ in range(200):
            flips = sum(1 << int(b) for b in r.choice(64, distance, replace=False))
            assert any(flips & m == 0 for m in kept)
    assert block_count(10, 2) == 3 and block_count(10**10, 2) > 3


def test_long_runs_give_few_links():
    values = np.arange(1 << 10, dtype=np.uint64)
    a, b = simhash.runs_linked(np.zeros((len(values), 2), np.int64), values, 1)
    assert len(a) == len(values) - 1


def test_keep_one_returns_whole_rows(spark):
    docs = fixtures.documents(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {r["component_id"] for r in near_duplicates(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(i for i in want if i is not None)
    assert keep_one(fixtures.empty(spark)).count() == 0 and near_duplicates(fixtures.empty(spark)).count() == 0


def test_keep_one_keeps_a_row_of_every_group_whatever_its_id(spark):
    rows = [(None, fixtures.prose(i, 60)) for i in range(200, 205)] + [(None, fixtures.prose(200, 60)), (None, None), (None, "")]
    rows += [(7, fixtures.prose(300, 60)), (7, fixtures.prose(301, 60)), (7, fixtures.prose(301, 60)), (9, fixtures.prose(201, 60)), (3, fixtures.prose(301, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"] or "") for r in keep_one(docs).collect()]
    want = [(None, ""), (None, fixtures.prose(200, 60)), (9, fixtures.prose(201, 60)), *[(None, fixtures.prose(i, 60)) for i in (202, 203, 204)]]
    want += [(7, fixtures.prose(300, 60)), (3, fixtures.prose(301, 60))]
    assert sorted(map(str, kept)) == sorted(map(str, want))
