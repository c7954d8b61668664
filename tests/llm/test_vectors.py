import numpy as np
from pyspark.sql import functions as F

from panelwise.llm import tiled_cosine
from panelwise.llm.hamming_index import Index, nearest
from panelwise.llm.tiled_cosine import near_vectors

from . import vectors


def brute_links(rows, threshold):
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i < j and a[2] is not None and a[2] == b[2] and vectors.valid(a[1]) and vectors.valid(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    root = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            low = min([root[i], *(root[j] for j in js)], key=lambda k: rows[k][0])
            if rows[low][0] < rows[root[i]][0]:
                root[i], changed = low, True
    return sorted((r[0], len(links[i]), rows[root[i]][0]) for i, r in enumerate(rows))


def test_tiled_cosine_against_all_pairs(spark):
    rows = vectors.rows()
    table = spark.createDataFrame(rows, vectors.SCHEMA).repartition(5)
    for tile in (16, 2048):
        for threshold in (0.93, 0.7):
            got = near_vectors(table, threshold, tile).collect()
            assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows, threshold)
            assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_early_stop_loses_nothing():
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 24)) * np.linspace(3, 0.1, 24)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = tiled_cosine.tile_links(x, x, axes, 0.8, True)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.argwhere(np.triu(u @ u.T >= 0.8, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))


def test_index_returns_all_codes_in_the_radius():
    r = np.random.default_rng(5)
    code = r.integers(0, 2**64 - 1, 3000, dtype=np.uint64) & r.integers(0, 2**64 - 1, 3000, dtype=np.uint64)
    index = Index(code)
    for radius in (0, 1, 5, 14, 23, 64):
        for q in code[:5]:
            assert index.within(q, radius).tolist() == np.flatnonzero(np.bitwise_count(code ^ q) <= radius).tolist()


def brute_nearest(rows, k):
    seen = {}
    for r in rows:
        if vectors.valid(r[1]) and (r[0] not in seen or r[1] < seen[r[0]]):
            seen[r[0]] = r[1]
    out = {}
    for q in [i for i in seen if i % 20 == 0]:
        x = np.array(seen[q], float)
        near = sorted((np.sqrt(np.square(np.array(v, float) - x).sum()), i) for i, v in seen.items() if i != q and len(v) == len(seen[q]))
        out[q] = near[:k]
    return out


def test_nearest_against_brute_force(spark):
    rows = vectors.rows()
    want = brute_nearest(rows, 10)
    table = spark.createDataFrame(rows, vectors.SCHEMA).repartition(3)
    got = {}
    for r in nearest(table, F.col("vec_id") % 20 == 0, 10, block=100, query_block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    assert set(got) == {q for q, near in want.items() if near}
    hits = total = 0
    for q, near in want.items():
        assert [r for _, _, r in got[q]] == list(range(1, len(near) + 1))
        assert [(s, i) for s, i, _ in got[q]] == sorted((s, i) for s, i, _ in got[q])
        hits += len({i for _, i in near} & {i for _, i, _ in got[q]})
        total += len(near)
    assert hits / total >= 0.9


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (3, [0.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    got = nearest(few, F.col("vec_id") % 20 == 0, 10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 20), (0, 2, 3), (20, 1, 3), (20, 2, 0)]
    none = few.limit(0)
    assert nearest(none, F.col("vec_id") % 20 == 0, 10).count() == 0
    assert near_vectors(none).count() == 0
