import zlib
from collections import defaultdict

import numpy as np

from panelwise.llm.sharding import place, shard, write_shards

from . import fixtures


def sizes(rows):
    out = defaultdict(int)
    for r in rows:
        out[r["shard"]] += len((r["text"] or "").encode()) + 1
    return out


def test_every_row_once_without_gaps(spark):
    docs = fixtures.documents(spark)
    got = shard(docs, 4).collect()
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["source"] or "", r["text"] is None)
    assert sorted(map(key, got)) == sorted(map(key, docs.collect()))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(4))


def test_near_equal_and_groups_together(spark):
    rows = [(i, fixtures.prose(i % 900, 20 + i % 37)) for i in range(3000)] + [(5000 + i, "copy " * 30) for i in range(1500)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 8).collect()
    total = sizes(got)
    mean = sum(total.values()) / 8
    assert len(total) == 8 and max(total.values()) <= 1.01 * mean and min(total.values()) >= 0.98 * mean
    where = defaultdict(set)
    for r in got:
        where[r["text"]].add(r["shard"])
    whole = [t for t, s in where.items() if len(s) > 1]
    assert whole in ([], ["copy " * 30])  # a third of all rows does not fit into one of eight shards
    assert len(where["copy " * 30]) > 1


def test_written_shards(spark, tmp_path):
    docs = fixtures.documents(spark).select("doc_id", "text")
    write_shards(docs, str(tmp_path / "s"), 4)
    got = spark.read.parquet(str(tmp_path / "s")).collect()
    crc = lambda rows: sorted(zlib.crc32((r["text"] or "").encode()) for r in rows)
    assert crc(got) == crc(docs.collect())


def test_place_prefers_what_fits():
    items = np.array([[4, 1, 1], [4, 1, 1], [1, 4, 4], [1, 4, 4.0]])
    out = place(items, 2)
    assert out[0] != out[1] and out[2] != out[3]


def test_empty_table(spark):
    assert shard(fixtures.empty(spark), 4).count() == 0
