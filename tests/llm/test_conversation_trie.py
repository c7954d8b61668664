import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelwise.llm import conversation_trie
from panelwise.llm.conversation_trie import TRIE_SQL, ordered_turns, prefix_trie, sketch, with_shared_starts
from panelwise.llm.queries import QUERIES
from tests.compare import differences, duck

SCHEMA = "conv_id long, turn long, role string, text string, depth string, x1 int, kind string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows():
    out = []
    for c in [*range(0, 45), 61, 62, 85, 1000, 1017]:  # 61, 62, 85: no conversation 60 or 80 to start from
        for t in range([3, 1, 5, 0, 2][c % 5] + 1):
            out.append((c, t, ["user", "assistant", None][t % 3], [f"turn {t} of some", "one two\tthree", "", None, "  "][(t + c // 7) % 5]))
    out += [(2000 + i, t, "user", f"shared words {t}") for i in range(8) for t in range(6)]  # copies
    out += [(2040, t, "user", f"long one {t}") for t in range(300)] + [(2041, t, "user", f"long one {t}") for t in range(290)]
    out += [(61, None, "user", "before all"), (61, None, None, "before all"), (5, 0, "user", "a tie"), (5, 0, "user", "a tie"), (None, 1, "user", "nobody's")]
    return [(*r, "d", 1, "k") for r in out]


def plain(table):
    """The nodes by walking through every conversation."""
    turns = defaultdict(list)
    for c, t, role, text, *_ in table:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in turns.items()}
    built = {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        words = len([w for w in conversation_words(node[-1][1])]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * words
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((m[0], len(node), parent, len(m), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversation_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def trie(df, bits=conversation_trie.MOST_BITS):
    return sorted(map(tuple, prefix_trie(with_shared_starts(ordered_turns(df)), bits).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("run,bits", [(4096, 27), (7, 17)])
def test_trie_by_walking(spark, monkeypatch, run, bits):
    monkeypatch.setattr(conversation_trie, "RUN", run)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    assert trie(df, bits) == plain(rows())


def test_all_digests_may_be_shared(spark, monkeypatch):
    """A sketch without a single proof changes nothing."""
    found = sketch
    def full(prefixes, bits):
        out = found(prefixes, bits)
        out.cells[:] = 255
        return out
    monkeypatch.setattr(conversation_trie, "sketch", full)
    assert trie(spark.createDataFrame(rows(), SCHEMA)) == plain(rows())


def test_marked_below_a_proven_prefix(spark, monkeypatch):
    """Cells that are full by chance mark prefixes below ones that are proven; their parents are still named."""
    found = sketch
    def crowded(prefixes, bits):
        out = found(prefixes, bits)
        out.cells |= np.random.default_rng(3).integers(0, 256, len(out.cells), dtype=np.uint8)
        return out
    monkeypatch.setattr(conversation_trie, "sketch", crowded)
    assert trie(spark.createDataFrame(rows(), SCHEMA)) == plain(rows())


def test_sketch_never_falls_below(spark):
    prefixes = conversation_trie.digests(with_shared_starts(ordered_turns(spark.createDataFrame(rows(), SCHEMA)))).toPandas()
    found = sketch(spark.createDataFrame(prefixes))
    deep = prefixes[prefixes["depth"] > 0]
    counts = deep.groupby(["x1", "x2"])["x1"].transform("size").to_numpy()
    marked = found.may_be_shared(deep["x1"].to_numpy(), deep["x2"].to_numpy())
    assert marked[counts > 1].all() and not marked[counts == 1].all()


def test_places_over_parts(spark):
    df = spark.createDataFrame([(1, t, "user", str(t)) for t in range(2000)] + [(2, t, "user", "x") for t in range(50)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered_turns(df.repartition(6))
        places = sorted((r["conv_id"], r["place"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert places == [(1, i) for i in range(1, 2001)] + [(2, i) for i in range(1, 51)]


def test_empty_table(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []


def test_query_against_sql(spark, tmp_path):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(path)
    assert differences(QUERIES["op13_conversation_trie"](spark, str(tmp_path)), duck(str(tmp_path)), TRIE_SQL) == []
