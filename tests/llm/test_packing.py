import random
from collections import Counter, defaultdict
from itertools import combinations

from panelwise.llm.packing import fullest, pack, patterns
from panelwise.llm.tokens import Encoder, vocabulary

from . import fixtures


def test_fullest_against_all_subsets():
    r = random.Random(3)
    for _ in range(200):
        items = [r.randint(1, 30) for _ in range(r.randint(0, 9))]
        room = r.randint(0, 60)
        counts = Counter(items)
        used = fullest(counts, sorted(counts, reverse=True), room)
        best = max((sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room), default=0)
        assert sum(used) == best and not Counter(used) - counts


def test_patterns_use_every_item_and_few_bins():
    r = random.Random(5)
    counts = Counter(min(100, 1 + int(r.expovariate(1 / 25))) for _ in range(3000))
    found = patterns(dict(counts), 100)
    total = Counter()
    for times, bin_ in found:
        assert sum(n * m for n, m in bin_.items()) <= 100
        for n, m in bin_.items():
            total[n] += times * m
    assert total == counts
    assert sum(t for t, _ in found) <= -(-sum(n * c for n, c in counts.items()) // 100) + 2


def check(spark, docs, size):
    rows = pack(docs, size).collect()
    tokenizer = Encoder(vocabulary("word_bpe_49k.json"), False).tokenizer
    want = sorted(((r["doc_id"] or -1), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.select("doc_id", "text").collect())
    bins, lengths = defaultdict(list), Counter()
    for r in rows:
        assert r["start"] == r["piece"] * size and 0 < r["length"] <= size
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        lengths[r["doc_id"] or -1] += r["length"]
    for items in bins.values():
        items.sort()
        end = 0
        for offset, length in items:
            assert offset == end
            end += length
        assert end <= size
    whole = Counter()
    for d, n in want:
        whole[d] += n
    assert lengths == whole
    return len(bins), -(-sum(whole.values()) // size)


def test_pieces_fill_sequences_without_gaps(spark):
    check(spark, fixtures.documents(spark), 64)
    used, least = check(spark, fixtures.documents(spark), 4096)
    assert used == least


def test_one_hot_length(spark):
    docs = spark.createDataFrame([(i, "a b c" if i % 3 else fixtures.prose(i, 50)) for i in range(300)], "doc_id long, text string")
    check(spark, docs, 100)


def test_empty_table(spark):
    assert pack(fixtures.empty(spark)).count() == 0
