import bisect
import random
import zlib
from collections import defaultdict

import pytest

from wren.llm.sharding import assign_shards, cut_hashes, cut_runs, own_shards, shard_report, smallest_capacity


def brute_capacity(sizes, k):
    """Least largest sum over all ways of cutting into k runs, by dynamic programming."""
    n = len(sizes)
    pre = [0]
    for s in sizes:
        pre.append(pre[-1] + s)
    best = pre[:]
    for _ in range(k - 1):
        best = [min(max(best[j], pre[i] - pre[j]) for j in range(i + 1)) for i in range(n + 1)]
    return best[n]


def test_capacity_is_the_least(spark):
    rng = random.Random(4)
    for n, k in ((1, 16), (7, 3), (40, 16), (60, 5)):
        sizes = [rng.choice([1, 2, 50, rng.randint(1, 1000)]) for _ in range(n)]
        starts = [0]
        for s in sizes:
            starts.append(starts[-1] + s)
        assert smallest_capacity(starts, k) == brute_capacity(sizes, k)
    keys = sorted({rng.getrandbits(64) - 2**63 for _ in range(3000)})
    keys += [keys[-1] + 1] if keys[-1] < 2**63 - 1 else []  # neighbours in one range
    sizes = [rng.randint(1, 10_000) for _ in keys]
    starts = [0]
    for s in sizes:
        starts.append(starts[-1] + s)
    cuts, capacity = cut_hashes(spark.createDataFrame(list(zip(keys, sizes)), "h long, size long").cache(), 16)
    assert capacity == smallest_capacity(starts, 16)
    held = defaultdict(int)
    for h, s in zip(keys, sizes):
        held[bisect.bisect_right(cuts, h)] += s
    assert max(held.values()) <= capacity


def check(docs, rows, k=16):
    assert len(rows) == docs.count()
    slots, shard_of = defaultdict(list), defaultdict(set)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for r in rows:
        t = texts[r["doc_id"]][0].encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) and 0 <= r["shard"] < k
        slots[r["shard"]].append(r["slot"])
        shard_of[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())


def test_edge_rows(edge_docs, no_docs):
    check(edge_docs, assign_shards(edge_docs).collect())
    assert assign_shards(no_docs).count() == 0
    assert shard_report(edge_docs).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@pytest.mark.parametrize("hot", [1000, 3000])
def test_hot_group_and_even_shards(spark, hot):
    """Shards are even to 2 %, but a group of equal texts stays whole: no shard can be smaller than the largest group."""
    rows = [(i, "same text") for i in range(hot)] + [(i, f"text {i} " + "x" * (i % 90)) for i in range(hot, 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = assign_shards(docs).collect()
    check(docs, got)
    held = defaultdict(int)
    for r in got:
        held[r["shard"]] += r["size"]
    total = sum(held.values())
    assert len(held) == 16 and max(held.values()) <= max(10 * hot, total / 16 * 1.02)


def test_runs_are_cut_under_the_smallest_capacity():
    """Largest run equals the dynamic program, no run is empty, and what is left after each run is cut as well as it can be."""
    rng = random.Random(9)
    for n, k in ((1, 4), (3, 4), (4, 4), (30, 4), (100, 16)):
        sizes = [rng.choice([1, 3, rng.randint(1, 60)]) for _ in range(n)]
        starts = [0]
        for s in sizes:
            starts.append(starts[-1] + s)
        cuts = cut_runs(starts, k)
        runs = [starts[b] - starts[a] for a, b in zip([0, *cuts], cuts)]
        assert cuts[-1] == n and max(runs) == brute_capacity(sizes, k)
        assert sum(r > 0 for r in runs) == min(n, k)
        for j in range(k):
            if runs[j:] and max(runs[j:]):
                assert max(runs[j:]) == brute_capacity(sizes[([0, *cuts])[j]:], k - j)


def test_large_group_has_a_shard_of_its_own(spark):
    """One text with 35 % of the bytes: it fills a shard, the others are even to 2 %, none is empty."""
    n = 20_000
    rows = [(i, "hot text" * 6 if i % 4 == 0 else f"text {i} " + "x" * (i % 40)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = assign_shards(docs).collect()
    check(docs, got)
    held = defaultdict(int)
    for r in got:
        held[r["shard"]] += r["size"]
    hot = sum(1 for i in range(n) if i % 4 == 0) * 49
    rest = sum(held.values()) - hot
    assert 0.3 < hot / sum(held.values()) < 0.4 and held[15] == hot
    assert set(held) == set(range(16)) and all(abs(held[s] - rest / 15) <= 0.02 * rest / 15 for s in range(15))


def test_ranges_that_share_many_leading_bits(spark):
    """Groups beside a large one in the same 18-bit range, and many ranges open at once, give the exact capacity."""
    rng = random.Random(2)
    base = 77 << 46
    keys = sorted({rng.getrandbits(64) - 2**63 for _ in range(40_000)} | {base + i for i in range(40)})
    sizes = [9_000_000 if h == base + 20 else rng.randint(1, 3000) for h in keys]
    groups = spark.createDataFrame(list(zip(keys, sizes)), "h long, size long").cache()
    starts = [0]
    for s in sizes:
        starts.append(starts[-1] + s)
    assert cut_hashes(groups, 16)[1] == smallest_capacity(starts, 16) == 9_000_000
    own = own_shards(groups, 16)
    assert own == [base + 20]
    kept = [s for h, s in zip(keys, sizes) if h not in own]
    starts = [0]
    for s in kept:
        starts.append(starts[-1] + s)
    cuts, capacity = cut_hashes(groups.where(groups.h != own[0]), 15)
    assert capacity == smallest_capacity(starts, 15) and len(cuts) == 14


def test_few_groups(spark):
    """Fewer groups than shards, all in one range of hashes: a shard each."""
    groups = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "h long, size long")
    assert cut_hashes(groups, 4) == ([2, 3], 10)
