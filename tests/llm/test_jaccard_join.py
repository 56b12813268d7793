import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wren.llm import jaccard_join as J
from wren.llm.graph import components


def brute(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(rng, n_families, per_family):
    vocabulary = [f"v{i}" for i in range(400)]
    hot = " ".join(rng.choice(vocabulary) for _ in range(9))
    rows = []
    for _ in range(n_families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 12, 20, 30, 60, 150]))]
        for _ in range(rng.randint(1, per_family)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                w = hot.split() + w
            rows.append((len(rows) * 3, (" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return rows + [(100_001, None), (100_002, ""), (100_003, " \n"), (100_004, "one"), (100_005, "ONE"), (100_006, "two words")]


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100)])
def test_against_brute_force(spark, size, num, den, monkeypatch):
    rows = corpus(random.Random(size), 60, 25)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 900)  # several blocks in a family
    got = J.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows, size, num, den)


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100)])
def test_similar_sets_share_a_signature(num, den):
    """No pair is lost, with and without frequent shingles that are left out."""
    rng = np.random.default_rng(3)
    bands = J.Bands(num, den)
    universe = rng.integers(0, 2**63, 3000).astype(np.uint64)
    frequent = np.sort(universe[:1500])
    pairs = 0
    for _ in range(1500):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.choice(universe, n, replace=False))
        b = set(a.tolist())
        for _ in range(int(rng.integers(0, max(2, n * (den - num) // den + 1)))):
            if b and rng.random() < 0.5:
                b.discard(int(rng.choice(sorted(b))))
            else:
                b.add(int(rng.choice(universe)))
        b = np.array(sorted(b), dtype=np.uint64)
        common = len(np.intersect1d(a, b))
        if len(b) and den * common >= num * (len(a) + len(b) - common) and not np.array_equal(a, b):
            pairs += 1
            for known in (frequent, np.empty(0, np.uint64), np.sort(universe)):
                assert len(np.intersect1d(J.signatures(a, bands, known), J.signatures(b, bands, known)))
    assert pairs > 100


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(-500, 500), rng.randint(-500, 500)) for _ in range(450)] + [(i, i + 1) for i in range(2000, 2100)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edge_rows(edge_docs, no_docs):
    rows = J.similarity_groups(edge_docs.where("doc_id IS NOT NULL")).collect()
    assert len(rows) == 11
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1][1] == got[7][1] == 1 and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (0, 4) and got[10] == (0, 10)
    assert got[5] == (1, 5)
    assert J.similarity_groups(no_docs).count() == 0
    left = J.one_of_each_group(edge_docs)
    assert left.columns == edge_docs.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    twice = J.one_of_each_group(edge_docs.where("doc_id = 7"))
    assert twice.count() == 1


def test_ids_that_repeat_with_different_texts(spark):
    """Each text of a repeated id goes by its own group."""
    word = lambda k, n=40: " ".join(f"t{k}w{j}" for j in range(n))
    rows = [(3, word(3)), (5, word(3)), (5, word(5)), (5, word(5)), (5, ""), (6, word(6)), (6, word(60)), (7, word(6)),
            (8, word(60)), (9, word(9)), (9, word(9) + " end"), (None, word(9)), (None, word(77))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS node", "text AS id", "1 AS `of`", "2 AS chosen")
    left = J.one_of_each_group(docs)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] != 9), key=str)
    assert got == sorted([(3, word(3)), (5, word(5)), (5, ""), (6, word(6)), (6, word(60)), (None, word(9)), (None, word(77))], key=str)
    assert sum(r["doc_id"] == 9 for r in left.collect()) == 1  # near copies under one id


def test_sets_known_only_without_id_link(spark):
    """A text without id takes part: it bridges two that are too far apart."""
    words = [f"w{j}" for j in range(103)]
    a, b, c = (" ".join(words[k:k + 97]) for k in (0, 3, 6))
    assert [brute([(1, a), (2, b)], 3, 90, 100)[k][1] for k in (1, 2)] == [1, 1]
    assert [brute([(1, a), (2, c)], 3, 90, 100)[k][1] for k in (1, 2)] == [1, 2]
    docs = spark.createDataFrame([(1, a), (None, b), (2, c), (4, "other words here")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.similarity_groups(docs).collect()}
    assert got == {1: 1, None: 1, 2: 1, 4: 4}


def test_steps_leave_no_shuffle_files_behind(spark, monkeypatch):
    """What the steps before the last one shuffled is gone when the last one begins."""
    from contextlib import nullcontext

    from wren.llm import graph, jaccard_join

    def files():
        blocks = spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}

    rows = [(i, " ".join(f"w{(i // 3) * 50 + j}" for j in range(40)) + " end" * (i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def left():
        before = files()
        jaccard_join.one_of_each_group(docs)  # all steps but the last
        return len(files() - before)

    dropped = left()
    for module in (graph, jaccard_join):
        monkeypatch.setattr(module, "shuffles_dropped", lambda spark: nullcontext())
    assert dropped < left()
