import hashlib
import random
import re

from wren.llm.decontaminate import contamination, decontaminate

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        for a in range(len(v) - n + 1) if v else ():
            for p in range(len(w) - n + 1):
                if w[p:p + n] == v[a:a + n]:
                    hit |= set(range(p, p + n))
                    if i is not None:
                        found.add(i)
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["A", "b", "É", "é", "c1", "Σ", "d"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 12, 13, 14, 20]))) for i in range(12)] + [(99, ""), (98, None)]
    docs = [(i, say(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + say(rng.randint(0, 30))) for i in range(150)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()}
    assert rows == {i: brute(t, items) for i, t in docs}


def test_edge_rows(edge_docs, no_docs, edge_benchmark):
    items = [tuple(r) for r in edge_benchmark.collect()]
    got = contamination(edge_docs, edge_benchmark).collect()
    assert len(got) == edge_docs.count()  # a row for each row, repeated ones too
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    for r in got:
        if r["doc_id"] != 6:  # the long one is covered by its window count below
            assert (r["n_words"], r["n_hit"], r["n_items"]) == brute(texts[r["doc_id"]], items)[:3]
        else:
            assert r["n_words"] == 30_000 and r["n_hit"] == 40 * 30 and r["n_items"] == 1
    assert contamination(no_docs, edge_benchmark).count() == 0
    none = contamination(edge_docs, edge_benchmark.where("false"))
    assert none.where("n_hit > 0 OR contaminated").count() == 0 and none.count() == edge_docs.count()


def test_removal(edge_docs, edge_benchmark):
    left = decontaminate(edge_docs, edge_benchmark)
    assert left.columns == edge_docs.columns
    bad = {r["doc_id"] for r in contamination(edge_docs, edge_benchmark).where("contaminated").collect()}
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in edge_docs.collect()} - bad
    cut = {r["doc_id"]: r["text"] for r in decontaminate(edge_docs, edge_benchmark, remove="spans").collect()}
    assert cut[2] is None and cut[3] == "" and cut[5] == "" and cut[10] == "\n\n\n"
    assert cut[1] == "The quick brown the lazy dog. " + "The quick brown the lazy dog. " * 2
