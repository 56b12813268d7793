import random

import pytest
from pyspark.sql import functions as F

from wren.llm.quality_classifier import Model, classify, fit_model, site_posteriors

SYLLABLES = "ba ce di fo gu la me ni po ru sa te".split()


def say(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    rows = []
    for i in range(900):
        kind = i % 6
        text = say(rng, rng.randint(20, 80))
        if kind == 0:
            text = "".join(w + rng.choice(["***", "###", "$$$"]) + " " for w in text.split())
        elif kind == 1:
            w = text.split()
            for bad in rng.sample(["vile", "scumbag", "worthless", "dimwit"], 2):
                w.insert(rng.randrange(len(w)), bad)
            text = " ".join(w)
        rows.append((i, text, rng.choice(["en", "de"]), f"host{i % 7}", int(kind != 0), int(kind == 1)))
    return rows


def frames(spark, corpus):
    docs = spark.createDataFrame([r[:4] for r in corpus], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4], r[5]) for r in corpus if r[0] < 600], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark, corpus):
    docs, labels = frames(spark, corpus)
    got = {r["doc_id"]: r["rejected"] for r in classify(docs, labels).collect()}
    held = [r for r in corpus if r[0] >= 600]
    bad = [r for r in held if r[5] or not r[4]]
    clean = [r for r in held if r[4] and not r[5]]
    assert sum(got[r[0]] for r in bad) >= 0.97 * len(bad)
    assert sum(got[r[0]] for r in clean) <= 0.01 * len(clean)


def test_sites_are_shrunk(spark):
    rows = [("h1", "a", 0.9)] * 50 + [("h1", "b", 0.1)] + [("h2", "a", 0.1)] * 50 + [("h3", None, 0.9)] + [("h2", "b", 0.1)] * 30
    sites, mean, strength = site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r["host"], r["path"]): r for r in sites.collect()}
    total = sum(p for *_, p in rows)
    assert abs(mean - total / len(rows)) < 1e-9 and strength >= 1
    h1, h2, h3 = got["h1", "a"]["host_share"], got["h2", "a"]["host_share"], got["h3", None]["host_share"]
    assert h2 < mean < h1 < 0.9 and got["h1", "b"]["host_share"] == h1
    assert abs(h3 - mean) < abs(h1 - mean)  # one document moves its host less than fifty do


def test_prior_of_the_site_counts(spark, corpus):
    """The same undecided text is worse on a site of bad documents; its own evidence is left out of the prior."""
    docs, labels = frames(spark, corpus)
    junk = [(10_000 + i, "".join(w + "*** " for w in "la me ni po ru sa te ba".split() * 4) + str(i), "en", "bad.host") for i in range(60)]
    good = [(20_000 + i, r[1], "en", "good.host") for i, r in enumerate(corpus) if r[4] and not r[5]][:60]
    probe = [(30_000, corpus[1][1], "en", "bad.host"), (30_001, corpus[1][1], "en", "good.host")]
    more = docs.unionByName(spark.createDataFrame(junk + good + probe, docs.schema))
    got = {r["doc_id"]: r for r in classify(more, labels).collect()}
    assert got[30_000]["p_own"] == got[30_001]["p_own"]
    assert got[30_000]["p_site"] > got[30_001]["p_site"] and got[30_000]["p_bad"] > got[30_001]["p_bad"]


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, None), (2, None, 1), (None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    out = classify(edge_docs.withColumnRenamed("n_words", "p_bad"), labels)
    assert out.columns == ["doc_id", "text", "lang", "source", "p_own", "p_site", "p_bad", "rejected"]
    rows = out.collect()
    assert len(rows) == edge_docs.count() and not any(r["rejected"] for r in rows)  # too few labels: nothing is rejected
    assert classify(no_docs, labels).count() == 0
    assert classify(edge_docs, labels.where("false")).where("rejected").count() == 0
    assert fit_model(no_docs, labels).weights == {"low": None, "toxic": None}
    assert Model().probability(None) == 0.0
    assert out.where(F.col("p_bad").isNull() | F.isnan("p_bad")).count() == 0
