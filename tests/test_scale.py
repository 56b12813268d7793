"""Whole texts are shuffled once at most, shuffle files go when a step ends, and small tables give the same rows either way."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wren.operators import containment as C
from wren.operators import feedback as FB
from wren.operators import requests as RQ
from wren.session import shuffles_dropped, stored
from wren.sources import fixtures as FX

T0 = datetime(2024, 1, 1)


def exchanges(df, column="text"):
    """Shuffles of the plan whose rows hold ``column``."""
    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        names = [node.output().apply(i).name() for i in range(node.output().size())]
        own = node.nodeName() == "Exchange" and column in names
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def shuffle_files(spark):
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables with keys that repeat, are null or negative."""
    home = str(tmp_path_factory.mktemp("odd"))
    ids = [*range(80), 5, 5, 17, 34, -17, -3, None, None]
    docs = [(d, f"some words of text {d} and {i} more, {'again ' * (i % 9)}the end", ("en", "de")[i % 2], f"src{i % 5}", 40 + i % 7)
            for i, d in enumerate(ids)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(
        f"{home}/documents.parquet")
    kinds = ("click", "signup", "purchase", "error", "view")
    events = [(e if e else None, T0 + timedelta(hours=e), e % 7, kinds[e % 5], float(e % 90), "{}") for e in range(400)] + [
        (50, T0, 1, "click", 1.0, "{}"), (-17, T0, 1, "view", 2.0, "{}")]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        f"{home}/events.parquet")
    labels = [(d, d % 2, int(d % 3 == 0)) for d in [*range(0, 80, 2), 4, 4, 17]] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    customer = [(c, f"c{c}", 1, c * 10.5, "x") for c in [*range(20), 7, 7]] + [(None, "none", 1, 1.0, "x")]
    spark.createDataFrame(customer, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(
        f"{home}/customer.parquet")
    return home


@pytest.fixture
def nothing_is_sent(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_posts_beside_a_large_customer_table_shuffle_their_texts_once(spark, tables, nothing_is_sent):
    large = FX.posts(spark, f"{tables}/./.")
    assert exchanges(large) == 1 and exchanges(FX.requests(spark, f"{tables}/./.")) <= 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    small = FX.posts(spark, tables)
    assert exchanges(small, "c_acctbal") == 0
    assert _rows(large) == _rows(small) and large.count() > 88


def test_texts_are_read_again_for_the_missed_rows_alone(spark, tables, nothing_is_sent):
    """The requests that are read again are picked before they meet their texts."""
    r = FX.requests(spark, tables)
    ids = r.select(F.col("request_id").alias("_row")).filter("_row % 3 = 0").distinct()
    again = FX.requests_of(spark, tables, ids)
    assert _rows(again) == _rows(r.join(ids, r["request_id"] == ids["_row"], "left_semi"))
    assert exchanges(again) <= exchanges(r)
    q = entry.queries()
    found = {n: _rows(q[n](spark, tables)) for n in ("reuse_scored", "store_scored")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert found == {n: _rows(q[n](spark, f"{tables}/.")) for n in found}


def test_reuse_scored_asks_for_missed_rows(spark):
    rows = [("a", "x", 1), ("a", "x", 4), ("b", "y", 2), ("c", "z", 3)]
    keys = spark.createDataFrame(rows, "key string, text string, n long")
    scored = spark.createDataFrame([("a", "old", datetime(2024, 1, 30, 23, 30))], "key string, result string, scored_at timestamp")
    asked = []

    def rows_of(ids):
        asked.extend(r[0] for r in ids.collect())
        return keys.join(ids, keys["n"] == ids[0], "left_semi")

    run = lambda *more: _rows(RQ.reuse_scored(keys, scored, F.lit("2024-01-31").cast("timestamp"), 3600, F.upper, "n", *more))
    assert run(rows_of) == run() and sorted(asked) == [2, 3]


def test_shuffle_files_go_when_a_step_ends(spark):
    df = spark.range(0, 5000, 1, 4).withColumn("v", F.xxhash64("id")).repartition(3, "v")
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    assert stored(df, "test-dropped").count() == 5000
    with shuffles_dropped(spark):
        kept = df.withColumn("w", F.col("v") + 1 - F.col("v")).groupBy("w").count().checkpoint(eager=True)
    assert kept.collect()[0]["count"] == 5000 and spark.conf.get(setting) == was
    assert len(shuffle_files(spark) - before) <= 6  # those of the counts that were read here


@pytest.mark.parametrize("bits", [(15, 15), (16, 28)])
def test_sieve_lets_every_wanted_gram_pass(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "SIEVE_BITS", bits)
    rng = np.random.default_rng(3)
    grams = rng.integers(-(1 << 63), 1 << 63, 3000)
    sieve = C.Sieve(spark.createDataFrame([(int(g),) for g in grams], "_gram long"))
    assert sieve.passes(grams.view(np.uint64)).all()
    others = rng.integers(-(1 << 63), 1 << 63, 20_000).view(np.uint64)
    assert bits[0] == 15 or sieve.passes(others).mean() < 0.05


def test_few_grams_of_a_text_are_shuffled(spark, monkeypatch):
    """Classes whose grams are joined: the grams that no needle has stay in the task, and no text is shuffled."""
    docs = [(k, " ".join(f"{(k * 7919 + j * 104729) % 99991:05d}" for j in range(400)) + " end") for k in range(40)]
    needles = [t[:50] for _, t in docs] + [t[-30:] for _, t in docs[:9]] + [t[700:713] for _, t in docs[:7]] + ["nowhere" * 7, "end"]
    d = spark.createDataFrame(docs, "uniqueid long, text string")
    q = spark.createDataFrame([(n,) for n in needles], "needle string")
    want = {n: min(k for k, t in docs if n in t) for n in needles if any(n in t for _, t in docs)}
    monkeypatch.setattr(C, "MAX_BROADCAST", 0)
    grams, made = C._text_grams, []
    monkeypatch.setattr(C, "_text_grams", lambda *a: made.append(grams(*a)) or made[-1])
    got = C.first_containing(q, d)
    assert {r["needle"]: r["uniqueid"] for r in got.collect()} == want
    assert exchanges(got, "_text") == 0
    windows, joined = [], C._joined_windows
    monkeypatch.setattr(C, "_joined_windows", lambda *a: windows.append(joined(*a)) or windows[-1])
    monkeypatch.setattr(C, "_text_windows", lambda texts, known, names, real=C._text_windows: windows.append(real(texts, known, names)) or windows[-1])
    for sent in (0, 200_000):  # what is compared is little more than what is equal
        monkeypatch.setattr(C, "MAX_BROADCAST", sent)
        assert {r["needle"]: r["uniqueid"] for r in C.first_containing(q, d).collect()} == want
    assert all(w.distinct().count() <= 1.1 * sum(n in t for n in want for _, t in docs) for w in windows) and len(windows) == 2
    assert made[0].count() * 20 < grams(d.toDF("_doc", "_text"), [0, 1, 2, 6]).count()


def test_feedback_match_reads_held_posts_in_place(spark, tables):
    posts = FX.stored_posts(spark, tables)
    history = FX.history(spark, tables, posts)
    assert _rows(FB.feedback_match(history, posts, held=True)) == _rows(FB.feedback_match(history, FX.posts(spark, tables)))
    assert "eligible-" not in "".join(FB.store_eligible(posts, held=True).inputFiles())


@pytest.mark.parametrize("name", ["stream_feedback", "stream_feedback_window"])
def test_stream_feedback_stages_without_a_persisted_copy(spark, tables, monkeypatch, name):
    kept, kind = [], type(spark.range(1))
    real = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, *a: kept.append(self.columns) or real(self, *a))
    got = {r["seq"]: r["uniqueid"] for r in entry.queries()[name](spark, tables).collect()}
    assert not any("tweet" in c for c in kept)
    posts = FX.posts(spark, tables)
    want = {r["seq"]: r["uniqueid"] for r in FB.feedback_match(FX.history(spark, tables, posts), posts).collect()}
    assert got == {s: u for s, u in want.items() if name == "stream_feedback" or 0 <= s and s % 45 < 30}
