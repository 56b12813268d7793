"""Landing, keyed insert and snapshot upsert."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from wren.operators import landing as L


def _raw(spark):
    items = [
        {"type": "tweet", "id": "1", "text": "hi #a", "likeCount": "3",
         "author": {"userName": "u1", "followers": 10, "following": 2}, "hashtags": ["a", "b"],
         "finishedAt": "2025-03-23T18:21:15Z"},
        {"type": "mock", "id": "2", "text": "skip"},
        {"type": "tweet", "id": "3", "text": "no tags", "likeCount": "n/a", "author": {"userName": "u2"},
         "hashtags": [], "finishedAt": "2025-03-23T18:21:15Z", "extra": 1},
        "not json at all",
    ]
    return spark.createDataFrame([(json.dumps(i) if isinstance(i, dict) else i,) for i in items], "raw string")


def test_land_filters_flattens_keys(spark):
    rows = {r["id"]: r for r in L.land(_raw(spark)).collect()}
    assert set(rows) == {"1", "3"}
    assert rows["1"]["uniqueid"] == "1_20250323182115"
    assert rows["1"]["author_userName"] == "u1" and rows["1"]["author_followers"] == 10
    assert rows["1"]["hashtags"] == "a,b" and rows["3"]["hashtags"] == ""
    assert rows["3"]["likeCount"] == "n/a"


def test_union_batches_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([(2, 3.0)], "id long, b double")
    got = sorted(L.union_batches(a, b).collect())
    assert [tuple(r) for r in got] == [(1, "x", None), (2, None, 3.0)]


def test_insert_rejects_null_duplicate_existing(spark):
    target = spark.createDataFrame([("k1", "old")], "uniqueid string, text string")
    batch = spark.createDataFrame([("k1", "new"), ("k2", "b"), ("k2", "a"), (None, "z"), ("k3", "c")],
                                  "uniqueid string, text string")
    rows, report = L.insert_new(target, batch)
    assert sorted(tuple(r) for r in rows.collect()) == [("k2", "a"), ("k3", "c")]
    r = report.first()
    assert (r["offered"], r["rejected_null_key"], r["rejected_duplicate"], r["inserted"], r["rejected_existing"]) == \
        (5, 1, 1, 2, 1)


def test_upsert_counts_changes_and_is_idempotent(spark, tmp_path):
    target = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")], "uniqueid string, n long, t string")
    upd = spark.createDataFrame([("a", 1, "new"), ("b", 2, "x"), ("zz", 9, "q")], "uniqueid string, n long, t string")
    snap, changed = L.upsert(target, upd, ["n", "t"])
    assert changed.first()["rows_changed"] == 1
    assert sorted(tuple(r) for r in snap.collect()) == [("a", 1, "new"), ("b", 2, "x"), ("c", 3, "y")]
    path = L.write_snapshot(snap, str(tmp_path / "posts"), 1)
    again, changed2 = L.upsert(spark.read.parquet(path), upd, ["n", "t"])
    assert changed2.first()["rows_changed"] == 0


def test_upsert_adds_new_columns_and_null_overwrites(spark):
    target = spark.createDataFrame([("a", 1.0)], "uniqueid string, s double")
    upd = spark.createDataFrame([("a", None, 7)], "uniqueid string, s double, wc int")
    snap, changed = L.upsert(target, upd, ["s", "wc"])
    assert tuple(snap.first()) == ("a", None, 7)
    assert changed.first()[0] == 1


def test_history_roundtrip_and_missing_path(spark, tmp_path):
    missing = L.load_history(spark, str(tmp_path / "nope"))
    assert missing.count() == 0 and "actual_engagement" in missing.columns
    df = spark.createDataFrame([(1, 0, 1, "t", 2.0, False, None, None, ["a"], 0)], L.HISTORY_SCHEMA)
    L.write_results(df, str(tmp_path / "h"), "json")
    back = L.load_history(spark, str(tmp_path / "h"))
    assert back.collect() == df.collect()


def test_cap_per_author(spark, sample_posts):
    df = sample_posts.union(sample_posts.withColumn("uniqueid", F.concat("uniqueid", F.lit("b"))))
    got = L.cap_per_author(df, F.lit("2024-01-31").cast("timestamp"), 14, "en", 1).collect()
    assert sorted(r["uniqueid"] for r in got) == ["test1", "test2", "test3"]


def test_processing_options():
    o = L.ProcessingOptions.from_json('{"batch_size": 10, "max_tweets": 50, "min_word_count": 3, "foo": 1}')
    assert (o.batch_size, o.max_tweets, o.min_word_count, o.extra) == (10, 50, 3, {"foo": 1})
    assert L.ProcessingOptions.from_json(None).batch_size == 50


def test_history_json_array_file(spark, tmp_path):
    """The reference stores its history as one JSON array per file."""
    f = tmp_path / "optimization_history.json"
    f.write_text(json.dumps([{"seq": 1, "tweet": "a", "predicted_engagement": 1.5, "variations": ["a", "b"]},
                             {"seq": 2, "tweet": "b", "predicted_engagement": 2.0, "actual_engagement": 3.0}]))
    df = L.load_history(spark, str(f), multi_line=True)
    assert [r["seq"] for r in df.orderBy("seq").collect()] == [1, 2]


def test_insert_empty_batch(spark):
    target = spark.createDataFrame([("k1", "old")], "uniqueid string, text string")
    batch = spark.createDataFrame([], "uniqueid string, text string")
    rows, report = L.insert_new(target, batch)
    assert rows.count() == 0
    assert tuple(report.first()) == (0, 0, 0, 0, 0)


def test_batch_of_150_then_lookup_and_recent_order(spark, sample_posts):
    """The reference's storage tests: a 150-row batch insert, lookup by id,
    newest-first order."""
    from wren.operators import selection as S
    rows = [(f"batch{i}", f"Batch tweet {i}", f"user{i % 7}") for i in range(150)]
    batch = spark.createDataFrame(rows, "uniqueid string, text string, author_username string")
    target = sample_posts.select("uniqueid", "text", "author_username")
    fresh, report = L.insert_new(target, batch)
    assert report.first()["inserted"] == 150 and fresh.count() == 150
    table = target.unionByName(fresh)
    assert S.post_by_id(table, "batch42").first()["text"] == "Batch tweet 42"
    assert S.post_by_id(table, "missing").count() == 0


def test_last_update_of_a_key_wins(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "uniqueid string, n long")
    upd = spark.createDataFrame([("a", 10, 1), ("a", 30, 3), ("a", 20, 2), (None, 5, 9), ("c", 7, 1)], "uniqueid string, n long, seq long")
    snap, changed = L.upsert(target, upd, ["n"], sequence="seq")
    assert sorted(map(tuple, snap.collect())) == [("a", 30), ("b", 2)] and changed.first()[0] == 1
    assert L.upsert(target, upd.drop("seq"), ["n"])[0].count() == 2


def test_insert_keeps_texts_out_of_sorted_aggregates(spark):
    target = spark.createDataFrame([("a", "x", 1)], "uniqueid string, text string, n long")
    batch = spark.createDataFrame([("b", "y", 1), ("b", "z", 2), ("a", "q", 3), (None, "r", 4)], "uniqueid string, text string, n long")
    rows, report = L.insert_new(target, batch)
    assert [r["uniqueid"] for r in rows.collect()] == ["b"]
    plan = rows._jdf.queryExecution().executedPlan().toString() + report._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
