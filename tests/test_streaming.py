"""Streams equal their batch forms on the smallest test tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from wren.operators import lexicon as LX
from wren.operators import requests as RQ
from wren.operators import selection as S
from wren.sources import fixtures as FX
from wren.streaming import jobs as J
from wren.streaming.admission import closing_row
from wren.streaming.snapshots import SnapshotTable

from .conftest import SF001


def _staged(spark, df, col, files=4):
    path = J.run_folder(spark, "test-src")
    J.stage_files(df, path, col, files)
    return path


def _tables(spark):
    return LX.lexicon_table(spark), LX.topic_words_table(spark)


def test_stream_features_equal_batch(spark):
    p = FX.with_author_created(FX.posts(spark, SF001))
    got = J.stream_features(spark, _staged(spark, p, "created_at"), p.schema, *_tables(spark), FX.as_of_lit())
    exp = J.feature_columns(p.filter(S.needs_work_predicate() & S.not_finished()), *_tables(spark), FX.as_of_lit())
    assert sorted(got.collect(), key=str) == sorted(exp.collect(), key=str)


def test_snapshot_table(spark):
    """Keys sent again give one row, the newest; a replayed batch and a broken attempt change nothing; only the
    buckets that a batch touches are written."""
    schema = StructType([StructField("k", StringType()), StructField("v", IntegerType())])
    table = SnapshotTable(spark, J.run_folder(spark, "test-table"), "k", schema, buckets=4)
    assert table.read().collect() == [] and table.manifest()["batch_id"] == -1
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, at int")
    assert table.merge(rows(("a", 1, 1), ("a", 2, 2), ("b", 1, None), (None, 9, 9)), 0, "at")
    assert sorted(table.read().collect()) == [("a", 2), ("b", 1)]
    first = table.manifest()["folders"]
    spark.createDataFrame([("a", 77)], schema).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(
        f"{table.base}/data/batch=1")  # what a broken attempt left
    assert sorted(table.read().collect()) == [("a", 2), ("b", 1)]
    assert table.merge(rows(("b", 5, 1)), 1, "at") and not table.merge(rows(("b", 6, 1)), 1, "at")
    assert sorted(table.read().collect()) == [("a", 2), ("b", 5)]
    assert sum(first[b] != f for b, f in table.manifest()["folders"].items() if b in first) <= 1
    assert table.merge(rows().limit(0), 2) and sorted(table.read().collect()) == [("a", 2), ("b", 5)]
    assert SnapshotTable(spark, table.base, "k", schema, buckets=9).manifest()["buckets"] == 4


def test_stream_dedup_keeps_one_per_key(spark):
    p = FX.posts(spark, SF001).select("uniqueid", "created_at")
    path = _staged(spark, p.unionByName(p), "created_at")
    got = J.stream_dedup(spark, path, p.schema, "uniqueid", "created_at", "1 day")
    assert got.count() == p.count() == got.select("uniqueid").distinct().count()


def _admitted(df):
    return sorted((x["request_id"], x["accepted"]) for x in df.collect())


def test_stream_admission_equals_batch_on_shuffled_files(spark):
    """Files and rows out of time order within the delay: the decisions are those of the batch form."""
    r = FX.requests(spark, SF001).select("request_id", "client_id", "started_at")
    path = J.run_folder(spark, "test-src")
    for k in range(3):  # every file holds requests of all times
        r.filter(F.pmod(F.xxhash64("request_id"), F.lit(3)) == k).orderBy(F.xxhash64("request_id", F.lit(1))).coalesce(1) \
            .write.mode("append").parquet(path)
    closing_row(r, "started_at", 86400 * 400, 86400).write.mode("append").parquet(path)
    got = J.stream_admission(spark, path, r.schema, limit=2, window_s=86400, delay="400 days")
    exp = RQ.admission(r, limit=2, window_s=86400)
    assert _admitted(got) == _admitted(exp)
    assert exp.filter(~F.col("accepted")).count() > 0


def test_stream_admission_times_at_the_edges(spark):
    """Equal times go by request id, a request one window after an accepted one is accepted, state starts anew after
    an idle window, late requests and those without id get no decision, requests without client share one."""
    t0 = datetime(2024, 1, 1)
    rows = [(3, 1, t0), (1, 1, t0), (2, 1, t0), (4, 1, t0 + timedelta(seconds=60)), (5, 1, t0 + timedelta(seconds=59)),
            (6, 1, t0 + timedelta(minutes=30)), (7, None, t0), (8, None, t0), (9, None, t0 + timedelta(microseconds=1)),
            (None, 1, t0), (10, 2, None)]
    schema = "request_id long, client_id long, started_at timestamp"
    r = spark.createDataFrame(rows, schema)
    path, out = J.run_folder(spark, "test-src"), J.run_folder(spark, "test-out")
    r.coalesce(1).write.mode("append").parquet(path)
    closing_row(r, "started_at", 10, 60).write.mode("append").parquet(path)
    run = lambda: dict(_admitted(J.stream_admission(spark, path, r.schema, 2, 60, "10 seconds", out)))
    want = {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 8: True, 9: False}
    assert run() == want
    late = spark.createDataFrame([(11, 1, t0), (12, 1, t0 + timedelta(hours=2))], schema)
    late.coalesce(1).write.mode("append").parquet(path)
    closing_row(late, "started_at", 10, 60).write.mode("append").parquet(path)
    assert run() == {**want, 12: True}  # from the checkpoint: nothing is decided twice, 11 is late


def test_stream_post_counts_all_windows(spark):
    """The last windows are there too, each window once, and a second run goes on where the first ended."""
    p = FX.posts(spark, SF001).select("uniqueid", "created_at")
    path, out = J.run_folder(spark, "test-src"), J.run_folder(spark, "test-out")
    cut = p.agg(F.expr("percentile(unix_micros(created_at), 0.5)")).first()[0]
    for part in (F.unix_micros("created_at") <= cut, F.unix_micros("created_at") > cut):
        J.stage_files(p.filter(part), path, "created_at", 2)
        got = J.stream_post_counts(spark, path, p.schema, "created_at", "1 day", "1 hour", out)
        seen = p if got.agg(F.sum("n")).first()[0] == p.filter("created_at IS NOT NULL").count() else p.filter(part)
        exp = seen.filter("created_at IS NOT NULL").groupBy(F.window("created_at", "1 day").alias("w")).count()
        assert sorted((r[0], r[2]) for r in got.collect()) == sorted((r["w"]["start"], r["count"]) for r in exp.collect())
    assert seen is p


def test_progress_metrics(spark):
    b = spark.createDataFrame([(0, 10, 1, 0, 2.0), (1, 10, 0, 1, 2.0)],
                              "batch_id long, handled long, skipped long, errors long, seconds double")
    rows = J.progress_metrics(b, 40).orderBy("batch_id").collect()
    assert [r["progress_percentage"] for r in rows] == [25.0, 50.0]
    assert rows[1]["rows_per_second"] == 5.0 and rows[1]["estimated_time_remaining"] == 4.0


def test_stream_features_resume_from_checkpoint(spark):
    """A second run with the same output folder only processes new files and
    the combined output equals the batch result."""
    p = FX.with_author_created(FX.posts(spark, SF001))
    src = J.run_folder(spark, "test-resume-src")
    out = J.run_folder(spark, "test-resume-out")
    cut = p.agg(F.expr("percentile(unix_micros(created_at), 0.5)")).first()[0]
    first = p.filter(F.unix_micros("created_at") <= cut)
    second = p.filter(F.unix_micros("created_at") > cut)
    J.stage_files(first, src, "created_at", 2)
    n1 = J.stream_features(spark, src, p.schema, *_tables(spark), FX.as_of_lit(), out).count()
    J.stage_files(second, src, "created_at", 2)
    got = J.stream_features(spark, src, p.schema, *_tables(spark), FX.as_of_lit(), out)
    exp = J.feature_columns(p.filter(S.needs_work_predicate() & S.not_finished()), *_tables(spark), FX.as_of_lit())
    assert 0 < n1 < got.count()
    assert sorted(got.collect(), key=str) == sorted(exp.collect(), key=str)


def test_slices_have_equal_numbers_of_files(spark, monkeypatch):
    """A slice of many bytes is several files, a small one (and that of null times) has as many, and no row is lost or late."""
    t0 = datetime(2024, 1, 1)
    rows = [(f"k{i}", "x" * 200, t0 + timedelta(days=i // 40)) for i in range(400)] + [("none", "x", None)]
    df = spark.createDataFrame(rows, "uniqueid string, text string, created_at timestamp")
    monkeypatch.setattr(J, "FILE_BYTES", 8_000)
    twice = df.unionByName(df)
    path = J.stage_files(twice, J.run_folder(spark, "test-src"), "created_at", 4)
    assert path.files_per_slice > 1 and J._files_in(spark, path) == path.files_per_slice * 5
    got = J.stream_dedup(spark, path, df.schema, delay="1 day")
    assert sorted(r[0] for r in got.select("uniqueid").collect()) == sorted(r[0] for r in rows)


def test_files_are_bounded_where_times_are_missing_or_equal(spark, monkeypatch):
    """The largest slice sets the number of files: without times, or with one time for most rows, no file grows with them."""
    t0 = datetime(2024, 1, 1)
    monkeypatch.setattr(J, "FILE_BYTES", 8_000)
    for most in (None, t0 + timedelta(days=3)):
        rows = [(f"k{i}", "x" * 200, t0 + timedelta(days=i // 10) if i < 40 else most) for i in range(400)]
        df = spark.createDataFrame(rows, "uniqueid string, text string, created_at timestamp")
        path = J.stage_files(df, J.run_folder(spark, "test-src"), "created_at", 4)
        held = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.sum(F.length("text")).alias("b")).collect()
        assert max(r["b"] for r in held) <= 10_000
        assert sorted(r[0] for r in spark.read.parquet(path).select("uniqueid").collect()) == sorted(r[0] for r in rows)
        assert J._files_in(spark, path) % path.files_per_slice == 0
