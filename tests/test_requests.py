"""Request validation bounds, admission against a sequential loop, metrics."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta

from wren.operators import requests as RQ


def test_validation_bounds(spark):
    rows = [(1, "ok", None, None), (2, "", 1, 1), (3, "x" * 281, 1, 1), (4, "x" * 280, 10, 20), (5, "t", 0, 5),
            (6, "t", 11, 5), (7, "t", 1, 0), (8, "t", 1, 21), (9, None, 1, 1)]
    df = spark.createDataFrame(rows, "request_id long, text string, iterations long, variations long")
    got = {r["request_id"]: (r["is_valid"], r["reject_reasons"], r["iterations"], r["variations"])
           for r in RQ.validate_requests(df).collect()}
    assert got[1] == (True, "", 1, 5)
    assert got[2][1] == "text_length" and got[3][1] == "text_length" and got[4][0]
    assert got[5][1] == "iterations" and got[6][1] == "iterations"
    assert got[7][1] == "variations" and got[8][1] == "variations"
    assert got[9][1] == "text_missing"


def loop_admission(rows, limit, window):
    acc = defaultdict(list)
    out = {}
    for rid, client, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        acc[client] = [t for t in acc[client] if t > ts - window]
        if len(acc[client]) >= limit:
            out[rid] = False
        else:
            acc[client].append(ts)
            out[rid] = True
    return out


def test_admission_equals_loop_and_62nd_is_refused(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, 1, t0 + timedelta(milliseconds=500 * i)) for i in range(62)]          # 62 in 31 s
    rows += [(100 + i, 2, t0 + timedelta(seconds=20 * i)) for i in range(30)]          # slow client
    rows += [(200 + i, 3, t0 + timedelta(seconds=i % 90, microseconds=i)) for i in range(300)]  # bursty
    rows += [(900, 1, t0 + timedelta(seconds=60, milliseconds=1))]                     # after the window
    df = spark.createDataFrame(rows, "request_id long, client_id long, started_at timestamp")
    got = {r["request_id"]: r["accepted"] for r in RQ.admission(df, 60, 60).collect()}
    exp = loop_admission([(r, c, t.timestamp()) for r, c, t in rows], 60, 60)
    assert got == exp
    assert got[59] is True and got[60] is False and got[61] is False


def test_cumulative_histogram(spark):
    df = spark.createDataFrame([(0.05,), (0.3,), (0.3,), (4.0,), (20.0,)], "v double")
    got = {r["le"]: r["n"] for r in RQ.cumulative_histogram(df, "v", RQ.PREDICT_LATENCY_BUCKETS).collect()}
    assert got == {"0.1": 1, "0.5": 3, "1": 3, "2": 3, "5": 4, "+Inf": 5}


def test_in_flight(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, "p", t0, 2.0), (2, "p", t0 + timedelta(seconds=1), 2.0), (3, "p", t0 + timedelta(seconds=5), 1.0)]
    df = spark.createDataFrame(rows, "request_id long, endpoint string, started_at timestamp, latency_s double")
    got = [r["in_flight"] for r in RQ.in_flight(df).orderBy("t_us", "delta", "request_id").collect()]
    assert got == [1, 2, 1, 0, 1, 0]


def test_reuse_scored_scores_misses_once(spark):
    from pyspark.sql import functions as F
    keys = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", "z")], "key string, text string")
    scored = spark.createDataFrame([("a", "old", datetime(2024, 1, 30, 23, 30)), ("b", "stale", datetime(2024, 1, 30, 20))],
                                   "key string, result string, scored_at timestamp")
    got = {r["key"]: (r["hit"], r["result"]) for r in RQ.reuse_scored(
        keys, scored, F.lit("2024-01-31 00:00:00").cast("timestamp"), 3600, lambda t: F.upper(t)).collect()}
    assert got == {"a": (True, "old"), "b": (False, "Y"), "c": (False, "Z")}


def test_purge_scored_pattern(spark):
    df = spark.createDataFrame([("predict:a",), ("optimize:a:1:5",), ("predict_x",)], "key string")
    assert sorted(r[0] for r in RQ.purge_scored(df, "predict:*").collect()) == ["optimize:a:1:5", "predict_x"]


def test_admission_of_one_client_spreads_over_ranges(spark, monkeypatch):
    """A client that is never idle: every range is folded by itself, only ranges whose start changed run again, and the
    decisions are those of the plain loop."""
    import random
    rng = random.Random(6)
    t0, at, rows = datetime(2024, 1, 1), 0.0, []
    for i in range(20_000):
        at += rng.choice([0.0, 0.01, 0.4, 0.9, 1.5])
        rows.append((i, 7 if i % 50 else i % 3, t0 + timedelta(seconds=at)))
    rows += [(50_000 + i, None, t0 + timedelta(seconds=i)) for i in range(100)] + [(None, 7, t0), (60_000, 7, None)]
    df = spark.createDataFrame(rows, "request_id long, client_id long, started_at timestamp").repartition(8)
    folded, fold = [], RQ._fold_ranges

    def spy(part, *args):
        folded.append(part.select("rng").distinct().count())
        return fold(part, *args)

    monkeypatch.setattr(RQ, "_fold_ranges", spy)
    got = {r["request_id"]: r["accepted"] for r in RQ.admission(df, 20, 60, partitions=12).collect()}
    known = [(r, -1 if c is None else c, t.timestamp()) for r, c, t in rows if r is not None and t]
    assert got == loop_admission(known, 20, 60)
    assert folded[0] == 12 and sum(folded[1:]) < 12 * 12 and all(n < 12 for n in folded[1:])
    assert sum(got.values()) < len(got)


def test_admission_window_longer_than_a_range(spark):
    """Times handed on through ranges that lie inside one window."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, 1, t0 + timedelta(seconds=i)) for i in range(400)]
    df = spark.createDataFrame(rows, "request_id long, client_id long, started_at timestamp")
    for limit in (1, 5, 250):
        got = {r["request_id"]: r["accepted"] for r in RQ.admission(df, limit, 300, partitions=10).collect()}
        assert got == loop_admission([(r, c, t.timestamp()) for r, c, t in rows], limit, 300)
    assert RQ.admission(df.limit(0)).collect() == []


def test_reuse_scored_by_row_numbers(spark):
    """With row numbers the texts of found keys aren't read again; repeated and null numbers and keys change nothing."""
    from pyspark.sql import functions as F
    rows = [("a", "x", 1), ("a", "x", 1), ("b", "y", 2), ("c", "z", 2), ("d", "w", None), (None, "v", 3)]
    keys = spark.createDataFrame(rows, "key string, text string, n long")
    scored = spark.createDataFrame([("a", "old", datetime(2024, 1, 30, 23, 30)), ("b", "stale", datetime(2024, 1, 30, 20))],
                                   "key string, result string, scored_at timestamp")
    run = lambda *more: sorted(map(repr, RQ.reuse_scored(
        keys, scored, F.lit("2024-01-31 00:00:00").cast("timestamp"), 3600, lambda t: F.upper(t), *more).collect()))
    assert run("n") == run()
