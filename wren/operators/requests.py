"""Request-log operators: validation, admission, result reuse, metrics
(B11, C6, C7, D41-D43, S16, S22, T4 batch form, W2).

The reference serves these one request at a time behind a web API; here each
is a job over a table (or stream) of requests.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..session import scratch_path, stored
from .aggregates import rnd
from .windows import running_sum, top_n_per_group

# Request bounds and defaults, limits, histogram buckets.
TEXT_MIN, TEXT_MAX = 1, 280
ITER_MIN, ITER_MAX, ITER_DEFAULT = 1, 10, 1
VAR_MIN, VAR_MAX, VAR_DEFAULT = 1, 20, 5
REQUESTS_PER_MINUTE = 60
PREDICT_LATENCY_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0)
OPTIMIZE_LATENCY_BUCKETS = (0.5, 1.0, 2.0, 5.0, 10.0)
PREDICTED_ENGAGEMENT_BUCKETS = (10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
IMPROVEMENT_BUCKETS = (10.0, 25.0, 50.0, 100.0, 200.0, 500.0)
PREDICT_TTL_S = 3600


def endpoint_kind(endpoint: Column) -> Column:
    """Fixture rule: purchase/signup events stand for optimize calls, the rest for predict."""
    return F.when(endpoint.isin("purchase", "signup"), F.lit("optimize")).otherwise(F.lit("predict"))


# B11
def validate_requests(req: DataFrame) -> DataFrame:
    it = F.coalesce(F.col("iterations"), F.lit(ITER_DEFAULT))
    va = F.coalesce(F.col("variations"), F.lit(VAR_DEFAULT))
    n = F.length("text")
    reasons = F.filter(F.array(
        F.when(F.col("text").isNull(), F.lit("text_missing"))
        .when((n < TEXT_MIN) | (n > TEXT_MAX), F.lit("text_length")),
        F.when((it < ITER_MIN) | (it > ITER_MAX), F.lit("iterations")),
        F.when((va < VAR_MIN) | (va > VAR_MAX), F.lit("variations")),
    ), lambda x: x.isNotNull())
    return req.select("request_id", it.alias("iterations"), va.alias("variations"),
                      (F.size(reasons) == 0).alias("is_valid"), F.array_join(reasons, ",").alias("reject_reasons"))


# S22
def result_key(kind: Column, text: Column, iterations: Column, variations: Column) -> Column:
    return F.when(kind == "optimize",
                  F.concat_ws(":", F.lit("optimize"), text, iterations.cast("string"), variations.cast("string"))) \
        .otherwise(F.concat_ws(":", F.lit("predict"), text))


# C6
def reuse_scored(keys: DataFrame, scored: DataFrame, as_of: Column, ttl_s: int, score_fn, row: str | None = None,
                 rows_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Serve fresh cached results, compute the misses once per distinct key.

    ``keys(key, text)``; ``scored(key, result, scored_at)``.  Returns one row per
    distinct key with ``hit`` and ``result``.  Keys hold whole texts, so they are
    grouped and joined by their digest; the expensive scoring runs only where
    the one left join found nothing.

    With ``row``, a column that numbers the rows of ``keys``, keys should be digests
    themselves: one row of each key stands for it, and only the rows of the keys
    that were not found are read again with their texts.  ``rows_of`` reads them: it gets
    their numbers (one column) and returns those rows of ``keys``.  Without it they are
    picked from ``keys``, whose texts are shuffled for that if Spark can't pick them earlier.
    """
    digest = F.md5("key")
    fresh = scored.filter(F.col("scored_at") > as_of - F.make_dt_interval(secs=F.lit(ttl_s)))
    fresh = fresh.select(digest.alias("_id"), "result", "scored_at").groupBy("_id").agg(
        F.max_by("result", "scored_at").alias("_found"), F.lit(True).alias("_hit"))
    if row:
        ranked = keys.select("key", row, F.xxhash64("text").alias("_h"))
        first = ranked.groupBy("key").agg(F.min_by(row, F.struct("_h", row)).alias("_row"))
        joined = first.withColumn("_id", digest).join(fresh, "_id", "left").withColumn("hit", F.coalesce("_hit", F.lit(False)))
        joined = stored(joined.select("key", "_row", "hit", F.col("_found").alias("result")), "reused")
        missed = joined.filter(~F.col("hit"))
        numbers = missed.select("_row").distinct()
        again = rows_of(numbers) if rows_of else keys.join(numbers, F.col(row).eqNullSafe(F.col("_row")), "left_semi")
        again = again.select("key", F.xxhash64("text").alias("_h"), score_fn(F.col("text")).alias("result"))
        again = top_n_per_group(again.join(missed.select(F.col("key").alias("_key")), F.col("key").eqNullSafe(F.col("_key")), "left_semi"),
                                ["key"], [F.asc("_h")], 1)
        return joined.filter("hit").select("key", "hit", "result").unionByName(again.select("key", F.lit(False).alias("hit"), "result"))
    distinct = top_n_per_group(keys.select(digest.alias("_id"), "key", "text"), ["_id"], [F.asc(F.xxhash64("text"))], 1)
    joined = distinct.join(fresh, "_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return joined.select("key", hit.alias("hit"), F.when(hit, F.col("_found")).otherwise(score_fn(F.col("text"))).alias("result"))


def store_scored(scored: DataFrame, served: DataFrame, as_of: Column) -> DataFrame:
    """The cache after a run: ``scored`` plus the results that ``reuse_scored`` had to compute."""
    return scored.unionByName(served.filter(~F.col("hit")).select("key", "result", as_of.alias("scored_at")))


# C7
def purge_scored(scored: DataFrame, pattern: str) -> DataFrame:
    """Drop keys matching a glob pattern (``*`` any run, ``?`` one char)."""
    like = pattern.replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return scored.filter(~F.col("key").like(like))


# D41
def request_counters(req: DataFrame) -> DataFrame:
    return req.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


# D42 / D43
def cumulative_histogram(df: DataFrame, value: str, buckets: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """Prometheus-style cumulative buckets (``le``), plus sum and count, one pass."""
    by = by or []
    v = F.col(value)
    aggs = [F.count_if(v <= F.lit(b)).alias(f"le_{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(v).alias("le_inf"), rnd(F.sum(v)).alias("value_sum")]
    wide = df.groupBy(*by).agg(*aggs)
    pairs = ", ".join([f"'{b:g}', le_{i}" for i, b in enumerate(buckets)] + ["'+Inf', le_inf"])
    stack = f"stack({len(buckets) + 1}, {pairs}) AS (le, n)"
    return wide.selectExpr(*[f"`{c}`" for c in by], stack, "value_sum")


# W2
def in_flight(req: DataFrame) -> DataFrame:
    """Concurrent requests per endpoint after every start (+1) and end (-1)."""
    start = F.unix_micros("started_at")
    end = start + F.round(F.col("latency_s") * 1_000_000).cast("long")
    ev = req.select("endpoint", "request_id",
                    F.explode(F.array(F.struct(start.alias("t_us"), F.lit(1).alias("delta")),
                                      F.struct(end.alias("t_us"), F.lit(-1).alias("delta")))).alias("e"))
    ev = ev.select("endpoint", "request_id", "e.t_us", "e.delta")
    return running_sum(ev, "endpoint", ["t_us", "delta", "request_id"], "delta", "in_flight")


# T4 (batch form)
def _admit_fn(limit: int, window_us: int, carried: dict[int, list[int]]):
    """Fold of rows sorted by (range, client, time, id); the first client of a range starts with the times ``carried`` there."""
    def run(batches):
        cur_range = cur_client = None
        accepted: deque = deque()
        for pdf in batches:
            ranges, clients, times = pdf["rng"].to_numpy(), pdf["client"].tolist(), pdf["t_us"].to_numpy()
            out = np.empty(len(pdf), dtype=bool)
            for i in range(len(pdf)):
                r, c, t = int(ranges[i]), clients[i], int(times[i])
                if r != cur_range:
                    cur_range, cur_client, accepted = r, c, deque(carried.get(r, ()))
                elif c != cur_client:
                    cur_client, accepted = c, deque()
                while accepted and accepted[0] <= t - window_us:
                    accepted.popleft()
                out[i] = len(accepted) < limit
                if out[i]:
                    accepted.append(t)
            yield pd.DataFrame({"request_id": pdf["request_id"], "client": clients, "t_us": times, "rng": ranges, "accepted": out})
    return run


def _fold_ranges(ranged: DataFrame, limit: int, window_us: int, carried: dict[int, list[int]], tasks: int) -> DataFrame:
    """Decisions of whole ranges, each folded by one task."""
    dealt = ranged.repartitionByRange(tasks, "rng").sortWithinPartitions("rng", "client", "t_us", "request_id")
    return dealt.select("request_id", "client", "t_us", "rng").mapInPandas(
        _admit_fn(limit, window_us, carried), "request_id long, client string, t_us long, rng int, accepted boolean")


def admission(req: DataFrame, limit: int = REQUESTS_PER_MINUTE, window_s: int = 60,
              partitions: int | None = None) -> DataFrame:
    """Sliding-window admission per client where rejected requests do not count.

    The decision is a fold over a client's requests in order of (time, id).  The
    requests are dealt to sorted ranges of (client, time, id), so a client with any
    share of them spreads over many, and every range is folded by itself as if
    nothing came before it.  What a range hands on is the accepted times of the last window of its
    last client, ``limit`` at most.  Where the next range goes on with that
    client inside the window, its guess of an empty start was wrong and it is folded
    again from those times; this goes on with the ranges whose start has changed.
    After an idle window the state is empty, and two folds that once accept the
    same window go on alike, so few ranges run more than twice.  Each
    round is stored, a range's last round counts, and the driver sees one start of
    at most ``limit`` times per range.

    Requests without a time or an id get no decision; those without a client share one.
    """
    spark = req.sparkSession
    window_us = window_s * 1_000_000
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    client = F.coalesce(F.concat(F.lit("="), F.col("client_id").cast("string")), F.lit(""))
    base = req.filter(F.col("started_at").isNotNull() & F.col("request_id").isNotNull()).select(
        "request_id", client.alias("client"), F.unix_micros("started_at").alias("t_us"))
    order = ["client", "t_us", "request_id"]
    home = scratch_path(spark, f"admission-{uuid.uuid4().hex}")
    # Range bounds come from a sample; the ranged rows are stored once, one folder per range.
    base.repartitionByRange(n, *order).withColumn("rng", F.spark_partition_id()).write.partitionBy("rng").parquet(f"{home}/ranged")
    ranged = spark.read.schema(StructType([*base.schema.fields, StructField("rng", IntegerType())])).parquet(f"{home}/ranged")

    edges = {r["rng"]: r for r in ranged.groupBy("rng").agg(
        F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last")).collect()}
    before = dict(zip(sorted(edges)[1:], sorted(edges)))  # range -> the one in front of it
    goes_on = [r for r, b in before.items() if edges[r]["first"]["client"] == edges[b]["last"]["client"]
               and edges[r]["first"]["t_us"] < edges[b]["last"]["t_us"] + window_us]
    starts: dict[int, list[int]] = {}
    last_round = dict.fromkeys(edges, 0)
    run, at = sorted(edges), 0
    while run:
        part = ranged.filter(F.col("rng").isin(run)) if at else ranged
        _fold_ranges(part, limit, window_us, starts, min(n, len(run))).write.parquet(f"{home}/decided/round={at}")
        last_round.update(dict.fromkeys(run, at))
        handing = {before[r] for r in goes_on} & set(run)
        if not handing:
            break
        tails = spark.createDataFrame([(b, edges[b]["last"]["client"], edges[b]["last"]["t_us"]) for b in handing],
                                      "rng int, client string, tail long")  # one row per range
        held = spark.read.parquet(f"{home}/decided/round={at}").filter("accepted").join(F.broadcast(tails), ["rng", "client"]).filter(
            F.col("t_us") > F.col("tail") - window_us)
        # At most ``limit`` times of one window per range.
        got = {r["rng"]: sorted(r["times"]) for r in held.groupBy("rng").agg(F.collect_list("t_us").alias("times")).collect()}
        run = []
        for r in goes_on:
            if before[r] in handing:
                # A range may be shorter than a window: what it was handed itself is then still in force behind it.
                b = before[r]
                own = starts.get(b, []) if edges[b]["first"]["client"] == edges[b]["last"]["client"] else []
                start = [t for t in sorted(own + got.get(b, [])) if t > edges[r]["first"]["t_us"] - window_us]
                if start != starts.get(r, []):
                    starts[r] = start
                    run.append(r)
        at += 1
    if not edges:
        decided = spark.createDataFrame([], StructType([*base.schema.fields, StructField("accepted", BooleanType())]))
    else:
        rounds = spark.createDataFrame(list(last_round.items()), "rng int, round int")  # one row per range
        decided = spark.read.option("basePath", f"{home}/decided").parquet(f"{home}/decided").join(F.broadcast(rounds), ["rng", "round"])
    named = F.when(F.col("client") != "", F.substring("client", 2, 2**31 - 1)).cast(req.schema["client_id"].dataType)
    return decided.select("request_id", "accepted", named.alias("client_id"), F.timestamp_micros("t_us").alias("started_at"))
