"""Named queries over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import engagement as E
from ..operators import requests as RQ
from ..operators.feedback import history_progress
from ..sources import fixtures as FX
from .catalog import register
from .views_sql import with_views as V

_KIND_SQL = "CASE WHEN endpoint IN ('purchase', 'signup') THEN 'optimize' ELSE 'predict' END"
_KEY_SQL = f"""CASE WHEN {_KIND_SQL} = 'optimize'
  THEN concat_ws(':', 'optimize', text, cast(coalesce(iterations, 1) AS varchar), cast(coalesce(variations, 5) AS varchar))
  ELSE concat_ws(':', 'predict', text) END"""


def req(spark, sf):
    return FX.requests(spark, sf)


@register("valid_requests", "B11", V("""
SELECT request_id, coalesce(iterations, 1) AS iterations, coalesce(variations, 5) AS variations,
  len(reasons) = 0 AS is_valid, array_to_string(reasons, ',') AS reject_reasons
FROM (SELECT request_id, iterations, variations, list_filter([
    CASE WHEN text IS NULL THEN 'text_missing' WHEN length(text) < 1 OR length(text) > 280 THEN 'text_length' END,
    CASE WHEN coalesce(iterations, 1) < 1 OR coalesce(iterations, 1) > 10 THEN 'iterations' END,
    CASE WHEN coalesce(variations, 5) < 1 OR coalesce(variations, 5) > 20 THEN 'variations' END],
    lambda x: x IS NOT NULL) AS reasons FROM requests)""", "requests"))
def q_valid_requests(spark, sf):
    return RQ.validate_requests(req(spark, sf))


def _keyed(r):
    kind = RQ.endpoint_kind(F.col("endpoint"))
    key = RQ.result_key(kind, F.col("text"), F.coalesce("iterations", F.lit(1)), F.coalesce("variations", F.lit(5)))
    return r.select("request_id", key.alias("key"), "text")


def _keys(spark, sf):
    return _keyed(req(spark, sf))


def _scored_table(keys):
    """Cache table fixture: half of the distinct keys (by their first request
    id), scored ``first_id % 7200`` seconds before ``as_of``."""
    first = keys.groupBy("key").agg(F.min("request_id").alias("rid"))
    return first.filter(F.col("rid") % 2 == 0).select(
        "key", F.lit("cached").alias("result"),
        (FX.as_of_lit() - F.make_dt_interval(secs=(F.col("rid") % 7200).cast("decimal(18,6)"))).alias("scored_at"))


_SCORED_CTE = f"""keys AS (SELECT request_id, {_KEY_SQL} AS key, text FROM requests),
scored AS (SELECT key, 'cached' AS result,
  timestamp '2024-01-31 00:00:00' - (min(request_id) % 7200) * INTERVAL 1 SECOND AS scored_at
  FROM keys GROUP BY key HAVING min(request_id) % 2 = 0)"""


_SERVED_SQL = """
SELECT md5(k.key) AS key_md5, f.key IS NOT NULL AS hit,
  CASE WHEN f.key IS NOT NULL THEN f.result
       ELSE cast(round(least(0.95, greatest(0.5, length(k.text) / 100.0)), 6) AS varchar) END AS result
FROM (SELECT key, min(text) AS text FROM keys GROUP BY key) k
LEFT JOIN (SELECT key, arg_max(result, scored_at) AS result FROM scored
           WHERE scored_at > timestamp '2024-01-31 00:00:00' - INTERVAL 3600 SECOND GROUP BY key) f ON k.key = f.key"""


def _served(spark, sf, keys, scored):
    return RQ.reuse_scored(keys, scored, FX.as_of_lit(), RQ.PREDICT_TTL_S,
                           lambda t: F.round(E.confidence(F.length(t) / F.lit(1.0)), 6).cast("string"), "request_id",
                           lambda ids: _digested(_keyed(FX.requests_of(spark, sf, ids))))


def _digested(keys):
    """Requests under the digests of their keys, which hold whole texts."""
    return keys.withColumn("key", F.md5("key"))


def _digests(spark, sf):
    return _digested(_keys(spark, sf))


@register("reuse_scored", "C6 S22 S16", V(_SERVED_SQL, "requests", extra=(_SCORED_CTE,)))
def q_reuse_scored(spark, sf):
    keys = _digests(spark, sf)
    return _served(spark, sf, keys, _scored_table(keys)).select(F.col("key").alias("key_md5"), "hit", "result")


@register("store_scored", "C6", V(f"""
SELECT md5(key) AS key_md5, result, scored_at FROM scored
UNION ALL SELECT key_md5, result, timestamp '2024-01-31 00:00:00' FROM ({_SERVED_SQL}) WHERE NOT hit""",
                                  "requests", extra=(_SCORED_CTE,)))
def q_store_scored(spark, sf):
    """The result cache after the run."""
    keys = _digests(spark, sf)
    scored = _scored_table(keys)
    return RQ.store_scored(scored, _served(spark, sf, keys, scored), FX.as_of_lit()).select(
        F.col("key").alias("key_md5"), "result", "scored_at")


@register("purge_scored", "C7", V("""
SELECT count(*) AS remaining FROM scored WHERE NOT (key LIKE 'predict:%')""", "requests", extra=(_SCORED_CTE,)))
def q_purge_scored(spark, sf):
    left = RQ.purge_scored(_scored_table(_keys(spark, sf)), "predict:*")
    return left.agg(F.count(F.lit(1)).alias("remaining"))


@register("request_counters", "D41", V("""
SELECT endpoint, status, count(*) AS requests FROM requests GROUP BY 1, 2""", "requests"))
def q_request_counters(spark, sf):
    return RQ.request_counters(req(spark, sf))


def _hist_sql(table: str, value: str, buckets, by: str | None) -> str:
    sel_by = f"{by}, " if by else ""
    parts = []
    for b in buckets:
        parts.append(f"SELECT {sel_by}'{b:g}' AS le, count_if({value} <= {b}) AS n, round(sum({value}), 6) AS value_sum "
                     f"FROM {table}{' GROUP BY ' + by if by else ''}")
    parts.append(f"SELECT {sel_by}'+Inf' AS le, count({value}) AS n, round(sum({value}), 6) AS value_sum "
                 f"FROM {table}{' GROUP BY ' + by if by else ''}")
    return "\nUNION ALL\n".join(parts)


@register("latency_histogram", "D42", V(_hist_sql("requests", "latency_s", RQ.PREDICT_LATENCY_BUCKETS, "endpoint"),
                                        "requests"))
def q_latency_histogram(spark, sf):
    return RQ.cumulative_histogram(req(spark, sf), "latency_s", RQ.PREDICT_LATENCY_BUCKETS, ["endpoint"])


@register("score_histogram", "D43", V(_hist_sql("history", "predicted_engagement",
                                                RQ.PREDICTED_ENGAGEMENT_BUCKETS, None), "history"))
def q_score_histogram(spark, sf):
    return RQ.cumulative_histogram(FX.history(spark, sf), "predicted_engagement", RQ.PREDICTED_ENGAGEMENT_BUCKETS)


@register("improvement_histogram", "D43 D36", V(_hist_sql("""(SELECT round(CASE WHEN arg_min(predicted_engagement, iteration) > 0
        THEN (arg_max(predicted_engagement, iteration) / arg_min(predicted_engagement, iteration) - 1) * 100
        ELSE 0.0 END, 6) + 0.0 AS improvement_pct FROM history GROUP BY run_id)""", "improvement_pct",
                                                          RQ.IMPROVEMENT_BUCKETS, None), "history"))
def q_improvement_histogram(spark, sf):
    prog = history_progress(FX.history(spark, sf))
    return RQ.cumulative_histogram(prog, "improvement_pct", RQ.IMPROVEMENT_BUCKETS)


@register("in_flight", "W2", V("""
SELECT endpoint, request_id, t_us, delta,
  sum(delta) OVER (PARTITION BY endpoint ORDER BY t_us, delta, request_id ROWS UNBOUNDED PRECEDING) AS in_flight
FROM (SELECT endpoint, request_id, epoch_us(started_at) AS t_us, 1 AS delta FROM requests
      UNION ALL
      SELECT endpoint, request_id, epoch_us(started_at) + cast(round(latency_s * 1000000) AS BIGINT), -1 FROM requests)""",
                               "requests"))
def q_in_flight(spark, sf):
    return RQ.in_flight(req(spark, sf))


def admission_sql(limit: int, window_s: int, columns: str = "request_id, client_id, accepted") -> str:
    """Sliding-window admission as a recursive query: one step per request of a client, which carries the accepted times."""
    return V(f"""SELECT {columns} FROM (WITH RECURSIVE r AS (
  SELECT request_id, client_id, started_at, epoch_us(started_at) AS t,
    row_number() OVER (PARTITION BY client_id ORDER BY started_at, request_id) AS n
  FROM requests WHERE started_at IS NOT NULL),
fold AS (
  SELECT client_id, cast(0 AS BIGINT) AS n, cast(NULL AS BIGINT) AS request_id, cast(NULL AS TIMESTAMP) AS started_at,
    cast([] AS BIGINT[]) AS held, false AS accepted
  FROM (SELECT DISTINCT client_id FROM r)
  UNION ALL
  SELECT client_id, n, request_id, started_at,
    CASE WHEN len(live) < {limit} THEN list_append(live, t) ELSE live END, len(live) < {limit}
  FROM (SELECT r.client_id, r.n, r.request_id, r.started_at, r.t,
          list_filter(f.held, lambda a: a > r.t - {window_s * 1_000_000}) AS live
        FROM fold f JOIN r ON r.client_id = f.client_id AND r.n = f.n + 1))
SELECT * FROM fold WHERE n > 0)""", "requests")


_ADMITTED = "request_id, client_id, accepted, started_at"


@register("stream_admission_batch", "T4", admission_sql(60, 60, _ADMITTED))
def q_stream_admission_batch(spark, sf):
    """Reference default: 60 accepted requests per client per sliding minute."""
    return RQ.admission(req(spark, sf))


@register("admission_hourly_3", "T4", admission_sql(3, 3600, _ADMITTED))
def q_admission_hourly_3(spark, sf):
    """Same operator with a tight limit (3 per hour) so rejections occur in the test data."""
    return RQ.admission(req(spark, sf), limit=3, window_s=3600)
