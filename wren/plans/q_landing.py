"""Named queries for landing, insert and upsert (A*, C3-C5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import landing as L
from ..operators import lexicon as LX
from ..operators import selection as S
from ..sources import fixtures as FX
from .catalog import register
from .q_text import PROCESSED_SQL
from .views_sql import with_views as V

_LANDED_SQL = r"""
SELECT concat(cast(doc_id AS varchar), '_20250323182115') AS uniqueid, cast(doc_id AS varchar) AS id, text,
  CASE WHEN doc_id % 23 = 0 THEN 'n/a' ELSE cast(like_count AS varchar) END AS likeCount,
  author_username AS author_userName, author_followers, author_following,
  array_to_string(regexp_extract_all(text, '#([\p{L}\p{N}_]+)', 1), ',') AS hashtags,
  timestamp '2025-03-23 18:21:15' AS finishedAt, 'tweet' AS type
FROM posts WHERE doc_id % 9 <> 0"""


def landed(spark, sf):
    return L.land(FX.landing(spark, sf))


@register("landing_flatten", "A1 A2 A3 A5 A6", V(_LANDED_SQL, "posts"))
def q_landing_flatten(spark, sf):
    return landed(spark, sf)


@register("landing_union", "A4", V(r"""
SELECT uniqueid, text, author_userName, NULL::VARCHAR AS lang FROM (""" + _LANDED_SQL + r""")
UNION ALL
SELECT uniqueid, text, author_username AS author_userName, lang FROM posts""", "posts"))
def q_landing_union(spark, sf):
    a = landed(spark, sf).select("uniqueid", "text", "author_userName")
    b = FX.posts(spark, sf).select("uniqueid", "text", F.col("author_username").alias("author_userName"), "lang")
    return L.union_batches(a, b)


@register("following_usernames", "A7", V("""
SELECT DISTINCT author_username AS userName FROM posts WHERE doc_id % 9 <> 0 AND author_username IS NOT NULL
ORDER BY userName LIMIT 100""", "posts"))
def q_following_usernames(spark, sf):
    return L.following_usernames(landed(spark, sf), 100)


@register("cap_per_author", "A8", V("""
SELECT uniqueid, author_username, created_at FROM (
  SELECT uniqueid, author_username, created_at,
    row_number() OVER (PARTITION BY author_username ORDER BY created_at DESC, uniqueid) AS rn
  FROM posts WHERE created_at >= timestamp '2024-01-31 00:00:00' - INTERVAL 14 DAY AND lang = 'en'
    AND coalesce(like_count, 0) >= 1)
WHERE rn <= 5""", "posts"))
def q_cap_per_author(spark, sf):
    out = L.cap_per_author(FX.posts(spark, sf), FX.as_of_lit(), within_days=14, lang="en", max_items=5, min_likes=1)
    return out.select("uniqueid", "author_username", "created_at")


_INSERT_SQL = """
SELECT count(*) AS offered, count_if(k IS NULL) AS rejected_null_key,
  coalesce((SELECT sum(n - 1) FROM (SELECT k, count(*) AS n FROM batch WHERE k IS NOT NULL GROUP BY k)), 0)::BIGINT
    AS rejected_duplicate,
  (SELECT count(*) FROM (SELECT DISTINCT k FROM batch WHERE k IS NOT NULL)
     WHERE k NOT IN (SELECT uniqueid FROM posts WHERE processed = 'completed')) AS inserted,
  count(*) - count_if(k IS NULL)
    - coalesce((SELECT sum(n - 1) FROM (SELECT k, count(*) AS n FROM batch WHERE k IS NOT NULL GROUP BY k)), 0)::BIGINT
    - (SELECT count(*) FROM (SELECT DISTINCT k FROM batch WHERE k IS NOT NULL)
         WHERE k NOT IN (SELECT uniqueid FROM posts WHERE processed = 'completed')) AS rejected_existing
FROM batch"""


def _insert_batch(spark, sf):
    """Landed items keyed like the post table, plus the re-sent short replies
    (a second delivery of the same keys) and items without an id."""
    lnd = landed(spark, sf)
    key = F.when(F.col("id").rlike("^[0-9]+$") & (F.col("id").cast("long") % 7 != 5),
                 F.concat(F.lit("t"), F.col("id")))
    first = lnd.select(key.alias("uniqueid"), "text", "author_userName")
    again = lnd.filter(F.col("text").startswith("@")).select(key.alias("uniqueid"), "text", "author_userName")
    return first.unionByName(again)


_BATCH_CTE = r"""batch AS (
  SELECT CASE WHEN doc_id % 7 <> 5 THEN concat('t', cast(doc_id AS varchar)) END AS k FROM posts WHERE doc_id % 9 <> 0
  UNION ALL
  SELECT CASE WHEN doc_id % 7 <> 5 THEN concat('t', cast(doc_id AS varchar)) END AS k FROM posts
  WHERE doc_id % 9 <> 0 AND starts_with(text, '@'))"""


@register("insert_new_posts", "A9 C4", V(_INSERT_SQL, "posts", extra=(_BATCH_CTE,)))
def q_insert_new_posts(spark, sf):
    target = FX.posts(spark, sf).filter(F.col("processed") == "completed")
    _, report = L.insert_new(target, _insert_batch(spark, sf))
    return report.select("offered", "rejected_null_key", "rejected_duplicate", "inserted", "rejected_existing")


@register("insert_new_rows", "A9 C4", V(r"""
SELECT DISTINCT k AS uniqueid FROM batch
WHERE k IS NOT NULL AND k NOT IN (SELECT uniqueid FROM posts WHERE processed = 'completed')""", "posts", extra=(_BATCH_CTE,)))
def q_insert_new_rows(spark, sf):
    """Keys of the appended rows, one row per key."""
    target = FX.posts(spark, sf).filter(F.col("processed") == "completed")
    rows, _ = L.insert_new(target, _insert_batch(spark, sf))
    return rows.select("uniqueid")


@register("duplicate_keys", "D9", V("""
SELECT k AS uniqueid, count(*) AS n FROM batch GROUP BY k HAVING count(*) > 1""", "posts", extra=(_BATCH_CTE,)))
def q_duplicate_keys(spark, sf):
    """Keys that a delivery carries more than once (null keys count as one)."""
    from ..operators.aggregates import duplicate_ids
    return duplicate_ids(_insert_batch(spark, sf).select("uniqueid"))


@register("ingest_log", "A10", V("""
SELECT '2025-03-23 18:21:15: ' || cast(count(*) AS varchar) || ' rows added' AS line,
  timestamp '2025-03-23 18:21:15' AS run_at, count(*) AS rows_added FROM posts WHERE doc_id % 9 <> 0""", "posts"))
def q_ingest_log(spark, sf):
    return L.ingest_log(landed(spark, sf))


_UPSERT_SQL = r"""
SELECT p.uniqueid,
  CASE WHEN u.uniqueid IS NOT NULL THEN u.text_length ELSE p.text_length END AS text_length,
  CASE WHEN u.uniqueid IS NOT NULL THEN u.sentiment ELSE p.sentiment END AS sentiment,
  CASE WHEN u.uniqueid IS NOT NULL THEN u.topics ELSE p.topics END AS topics,
  CASE WHEN u.uniqueid IS NOT NULL THEN u.processed ELSE p.processed END AS processed,
  u.word_count AS word_count
FROM posts p LEFT JOIN upd u ON p.uniqueid = u.uniqueid"""

_UPD_CTE = r"""upd AS (
SELECT uniqueid, length(text) AS text_length,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word_count,
  0.0::DOUBLE AS sentiment, 'short reply' AS topics, 'skipped' AS processed
FROM posts
WHERE starts_with(text, '@') AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 3)"""


def _upsert(spark, sf):
    p = FX.posts(spark, sf)
    return L.upsert(p, S.short_reply_updates(p), ["text_length", "sentiment", "topics", "processed", "word_count"])


@register("upsert_features", "A11 C3", V(_UPSERT_SQL, "posts", extra=(_UPD_CTE,)))
def q_upsert_features(spark, sf):
    snap, _ = _upsert(spark, sf)
    return snap.select("uniqueid", "text_length", "sentiment", "topics", "processed", "word_count")


@register("upsert_changed_count", "A11", V("""
SELECT count(*) AS rows_changed FROM posts p JOIN upd u ON p.uniqueid = u.uniqueid
WHERE p.text_length IS DISTINCT FROM u.text_length OR p.sentiment IS DISTINCT FROM u.sentiment
   OR p.topics IS DISTINCT FROM u.topics OR p.processed IS DISTINCT FROM u.processed
   OR u.word_count IS NOT NULL""", "posts", extra=(_UPD_CTE,)))
def q_upsert_changed_count(spark, sf):
    _, changed = _upsert(spark, sf)
    return changed


@register("update_clusters", "A12 S6 S11", V(f"""
SELECT p.uniqueid, u.processed_text, u.engagement_score, u.cluster FROM posts p LEFT JOIN (
  SELECT uniqueid, {PROCESSED_SQL} AS processed_text, engagement_eda AS engagement_score, doc_id % 5 AS cluster
  FROM sposts WHERE doc_id % 5 <> 4) u ON p.uniqueid = u.uniqueid""", "posts", "sposts"))
def q_update_clusters(spark, sf):
    """The three columns that the clustering job writes back; every fifth post has no update."""
    from .q_posts import scored
    p = FX.posts(spark, sf)
    worked = LX.with_processed_text(scored(spark, sf).filter(F.col("doc_id") % 5 != 4))
    labels = worked.select("uniqueid", "processed_text", F.col("engagement_eda").alias("engagement_score"),
                           (F.col("doc_id") % 5).alias("cluster"))
    snap, _ = L.upsert(p, labels, ["processed_text", "engagement_score", "cluster"])
    return snap.select("uniqueid", "processed_text", "engagement_score", "cluster")


# --------------------------------------------------------------------------
# Result files and job options
# --------------------------------------------------------------------------
from ..operators.aggregates import sample_types  # noqa: E402
from ..operators.feedback import prediction_performance  # noqa: E402
from ..session import scratch_path  # noqa: E402
import uuid  # noqa: E402

_HIST_COLS = "seq, run_id, iteration, tweet, predicted_engagement, is_exploration, actual_engagement, " \
             "feedback_collected_at, variations"


@register("load_history", "A13 A14", V(f"SELECT {_HIST_COLS}, NULL::INTEGER AS selected_idx FROM history", "history"))
def q_load_history(spark, sf):
    """Write the history as JSON (A13) and read it back with the fixed schema."""
    path = scratch_path(spark, f"results/history-{uuid.uuid4().hex[:12]}")
    L.write_results(FX.history(spark, sf), path, "json")
    return L.load_history(spark, path)


@register("load_metrics", "A13 A15 D28", V("""
SELECT round(avg(abs(predicted_engagement - actual_engagement)), 6) AS mean_absolute_error,
  round(avg(abs((predicted_engagement - actual_engagement)
        / CASE WHEN actual_engagement = 0 THEN 0.001 ELSE actual_engagement END)), 6) AS mean_relative_error,
  round(avg(abs(predicted_engagement - actual_engagement)) FILTER (WHERE is_exploration), 6) AS exploration_error,
  round(avg(abs(predicted_engagement - actual_engagement)) FILTER (WHERE NOT is_exploration), 6) AS exploitation_error,
  count(*) AS sample_size
FROM history WHERE actual_engagement IS NOT NULL""", "history"))
def q_load_metrics(spark, sf):
    path = scratch_path(spark, f"results/metrics-{uuid.uuid4().hex[:12]}")
    L.write_results(prediction_performance(FX.history(spark, sf)), path, "json")
    return L.load_metrics(spark, path)


# The processing options file shipped with the reference.
SHIPPED_OPTIONS = ('{"batch_size": 10, "process_topics": true, "max_retries": 3, "delay_between": 1, '
                   '"max_tweets": 50, "skip_short_replies": true, "min_word_count": 3, "process_engagement": true}')


@register("processing_options", "A16 B3 B6", V(r"""
SELECT uniqueid, processed, (row_number() OVER (ORDER BY uniqueid) - 1) // 10 AS batch_no FROM posts
WHERE (processed IS NULL OR processed = '' OR text_length IS NULL OR sentiment IS NULL
       OR topics IS NULL OR topics IN ('', '[]', 'null'))
  AND (processed IS NULL OR processed NOT IN ('completed', 'skipped', 'error'))
  AND NOT coalesce(starts_with(text, '@')
      AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 3, false)
  AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 3
ORDER BY uniqueid LIMIT 50""", "posts"))
def q_processing_options(spark, sf):
    """The batches of the feature job under the shipped options: short replies
    skipped, fewer than ``min_word_count`` words skipped, ``max_tweets`` rows in
    batches of ``batch_size``."""
    from ..functions import text as T
    o = L.ProcessingOptions.from_json(SHIPPED_OPTIONS)
    todo = S.posts_to_process(FX.posts(spark, sf), None)
    if o.skip_short_replies:
        todo = todo.filter(~T.is_short_reply("text"))
    todo = todo.filter(F.size(T.whitespace_words("text")) >= o.min_word_count)
    top = todo.select("uniqueid", "processed").orderBy("uniqueid").limit(o.max_tweets)  # the job's own limit
    nth = F.row_number().over(Window.orderBy("uniqueid"))
    return top.withColumn("batch_no", ((nth - 1) / F.lit(o.batch_size)).cast("int").cast("long"))


@register("sample_types", "")  # reads no data, which covers nothing
def q_sample_types(spark, sf):
    return sample_types(FX.posts(spark, sf))
