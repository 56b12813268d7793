"""Named queries over the post table: aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.enrich import with_scores, with_tags, with_text_features
from ..sources import fixtures as FX
from .catalog import register
from .views_sql import with_views as V

ASOF_SQL = "timestamp '2024-01-31 00:00:00'"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_tags(with_scores(FX.posts(spark, sf)))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    return with_text_features(scored(spark, sf))


@register("scan_posts", "A1", V("""
SELECT uniqueid, text, author_username, created_at, like_count, retweet_count, reply_count, topics FROM posts""",
                                "posts"))
def q_scan_posts(spark, sf):
    """The analysis jobs' full load, projected to the columns they use."""
    return FX.posts(spark, sf).select("uniqueid", "text", "author_username", "created_at", "like_count",
                                      "retweet_count", "reply_count", "topics")


@register("total_and_avg", "D1", V("""
SELECT count(*) AS total_tweets, coalesce(round(avg(engagement_score), 6), 0.0) AS avg_engagement FROM sposts""", "sposts"))
def q_total_and_avg(spark, sf):
    return A.total_and_avg(scored(spark, sf))


@register("top_authors", "D2", V("""
SELECT author_username, count(*) AS tweet_count, round(avg(engagement_score), 6) AS avg_engagement
FROM sposts GROUP BY author_username
ORDER BY avg_engagement DESC NULLS LAST, author_username ASC NULLS FIRST LIMIT 10""", "sposts"))
def q_top_authors(spark, sf):
    return A.top_authors(scored(spark, sf))


@register("top_topics", "D3 C2", V("""
SELECT topic, count(*) AS tweet_count, round(avg(engagement_score), 6) AS avg_engagement
FROM (SELECT trim(t, ' ') AS topic, engagement_score
      FROM sposts, unnest(string_split(coalesce(topics, ''), ',')) AS u(t))
WHERE topic <> ''
GROUP BY topic ORDER BY tweet_count DESC, avg_engagement DESC NULLS LAST, topic LIMIT 20""", "sposts"))
def q_top_topics(spark, sf):
    return A.top_topics(scored(spark, sf))


@register("engagement_stats", "D4", V("""
SELECT round(avg(engagement_score), 6) AS avg_engagement, max(engagement_score) AS max_engagement,
  min(engagement_score) AS min_engagement, round(avg(like_count), 6) AS avg_likes,
  round(avg(retweet_count), 6) AS avg_retweets, round(avg(reply_count), 6) AS avg_replies FROM sposts""", "sposts"))
def q_engagement_stats(spark, sf):
    return A.engagement_stats(scored(spark, sf))


@register("topic_distribution", "D5", V(r"""
SELECT topic, sum(n) AS tweet_count FROM (
  SELECT regexp_replace(t, '^\s+|\s+$', '', 'g') AS topic, n FROM (SELECT coalesce(topics, '') AS topics, count(*) AS n FROM posts GROUP BY 1),
    unnest(string_split(topics, ',')) AS u(t))
WHERE topic <> '' GROUP BY topic""", "posts"))
def q_topic_distribution(spark, sf):
    return A.topic_distribution(FX.posts(spark, sf))


@register("top_n_topics_chart", "F7", V(r"""
SELECT topic, sum(n) AS tweet_count FROM (
  SELECT regexp_replace(t, '^\s+|\s+$', '', 'g') AS topic, n FROM (SELECT coalesce(topics, '') AS topics, count(*) AS n FROM posts GROUP BY 1),
    unnest(string_split(topics, ',')) AS u(t))
WHERE topic <> '' GROUP BY topic ORDER BY tweet_count DESC, topic LIMIT 10""", "posts"))
def q_top_n_topics_chart(spark, sf):
    return A.topic_distribution(FX.posts(spark, sf)).orderBy(F.desc("tweet_count"), "topic").limit(10)


@register("topic_string_counts", "D6", V("""
SELECT topics, count(*) AS tweet_count FROM posts GROUP BY topics
ORDER BY tweet_count DESC, topics ASC NULLS FIRST LIMIT 20""", "posts"))
def q_topic_string_counts(spark, sf):
    return A.topic_string_counts(FX.posts(spark, sf))


@register("unique_topics", "D7", V("""
SELECT count(*) AS unique_topics FROM (SELECT DISTINCT topics FROM posts)""", "posts"))
def q_unique_topics(spark, sf):
    return A.unique_topics(FX.posts(spark, sf))


_FEATS = A.IMPORTANCE_FEATURES
_CORR = ",\n  ".join(
    f"abs(CASE WHEN stddev_pop(CASE WHEN {c} IS NOT NULL AND engagement_score IS NOT NULL THEN {c}::DOUBLE END)"
    f" * stddev_pop(CASE WHEN {c} IS NOT NULL AND engagement_score IS NOT NULL THEN engagement_score END) = 0 THEN NULL"
    f" ELSE covar_pop(CASE WHEN {c} IS NOT NULL AND engagement_score IS NOT NULL THEN {c}::DOUBLE END,"
    f" CASE WHEN {c} IS NOT NULL AND engagement_score IS NOT NULL THEN engagement_score END)"
    f" / (stddev_pop(CASE WHEN {c} IS NOT NULL AND engagement_score IS NOT NULL THEN {c}::DOUBLE END)"
    f" * stddev_pop(CASE WHEN {c} IS NOT NULL AND engagement_score IS NOT NULL THEN engagement_score END)) END) AS {c}"
    for c in _FEATS)


@register("feature_importance", "D8", V(f"""
SELECT feature, round(CASE WHEN mx > 0 THEN corr / mx ELSE corr END, 6) + 0.0 AS importance
FROM (SELECT feature, corr, max(corr) OVER () AS mx FROM (
  (SELECT {_CORR} FROM fposts) UNPIVOT INCLUDE NULLS (corr FOR feature IN ({", ".join(_FEATS)}))))""", "fposts"))
def q_feature_importance(spark, sf):
    return A.feature_importance(featured(spark, sf))


@register("duplicate_ids", "D9", V("""
SELECT md5(text) AS text_md5, count(*) AS n FROM posts GROUP BY text HAVING count(*) > 1""", "posts"))
def q_duplicate_ids(spark, sf):
    # The posts key is unique; duplicated texts are the interesting repeats, grouped by their digest.
    return A.duplicate_ids(FX.posts(spark, sf).select(F.md5("text").alias("text_md5")), "text_md5")


@register("missing_fields", "D10", V("""
SELECT count_if(text IS NULL) AS missing_text, count_if(created_at IS NULL) AS missing_created_at,
  count_if(author_username IS NULL) AS missing_author, count_if(engagement_score IS NULL) AS missing_engagement_score
FROM sposts""", "sposts"))
def q_missing_fields(spark, sf):
    return A.missing_fields(scored(spark, sf))


@register("health_report", "D11 B13", V(f"""
SELECT * FROM (
  SELECT count(*) AS total_documents, count_if(created_at >= {ASOF_SQL} - INTERVAL 7 DAY) AS recent_tweets,
    count_if(text IS NULL) AS missing_text, count_if(created_at IS NULL) AS missing_created_at,
    count_if(author_username IS NULL) AS missing_author, count_if(engagement_score IS NULL) AS missing_engagement_score
  FROM sposts) a
CROSS JOIN (SELECT count(*) AS duplicate_count FROM (SELECT uniqueid FROM sposts GROUP BY uniqueid HAVING count(*) > 1)) b""",
                                             "sposts"))
def q_health_report(spark, sf):
    return A.health_report(scored(spark, sf), FX.as_of_lit())


_POST_COLS = ("doc_id", "uniqueid", "author_username", "lang", "text", "topics", "processed", "text_length",
              "sentiment", "author_following", "author_followers", "like_count", "retweet_count", "reply_count",
              "quote_count", "bookmark_count", "created_at")


@register("null_counts", "D12", V("SELECT * FROM (UNPIVOT (SELECT " + ", ".join(
    f"count_if({c} IS NULL) AS {c}" for c in _POST_COLS)
    + " FROM posts) ON " + ", ".join(_POST_COLS) + " INTO NAME column_name VALUE null_count)", "posts"))
def q_null_counts(spark, sf):
    return A.null_counts(FX.posts(spark, sf))


@register("iqr_outliers", "D13", V("""
SELECT uniqueid, engagement_score FROM sposts,
  (SELECT quantile_cont(engagement_score, 0.25) AS q1, quantile_cont(engagement_score, 0.75) AS q3 FROM sposts) q
WHERE engagement_score < q1 - 1.5 * (q3 - q1) OR engagement_score > q3 + 1.5 * (q3 - q1)""", "sposts"))
def q_iqr_outliers(spark, sf):
    return A.iqr_outliers(scored(spark, sf))


@register("text_length_describe", "D14", V("""
SELECT count(l) AS count, round(avg(l), 6) AS mean, round(stddev_samp(l), 6) AS std,
  min(l)::DOUBLE AS min, max(l)::DOUBLE AS max,
  round(quantile_cont(l, 0.25), 6) AS p25, round(quantile_cont(l, 0.5), 6) AS p50, round(quantile_cont(l, 0.75), 6) AS p75
FROM (SELECT length(text) AS l FROM posts)""", "posts"))
def q_text_length_describe(spark, sf):
    return A.text_length_describe(FX.posts(spark, sf))


@register("date_range", "D15", V("""
SELECT min(created_at) AS earliest, max(created_at) AS latest FROM posts""", "posts"))
def q_date_range(spark, sf):
    return A.date_range(FX.posts(spark, sf))


@register("eda_engagement_stats", "D16 S6", V("""
SELECT sum(engagement_eda) AS total_engagement, round(avg(engagement_eda), 6) AS mean_engagement,
  max(engagement_eda) AS max_engagement, min(engagement_eda) AS min_engagement,
  round(stddev_samp(engagement_eda), 6) AS std_engagement FROM sposts""", "sposts"))
def q_eda_engagement_stats(spark, sf):
    return A.eda_engagement_stats(scored(spark, sf))


@register("engagement_histogram", "D17", V("""
SELECT bin, round(mn + (bin - 1) * (mx - mn) / 50, 6) AS bin_start, count(*) AS n FROM (
  SELECT CASE WHEN mx - mn > 0 THEN least(cast(floor((x - mn) * 50 / (mx - mn)) AS INTEGER) + 1, 50) ELSE 1 END AS bin,
         mn, mx
  FROM (SELECT engagement_eda AS x FROM sposts WHERE engagement_eda IS NOT NULL),
       (SELECT min(engagement_eda) AS mn, max(engagement_eda) AS mx FROM sposts))
GROUP BY bin, mn, mx""", "sposts"))
def q_engagement_histogram(spark, sf):
    return A.equal_width_histogram(scored(spark, sf), "engagement_eda", 50)


@register("hourly_counts", "D18", V("""
SELECT hour(created_at) AS hour, count(*) AS n FROM posts WHERE created_at IS NOT NULL GROUP BY 1""", "posts"))
def q_hourly_counts(spark, sf):
    return A.hourly_counts(FX.posts(spark, sf))


@register("daily_counts", "D19", V("""
SELECT cast(created_at AS date) AS day, count(*) AS n FROM posts WHERE created_at IS NOT NULL GROUP BY 1""", "posts"))
def q_daily_counts(spark, sf):
    return A.daily_counts(FX.posts(spark, sf))


@register("top_hashtags", "D20", V("""
SELECT hashtag, count(*) AS n FROM (SELECT unnest(hashtags) AS hashtag FROM sposts)
GROUP BY hashtag ORDER BY n DESC, hashtag LIMIT 20""", "sposts"))
def q_top_hashtags(spark, sf):
    return A.top_hashtags(scored(spark, sf))


@register("top_users_by_count", "D21", V("""
SELECT author_username, count(*) AS tweet_count FROM posts WHERE author_username IS NOT NULL
GROUP BY 1 ORDER BY tweet_count DESC, author_username LIMIT 20""", "posts"))
def q_top_users_by_count(spark, sf):
    return A.top_users_by_count(FX.posts(spark, sf))


@register("top_users_by_engagement", "D22", V("""
SELECT author_username, round(avg(engagement_eda), 6) AS avg_engagement FROM sposts WHERE author_username IS NOT NULL
GROUP BY 1 ORDER BY avg_engagement DESC NULLS LAST, author_username LIMIT 20""", "sposts"))
def q_top_users_by_engagement(spark, sf):
    return A.top_users_by_engagement(scored(spark, sf))


@register("cluster_stats", "D23", V("""
SELECT doc_id % 5 AS cluster, count(*) AS size, round(avg(engagement_eda), 6) AS avg_engagement
FROM sposts GROUP BY 1""", "sposts"))
def q_cluster_stats(spark, sf):
    return A.cluster_stats(scored(spark, sf).withColumn("cluster", F.col("doc_id") % 5))


@register("cluster_top_tags", "D24", V("""
SELECT cluster, kind, tag, n FROM (
  SELECT cluster, kind, tag, n, row_number() OVER (PARTITION BY cluster, kind ORDER BY n DESC, tag) AS rk FROM (
    SELECT cluster, kind, tag, count(*) AS n FROM (
      SELECT doc_id % 5 AS cluster, 'hashtag' AS kind, unnest(hashtags) AS tag FROM sposts
      UNION ALL
      SELECT doc_id % 5 AS cluster, 'mention' AS kind, unnest(mentions) AS tag FROM sposts)
    GROUP BY 1, 2, 3))
WHERE rk <= 5""", "sposts"))
def q_cluster_top_tags(spark, sf):
    return A.cluster_top_tags(scored(spark, sf).withColumn("cluster", F.col("doc_id") % 5))


@register("trending_topics", "D25", V(f"""
SELECT topics, count(*) AS tweet_count, round(avg(engagement_score), 6) AS avg_engagement FROM sposts
WHERE created_at >= {ASOF_SQL} - INTERVAL 1 DAY AND topics IS NOT NULL AND topics <> ''
GROUP BY topics ORDER BY avg_engagement DESC NULLS LAST, topics LIMIT 20""", "sposts"))
def q_trending_topics(spark, sf):
    return A.trending_topics(scored(spark, sf), FX.as_of_lit())


@register("pipeline_status", "D26", V("""
SELECT count(*) AS total, count_if(processed IS NULL OR processed = '') AS unprocessed,
  count_if(text_length IS NULL OR sentiment IS NULL) AS missing_features,
  count_if(topics IS NULL OR topics IN ('', '[]', 'null')) AS missing_topics,
  count_if(processed = 'completed') AS completed, count_if(processed = 'skipped') AS skipped,
  count_if(processed = 'error') AS error FROM posts""", "posts"))
def q_pipeline_status(spark, sf):
    return A.pipeline_status(FX.posts(spark, sf))


@register("table_profile", "D44")
def q_table_profile(spark, sf):
    return A.table_profile(FX.posts(spark, sf))


@register("training_summary", "D46 D38", V("""
SELECT count(*) AS samples, count_if(engagement_eda > (SELECT quantile_cont(engagement_eda, 0.5) FROM sposts))
  AS high_engagement, round(avg(engagement_eda), 6) AS mean_engagement FROM sposts""", "sposts"))
def q_training_summary(spark, sf):
    return A.training_summary(scored(spark, sf))


# --------------------------------------------------------------------------
# Filters, projections, top-k (B*, F*)
# --------------------------------------------------------------------------
from ..operators import selection as S  # noqa: E402

_NEEDS_WORK_SQL = """(processed IS NULL OR processed = '' OR text_length IS NULL OR sentiment IS NULL
  OR topics IS NULL OR topics IN ('', '[]', 'null'))"""
_NOT_DONE_SQL = "(processed IS NULL OR processed NOT IN ('completed', 'skipped', 'error'))"


@register("post_by_id", "B1", V("SELECT * FROM posts WHERE uniqueid = 't7'", "posts"))
def q_post_by_id(spark, sf):
    return S.post_by_id(FX.posts(spark, sf), "t7")


@register("unprocessed_posts", "B2", V("""
SELECT uniqueid, processed, text_length, sentiment FROM posts
WHERE text_length IS NULL OR sentiment IS NULL OR processed IS NULL OR processed = ''
ORDER BY uniqueid LIMIT 100""", "posts"))
def q_unprocessed_posts(spark, sf):
    return S.unprocessed_posts(FX.posts(spark, sf)).select("uniqueid", "processed", "text_length", "sentiment")


@register("posts_to_process", "B3", V(f"""
SELECT uniqueid, processed, topics FROM posts WHERE {_NEEDS_WORK_SQL} AND {_NOT_DONE_SQL}
ORDER BY uniqueid LIMIT 50""", "posts"))
def q_posts_to_process(spark, sf):
    return S.posts_to_process(FX.posts(spark, sf)).select("uniqueid", "processed", "topics")


@register("processed_posts", "B4", V("""
SELECT uniqueid, text_length, sentiment, topics FROM posts
WHERE text_length IS NOT NULL AND sentiment IS NOT NULL AND topics IS NOT NULL ORDER BY uniqueid LIMIT 100""", "posts"))
def q_processed_posts(spark, sf):
    return S.processed_posts(FX.posts(spark, sf)).select("uniqueid", "text_length", "sentiment", "topics")


SIMILAR_QUERY = "Is and retitioning ouen the of, nterti thorreou ndernt. Is ndble"


@register("similar_posts", "B5", V(f"""
SELECT uniqueid, author_username FROM posts
WHERE text_length IS NOT NULL AND sentiment IS NOT NULL AND topics IS NOT NULL
  AND contains(lower(text), lower('{SIMILAR_QUERY[:50]}'))
ORDER BY uniqueid LIMIT 5""", "posts"))
def q_similar_posts(spark, sf):
    return S.similar_posts(FX.posts(spark, sf), SIMILAR_QUERY).select("uniqueid", "author_username")


@register("short_reply", "B6", V(r"""
SELECT uniqueid, length(text) AS text_length,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word_count,
  0.0::DOUBLE AS sentiment, 'short reply' AS topics, 'skipped' AS processed
FROM posts
WHERE starts_with(text, '@') AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 3""",
                                   "posts"))
def q_short_reply(spark, sf):
    return S.short_reply_updates(FX.posts(spark, sf))


@register("feature_projection", "B7 S1 S2 S3 S23", V("""
SELECT uniqueid, text_length, sentiment, hashtag_count, mention_count, url_count, emoji_count, word_count,
  round(avg_word_length, 6) AS avg_word_length, round(flesch_reading_ease, 6) + 0.0 AS flesch_reading_ease,
  engagement_score FROM fposts""", "fposts"))
def q_feature_projection(spark, sf):
    out = S.feature_projection(featured(spark, sf))
    return out.withColumns({"avg_word_length": A.rnd(F.col("avg_word_length")),
                            "flesch_reading_ease": A.rnd(F.col("flesch_reading_ease"))})


@register("top_posts_recent", "B8", V(f"""
SELECT uniqueid, text, author_username, engagement_score, created_at, topics FROM sposts
WHERE created_at >= {ASOF_SQL} - INTERVAL 7 DAY
ORDER BY engagement_score DESC NULLS LAST, uniqueid LIMIT 10""", "sposts"))
def q_top_posts_recent(spark, sf):
    return S.top_posts_recent(scored(spark, sf), FX.as_of_lit())


@register("training_rows", "B9", V("""
SELECT uniqueid, text, engagement_score, topics, created_at FROM sposts WHERE engagement_score IS NOT NULL
ORDER BY created_at DESC NULLS LAST, uniqueid LIMIT 1000""", "sposts"))
def q_training_rows(spark, sf):
    return S.training_rows(scored(spark, sf))


@register("recent_count", "B13", V(f"""
SELECT count_if(created_at >= {ASOF_SQL} - INTERVAL 7 DAY) AS recent_tweets FROM posts""", "posts"))
def q_recent_count(spark, sf):
    return S.recent_count(FX.posts(spark, sf), FX.as_of_lit())


@register("verify_update", "B14 C5", V(f"""
SELECT count(*) AS checked,
  count_if((processed = 'completed' AND text_length IS NOT NULL AND sentiment IS NOT NULL AND topics IS NOT NULL
            AND topics <> '') OR processed = 'skipped') AS verified
FROM posts WHERE uniqueid IN (SELECT concat('t', cast(seq AS varchar)) FROM history WHERE actual_engagement IS NOT NULL)""",
                                       "posts", "history"))
def q_verify_update(spark, sf):
    p = FX.posts(spark, sf)
    ids = FX.history(spark, sf, p).filter(F.col("actual_engagement").isNotNull()) \
        .select(F.concat(F.lit("t"), F.col("seq").cast("string")).alias("uniqueid"))
    return S.verify_update(p, ids)


@register("error_posts", "B15", V("SELECT uniqueid FROM posts WHERE processed = 'error'", "posts"))
def q_error_posts(spark, sf):
    return S.error_posts(FX.posts(spark, sf))


@register("backlog_count", "B16", V(f"SELECT count_if({_NEEDS_WORK_SQL}) AS backlog FROM posts", "posts"))
def q_backlog_count(spark, sf):
    return S.backlog_count(FX.posts(spark, sf))


@register("recent_posts", "F1", V("""
SELECT uniqueid, author_username, created_at FROM posts ORDER BY created_at DESC NULLS LAST, uniqueid LIMIT 100""",
                                 "posts"))
def q_recent_posts(spark, sf):
    return S.recent_posts(FX.posts(spark, sf), 100)


@register("top_topic_vocabulary", "F5 C2", V("""
SELECT topic, count(*) AS n FROM (SELECT trim(t, ' ') AS topic FROM posts, unnest(string_split(coalesce(topics, ''), ',')) AS u(t))
WHERE topic <> '' GROUP BY topic ORDER BY n DESC, topic LIMIT 100""", "posts"))
def q_top_topic_vocabulary(spark, sf):
    return S.top_topic_vocabulary(FX.posts(spark, sf))


@register("episode_sample", "F6", V("""
SELECT uniqueid, text, engagement_score, episode FROM (
  SELECT uniqueid, text, engagement_score, episode,
    row_number() OVER (PARTITION BY episode ORDER BY md5(uniqueid || ':' || episode || ':42'), uniqueid) AS rn
  FROM sposts, (SELECT unnest(range(1, 11))::INTEGER AS episode))
WHERE rn <= 32""", "sposts"))
def q_episode_sample(spark, sf):
    p = scored(spark, sf).select("uniqueid", "text", "engagement_score")
    return S.episode_sample(p, "uniqueid", episodes=10, n=32)
