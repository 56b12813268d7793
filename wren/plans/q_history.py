"""Named queries over the optimization history and the prompt log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import engagement as E
from ..operators import feedback as FB
from ..operators import selection as S
from ..operators.aggregates import hashtags
from ..operators.windows import dense_sequence
from ..sources import fixtures as FX
from .catalog import register
from .views_sql import with_views as V


def hist(spark, sf):
    return FX.history(spark, sf)


def variation_score(v):
    """Deterministic stand-in score of a candidate text (same rule as the
    history's predicted score), used where a query needs scored candidates."""
    return ((F.length(v) % 40 + 1).cast("double") / 4)


_VSCORE_SQL = "(cast(length(v) % 40 + 1 AS double) / 4)"


@register("history_filter", "B10", V("""
SELECT seq, predicted_engagement, actual_engagement,
  round((actual_engagement / predicted_engagement - 1) * 100, 6) AS pct_vs_predicted FROM history
WHERE cast(feedback_collected_at AS date) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
  AND predicted_engagement >= 2.5""", "history"))
def q_history_filter(spark, sf):
    return S.history_filter(hist(spark, sf), "2024-01-05", "2024-01-20", 2.5)


@register("pending_feedback", "B12", V("""
SELECT seq, run_id, iteration, predicted_engagement FROM history WHERE actual_engagement IS NULL
ORDER BY seq DESC LIMIT 100""", "history"))
def q_pending_feedback(spark, sf):
    return S.pending_feedback(hist(spark, sf), 100)


_MATCH_SQL = """
SELECT h.seq, min(p.uniqueid) AS uniqueid FROM history h JOIN posts p
  ON contains(lower(p.text), lower(substr(h.tweet, 1, 50)))
WHERE h.tweet IS NOT NULL AND h.tweet <> '' AND p.like_count IS NOT NULL AND p.retweet_count IS NOT NULL
  AND p.reply_count IS NOT NULL AND p.quote_count IS NOT NULL AND p.bookmark_count IS NOT NULL
GROUP BY h.seq"""


@register("feedback_match", "C1 S7", V(f"""
SELECT m.seq, m.uniqueid, cast(p.like_count * 1.0 + p.retweet_count * 2.0 + p.reply_count * 1.5
  + p.quote_count * 1.8 + p.bookmark_count * 1.2 AS double) AS actual_engagement
FROM ({_MATCH_SQL}) m JOIN posts p ON p.uniqueid = m.uniqueid""", "history", "posts"))
def q_feedback_match(spark, sf):
    p = FX.stored_posts(spark, sf)
    m = FB.feedback_match(FX.history(spark, sf, p), p, held=True)
    return m.select("seq", "uniqueid", E.engagement("feedback").alias("actual_engagement"))


@register("collect_feedback", "M14 B12 C1 S7", V(f"""
SELECT m.seq, m.uniqueid, cast(p.like_count * 1.0 + p.retweet_count * 2.0 + p.reply_count * 1.5
  + p.quote_count * 1.8 + p.bookmark_count * 1.2 AS double) AS actual_engagement
FROM (SELECT h.seq, min(p.uniqueid) AS uniqueid
      FROM (SELECT * FROM history WHERE actual_engagement IS NULL ORDER BY seq DESC LIMIT 100) h
      JOIN posts p ON contains(lower(p.text), lower(substr(h.tweet, 1, 50)))
      WHERE h.tweet IS NOT NULL AND h.tweet <> '' AND p.like_count IS NOT NULL AND p.retweet_count IS NOT NULL
        AND p.reply_count IS NOT NULL AND p.quote_count IS NOT NULL AND p.bookmark_count IS NOT NULL
      GROUP BY h.seq) m
JOIN posts p ON p.uniqueid = m.uniqueid""", "history", "posts"))
def q_collect_feedback(spark, sf):
    p = FX.posts(spark, sf)
    h = FX.history(spark, sf, p)
    pending = h.join(S.pending_feedback(h, 100).select("seq"), "seq", "left_semi")
    m = FB.feedback_match(pending, p)
    return m.select("seq", "uniqueid", E.engagement("feedback").alias("actual_engagement"))


_COLLECTED = """SELECT m.seq, cast(p.like_count * 1.0 + p.retweet_count * 2.0 + p.reply_count * 1.5
  + p.quote_count * 1.8 + p.bookmark_count * 1.2 AS double) AS actual_engagement
FROM (SELECT h.seq, min(p.uniqueid) AS uniqueid
      FROM (SELECT * FROM history WHERE actual_engagement IS NULL ORDER BY seq DESC LIMIT 100) h
      JOIN posts p ON contains(lower(p.text), lower(substr(h.tweet, 1, 50)))
      WHERE h.tweet IS NOT NULL AND h.tweet <> '' AND p.like_count IS NOT NULL AND p.retweet_count IS NOT NULL
        AND p.reply_count IS NOT NULL AND p.quote_count IS NOT NULL AND p.bookmark_count IS NOT NULL
      GROUP BY h.seq) m
JOIN posts p ON p.uniqueid = m.uniqueid"""


@register("collect_feedback_history", "M14 A11", V(f"""
SELECT h.seq, coalesce(c.actual_engagement, h.actual_engagement) AS actual_engagement,
  CASE WHEN c.seq IS NOT NULL THEN timestamp '2024-01-31 00:00:00' ELSE h.feedback_collected_at END AS feedback_collected_at
FROM history h LEFT JOIN ({_COLLECTED}) c ON c.seq = h.seq""", "history", "posts"))
def q_collect_feedback_history(spark, sf):
    """The history after one collection run."""
    p = FX.posts(spark, sf)
    updated, _ = FB.collect_feedback(FX.history(spark, sf, p), p, FX.as_of_lit())
    return updated.select("seq", "actual_engagement", "feedback_collected_at")


@register("prediction_errors", "D27", V("""
SELECT seq, is_exploration, round(predicted_engagement - actual_engagement, 6) + 0.0 AS error,
  round(abs(predicted_engagement - actual_engagement), 6) AS abs_error,
  round((predicted_engagement - actual_engagement)
        / CASE WHEN actual_engagement = 0 THEN 0.001 ELSE actual_engagement END, 6) + 0.0 AS relative_error
FROM history WHERE actual_engagement IS NOT NULL""", "history"))
def q_prediction_errors(spark, sf):
    return FB.prediction_errors(hist(spark, sf))


@register("prediction_performance", "D28", V("""
SELECT round(avg(abs(predicted_engagement - actual_engagement)), 6) AS mean_absolute_error,
  round(avg(abs((predicted_engagement - actual_engagement)
        / CASE WHEN actual_engagement = 0 THEN 0.001 ELSE actual_engagement END)), 6) AS mean_relative_error,
  round(avg(abs(predicted_engagement - actual_engagement)) FILTER (WHERE is_exploration), 6) AS exploration_error,
  round(avg(abs(predicted_engagement - actual_engagement)) FILTER (WHERE NOT is_exploration), 6) AS exploitation_error,
  count(*) AS sample_size
FROM history WHERE actual_engagement IS NOT NULL""", "history"))
def q_prediction_performance(spark, sf):
    return FB.prediction_performance(hist(spark, sf))


@register("variation_metrics", "D29 S17", V(f"""
SELECT seq, round(avg(s), 6) AS avg_engagement, round(max(s), 6) AS max_engagement, round(min(s), 6) AS min_engagement,
  round(max(s) - min(s), 6) AS engagement_range, round(quantile_cont(s, 0.9), 6) AS top_percentile,
  round(quantile_cont(s, 0.1), 6) AS bottom_percentile,
  round(CASE WHEN any_value(initial_score) <> 0 THEN (max(s) / any_value(initial_score) - 1) * 100 END, 6) + 0.0
    AS improvement_rate,
  round(CASE WHEN avg(s) <> 0 THEN 1 - stddev_pop(s) / avg(s) END, 6) + 0.0 AS consistency,
  round(avg(length(v)), 6) AS avg_length,
  round(avg(length(v) - length(replace(v, '#', ''))), 6) AS hashtag_ratio,
  round(avg(coalesce(len(regexp_extract_all(v,
      '[\\x{{1F1E6}}-\\x{{1F1FF}}\\x{{1F300}}-\\x{{1F6FF}}\\x{{1F900}}-\\x{{1F9FF}}\\x{{1FA70}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]')), 0)), 6)
    AS emoji_ratio,
  round(avg(length(v) - length(replace(v, '?', ''))), 6) AS question_ratio,
  round(avg(length(v) - length(replace(v, '!', ''))), 6) AS exclamation_ratio
FROM (SELECT seq, predicted_engagement AS initial_score, unnest(variations) AS v FROM history),
  LATERAL (SELECT {_VSCORE_SQL} AS s)
GROUP BY seq""", "history"))
def q_variation_metrics(spark, sf):
    h = hist(spark, sf).select("seq", "variations", F.col("predicted_engagement").alias("initial_score"))
    h = h.withColumn("scores", F.transform("variations", variation_score))
    out = FB.variation_metrics(h)
    return out.drop("variations", "scores", "initial_score")


_VOCAB_SQL = """(SELECT count(*) FROM (SELECT topic FROM (SELECT trim(t, ' ') AS topic FROM posts,
  unnest(string_split(coalesce(topics, ''), ',')) AS u(t)) WHERE topic <> '' GROUP BY topic ORDER BY count(*) DESC, topic
  LIMIT 100))"""


@register("topic_coverage", "D30 F5", V(r"""
SELECT seq, round(CASE WHEN vocab = 0 THEN NULL ELSE n::DOUBLE / vocab END, 6) AS topic_coverage FROM (
  SELECT seq, (SELECT count(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(v, '#([\p{L}\p{N}_]+)', 1)) AS t
                 FROM (SELECT unnest(variations) AS v))) AS n, """ + _VOCAB_SQL + """ AS vocab
  FROM history)""", "history", "posts"))
def q_topic_coverage(spark, sf):
    p = FX.posts(spark, sf)
    vocab = S.top_topic_vocabulary(p).agg(F.count(F.lit(1)).alias("vocab"))
    h = FX.history(spark, sf, p).select("seq", "variations").crossJoin(F.broadcast(vocab))
    return FB.topic_coverage(h, hashtags, F.col("vocab")).select("seq", "topic_coverage")


@register("prompt_overview", "D31", V("""
SELECT round(avg(avg_engagement), 6) AS mean_avg_engagement,
  round(arg_max(avg_engagement, timestamp) - arg_min(avg_engagement, timestamp), 6) AS delta_avg_engagement,
  round(avg(improvement_rate), 6) AS mean_improvement_rate,
  round(arg_max(improvement_rate, timestamp) - arg_min(improvement_rate, timestamp), 6) AS delta_improvement_rate,
  round(avg(consistency), 6) AS mean_consistency,
  round(arg_max(consistency, timestamp) - arg_min(consistency, timestamp), 6) + 0.0 AS delta_consistency
FROM prompts""", "prompts"))
def q_prompt_overview(spark, sf):
    return FB.prompt_overview(FX.prompts(spark, sf))


@register("prompt_timeline", "D32", V("""
SELECT timestamp, version, avg_engagement, max_engagement, min_engagement FROM prompts""", "prompts"))
def q_prompt_timeline(spark, sf):
    return FB.prompt_timeline(FX.prompts(spark, sf))


@register("prompt_elements", "D33", V("""
SELECT timestamp, version, element, ratio FROM prompts
UNPIVOT (ratio FOR element IN (hashtag_ratio, emoji_ratio, question_ratio, exclamation_ratio))""", "prompts"))
def q_prompt_elements(spark, sf):
    return FB.prompt_elements(FX.prompts(spark, sf))


@register("length_vs_engagement", "D34", V("""
SELECT version, avg_length, avg_engagement, topic_coverage, consistency FROM prompts""", "prompts"))
def q_length_vs_engagement(spark, sf):
    return FB.length_vs_engagement(FX.prompts(spark, sf))


@register("predicted_actual_box", "D35", V("""
SELECT 'predicted_engagement' AS series, round(min(predicted_engagement), 6) AS min,
  round(quantile_cont(predicted_engagement, 0.25), 6) AS q1, round(quantile_cont(predicted_engagement, 0.5), 6) AS median,
  round(quantile_cont(predicted_engagement, 0.75), 6) AS q3, round(max(predicted_engagement), 6) AS max FROM history
UNION ALL
SELECT 'actual_engagement', round(min(actual_engagement), 6), round(quantile_cont(actual_engagement, 0.25), 6),
  round(quantile_cont(actual_engagement, 0.5), 6), round(quantile_cont(actual_engagement, 0.75), 6),
  round(max(actual_engagement), 6) FROM history""", "history"))
def q_predicted_actual_box(spark, sf):
    return FB.five_number_summary(hist(spark, sf), ["predicted_engagement", "actual_engagement"])


@register("history_progress", "D36 S17", V("""
SELECT run_id, count(*) AS iterations, arg_min(predicted_engagement, iteration) AS first_score,
  arg_max(predicted_engagement, iteration) AS last_score,
  round(CASE WHEN arg_min(predicted_engagement, iteration) > 0
        THEN (arg_max(predicted_engagement, iteration) / arg_min(predicted_engagement, iteration) - 1) * 100
        ELSE 0.0 END, 6) + 0.0 AS improvement_pct
FROM history GROUP BY run_id""", "history"))
def q_history_progress(spark, sf):
    return FB.history_progress(hist(spark, sf))


@register("episode_summary", "D37", V("""
SELECT run_id % 10 AS episode, round(avg(imp), 6) + 0.0 AS avg_improvement, round(sum(imp), 6) + 0.0 AS episode_reward,
  count_if(imp > 10) AS significant, count(*) AS n
FROM (SELECT run_id, (actual_engagement - predicted_engagement) / predicted_engagement * 100 AS imp
      FROM history WHERE actual_engagement IS NOT NULL)
GROUP BY 1""", "history"))
def q_episode_summary(spark, sf):
    h = hist(spark, sf).filter(F.col("actual_engagement").isNotNull())
    rows = h.select((F.col("run_id") % 10).alias("episode"),
                    ((F.col("actual_engagement") - F.col("predicted_engagement")) / F.col("predicted_engagement") * 100)
                    .alias("improvement"))
    return FB.episode_summary(rows)


@register("episode_overall", "D37", V("""
SELECT round(avg(avg_improvement), 6) + 0.0 AS mean_improvement, max(avg_improvement) AS best_improvement,
  round(avg(episode_reward), 6) + 0.0 AS mean_reward
FROM (SELECT round(avg(imp), 6) + 0.0 AS avg_improvement, round(sum(imp), 6) + 0.0 AS episode_reward
      FROM (SELECT run_id, (actual_engagement - predicted_engagement) / predicted_engagement * 100 AS imp
            FROM history WHERE actual_engagement IS NOT NULL)
      GROUP BY run_id % 10)""", "history"))
def q_episode_overall(spark, sf):
    return FB.episode_overall(q_episode_summary(spark, sf))


@register("prompt_versions", "W1", V("""
SELECT version, timestamp, row_number() OVER (ORDER BY timestamp, version) AS prompt_no FROM prompts""", "prompts"))
def q_prompt_versions(spark, sf):
    p = FX.prompts(spark, sf).select("version", "timestamp")
    return dense_sequence(p, ["timestamp", "version"], "prompt_no").select("version", "timestamp", "prompt_no")


@register("best_variation", "F2", V(f"""
SELECT seq, best_idx, variations[best_idx + 1] AS best_variation, best_score FROM (
  SELECT seq, any_value(variations) AS variations, arg_max(i, s * 1000000 - i) - 1 AS best_idx, max(s) AS best_score
  FROM (SELECT seq, variations, unnest(variations) AS v, unnest(range(1, len(variations) + 1)) AS i FROM history),
    LATERAL (SELECT {_VSCORE_SQL} AS s)
  GROUP BY seq)""", "history"))
def q_best_variation(spark, sf):
    h = hist(spark, sf).select("seq", "variations")
    h = h.withColumn("scores", F.transform("variations", variation_score))
    return S.best_variation(h, "seq", "variations", "scores")


@register("best_prompt", "F3", V("""
SELECT version, prompt FROM prompts ORDER BY avg_engagement DESC, version ASC LIMIT 1""", "prompts"))
def q_best_prompt(spark, sf):
    return S.best_prompt(FX.prompts(spark, sf))


@register("ranked_variations", "F4", V(f"""
SELECT h.run_id, h.seq, u.idx, {_VSCORE_SQL.replace('v', 'u.v')} AS score FROM history h
JOIN (SELECT run_id, max(iteration) AS it FROM history GROUP BY run_id) l ON h.run_id = l.run_id AND h.iteration = l.it,
  LATERAL (SELECT unnest(h.variations) AS v, unnest(range(0, len(h.variations))) AS idx) u""", "history"))
def q_ranked_variations(spark, sf):
    return S.ranked_variations(hist(spark, sf), variation_score)


_OBS_CTE = """obs AS (
  SELECT row_number() OVER (ORDER BY seq) AS i, actual_engagement / greatest(predicted_engagement, 0.001) AS ratio
  FROM history WHERE actual_engagement IS NOT NULL)"""
_FOLD_CTE = """fold(i, eps) AS (
  SELECT 0::BIGINT, 0.1::DOUBLE
  UNION ALL
  SELECT o.i, CASE WHEN o.ratio > 1.2 THEN greatest(0.05, f.eps * 0.9)
                   WHEN o.ratio < 0.8 THEN least(0.5, f.eps * 1.1) ELSE f.eps END
  FROM fold f JOIN obs o ON o.i = f.i + 1)"""


@register("epsilon_update", "M11", V("""
SELECT 'global' AS policy, round(eps, 10) AS epsilon, (SELECT count(*) FROM obs) AS updates
FROM fold ORDER BY i DESC LIMIT 1""", "history", extra=(_OBS_CTE, _FOLD_CTE), recursive=True))
def q_epsilon_update(spark, sf):
    h = hist(spark, sf).filter(F.col("actual_engagement").isNotNull())
    obs = h.select(F.lit("global").alias("policy"), "seq",
                   (F.col("actual_engagement") / F.greatest("predicted_engagement", F.lit(0.001))).alias("ratio"))
    return FB.epsilon_fold(obs, "policy", "seq", "ratio", eps0=0.1)
