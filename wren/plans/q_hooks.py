"""User hooks (U1, U2) run with stand-in services over the post texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hooks as H
from ..operators.landing import ProcessingOptions
from ..sources import fixtures as FX
from ..streaming.feature_job import feature_job
from .catalog import register
from .views_sql import with_views as V


def tag_topics(texts: list[str]) -> list[list[str]]:
    """Stand-in topic service: the hashtags of each text, lower-cased."""
    return [[t.lower() for t in re.findall(r"#(\w+)", x)] for x in texts]


def punctuation_rewrites(texts: list[str]) -> list[list[str]]:
    """Stand-in rewrite service: two punctuation variants per text."""
    return [[x + "!", x + "?"] for x in texts]


@register("map_topics", "U1 S14", V(r"""
SELECT uniqueid, array_to_string(list_transform(regexp_extract_all(text, '#([\p{L}\p{N}_]+)', 1), lambda t: lower(t)), ',')
  AS topics FROM posts""", "posts"))
def q_map_topics(spark, sf):
    p = FX.posts(spark, sf).select("uniqueid", "text")
    return H.map_topics(p, tag_topics).select("uniqueid", F.array_join("topics_list", ",").alias("topics"))


@register("map_candidates", "U2 S19", V(r"""
SELECT uniqueid, md5(array_to_string(
  ([text || '!', text || '?'] || list_transform(range(3), lambda _: CASE WHEN NOT contains(text || '!', '?')
       THEN replace(text || '!', '!', '?') ELSE text || '!' || ' ' || chr(128640) END)), ' | ')) AS items_md5
FROM posts""", "posts"))
def q_map_candidates(spark, sf):
    p = FX.posts(spark, sf).select("uniqueid", "text")
    c = H.map_candidates(p, punctuation_rewrites)
    return c.select("uniqueid", F.md5(F.array_join(T.pad_variations("candidates", "text", 5), " | ")).alias("items_md5"))


#: Topics from the service, no engagement step, at least three words, all posts.
JOB_OPTIONS = ('{"process_topics": true, "max_retries": 2, "delay_between": 0, "max_tweets": null, '
               '"skip_short_replies": true, "min_word_count": 3, "process_engagement": false}')


@register("feature_job", "A16 U1 S14 B3 B6", V(r"""
SELECT uniqueid, n_words, CASE WHEN short THEN 'short reply' WHEN tags = '' THEN topics ELSE tags END AS topics,
  CASE WHEN short THEN 'skipped' ELSE 'completed' END AS processed
FROM (SELECT *, n_words <= 3 AND starts_with(text, '@') AS short FROM (
  SELECT uniqueid, text, topics, text_length, sentiment, processed,
    len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words,
    array_to_string(list_transform(regexp_extract_all(text, '#([\p{L}\p{N}_]+)', 1), lambda t: lower(t)), ',') AS tags FROM posts))
WHERE n_words >= 3 AND (processed IS NULL OR processed = '' OR text_length IS NULL OR sentiment IS NULL
       OR topics IS NULL OR topics IN ('', '[]', 'null'))
  AND (processed IS NULL OR processed NOT IN ('completed', 'skipped', 'error'))""", "posts"))
def q_feature_job(spark, sf):
    words = FX.learnt_words(spark, sf)
    p = FX.posts(spark, sf)
    done = feature_job(p, ProcessingOptions.from_json(JOB_OPTIONS), FX.learnt_lexicon(spark, sf), words, tag_topics)
    counted = p.select("uniqueid", F.size(T.whitespace_words("text")).cast("long").alias("n_words"))
    return done.join(counted, "uniqueid").select("uniqueid", "n_words", "topics", "processed")
