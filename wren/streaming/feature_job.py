"""The feature job over a table, with all its options (A16); the stream's batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hooks as H
from ..operators import selection as S
from ..operators.landing import ProcessingOptions
from ..session import stored
from .jobs import feature_columns

#: Columns of the engagement step.
ENGAGEMENT_COLUMNS = ("engagement_score", "popularity_index", "follower_following_ratio")


def feature_job(posts: DataFrame, options: ProcessingOptions, lexicon: DataFrame, topic_words: DataFrame,
                topic_service: H.TextFn | None = None, as_of: Column | None = None) -> DataFrame:
    """Features of the posts (one row per ``uniqueid``) that still need them, to be upserted by ``uniqueid``.

    * ``min_word_count`` leaves out posts of fewer words, ``max_tweets`` takes that many in
      the order of their ids (None: all, without a sort);
    * ``skip_short_replies``: short replies get minimal features and ``skipped``, else they are worked like others;
    * ``process_topics``: topics by ``topic_service`` where one is given, else by ``topic_words``; switched off, posts
      keep theirs.  A post whose call failed ``max_retries`` times, ``delay_between`` seconds apart and growing, keeps its
      topics and is marked ``error``;
    * ``process_engagement``: switched off, the columns of that step are left out, so an upsert leaves the stored ones.

    Null texts have no topics and zero features; an empty table gives an empty result.
    """
    todo = S.posts_to_process(posts, None)
    if options.min_word_count > 0:
        todo = todo.filter(F.size(T.whitespace_words("text")) >= options.min_word_count)
    if options.max_tweets is not None:
        todo = todo.orderBy("uniqueid").limit(options.max_tweets)
    todo = stored(todo, "todo")  # every step reads the texts
    by_words = options.process_topics and topic_service is None
    done = feature_columns(todo, lexicon, topic_words if by_words else topic_words.limit(0), as_of, options.skip_short_replies)
    if options.process_topics and topic_service is not None:
        asked = todo.filter(~T.is_short_reply("text")) if options.skip_short_replies else todo
        named = H.map_topics(asked.select("uniqueid", "text"), topic_service, retries=options.max_retries,
                             delay_s=options.delay_between)
        named = named.select("uniqueid", F.nullif(T.topics_to_csv(F.col("topics_list")), F.lit("")).alias("_named"),
                             F.col("topics_list_failed").alias("_failed"))
        columns = done.columns
        done = (done.join(named, "uniqueid", "left").withColumn("topics", F.coalesce("_named", "topics"))
                .withColumn("processed", F.when(F.col("_failed"), F.lit("error")).otherwise(F.col("processed"))).select(*columns))
    return done if options.process_engagement else done.drop(*ENGAGEMENT_COLUMNS)
