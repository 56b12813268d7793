"""Filters, projections and top-k operators.

Filters are plain ``Column`` predicates so Catalyst pushes the null tests and
equality tests into the Parquet scan.  Every ``limit`` follows an ``orderBy``
with a unique final key: the reference's unordered ``find().limit()`` becomes a
deterministic top-k (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Processing status set.
DONE_STATES = ("completed", "skipped", "error")
EMPTY_TOPICS = ("", "[]", "null")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


# B1
def post_by_id(posts: DataFrame, uniqueid: str) -> DataFrame:
    return posts.filter(F.col("uniqueid") == F.lit(uniqueid))


# B2
def unprocessed_predicate() -> Column:
    return (F.col("text_length").isNull() | F.col("sentiment").isNull() | _blank("processed"))


def unprocessed_posts(posts: DataFrame, limit: int = 100) -> DataFrame:
    return posts.filter(unprocessed_predicate()).orderBy("uniqueid").limit(limit)


# B3 / B16
def needs_work_predicate() -> Column:
    """The 8-way OR of the batch job (status not considered)."""
    tp = F.col("topics")
    return (_blank("processed") | F.col("text_length").isNull() | F.col("sentiment").isNull()
            | tp.isNull() | tp.isin(*EMPTY_TOPICS))


def not_finished() -> Column:
    """Mongo ``$nin`` keeps nulls; SQL ``NOT IN`` would drop them."""
    p = F.col("processed")
    return p.isNull() | ~p.isin(*DONE_STATES)


def posts_to_process(posts: DataFrame, batch_size: int | None = 50) -> DataFrame:
    out = posts.filter(needs_work_predicate() & not_finished())
    return out.orderBy("uniqueid").limit(batch_size) if batch_size is not None else out


def backlog_count(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count_if(F.coalesce(needs_work_predicate(), F.lit(False))).alias("backlog"))


# B4
def processed_predicate() -> Column:
    return F.col("text_length").isNotNull() & F.col("sentiment").isNotNull() & F.col("topics").isNotNull()


def processed_posts(posts: DataFrame, limit: int = 100) -> DataFrame:
    return posts.filter(processed_predicate()).orderBy("uniqueid").limit(limit)


# B5
def similar_posts(posts: DataFrame, query_text: str, limit: int = 5) -> DataFrame:
    """Case-insensitive literal containment of the query's first 50 characters."""
    needle = query_text[:50].lower()
    return (posts.filter(processed_predicate() & F.lower(F.col("text")).contains(F.lit(needle)))
            .orderBy("uniqueid").limit(limit))


# B6
def short_reply_updates(posts: DataFrame) -> DataFrame:
    """Rows the batch job marks as skipped short replies, with their minimal features."""
    return posts.filter(T.is_short_reply("text")).select(
        "uniqueid",
        F.length("text").alias("text_length"),
        F.size(T.whitespace_words("text")).alias("word_count"),
        F.lit(0.0).alias("sentiment"),
        F.lit(T.SHORT_REPLY_TOPIC).alias("topics"),
        F.lit("skipped").alias("processed"),
    )


# B7
FEATURE_COLUMNS = ("text_length", "sentiment", "hashtag_count", "mention_count", "url_count",
                   "emoji_count", "word_count", "avg_word_length", "flesch_reading_ease", "engagement_score")


def feature_projection(features: DataFrame, cols: tuple[str, ...] = FEATURE_COLUMNS) -> DataFrame:
    return features.select("uniqueid", *cols)


# B8
def top_posts_recent(posts: DataFrame, as_of: Column, days: int = 7, k: int = 10) -> DataFrame:
    return (posts.filter(F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
            .orderBy(F.desc_nulls_last("engagement_score"), "uniqueid")
            .select("uniqueid", "text", "author_username", "engagement_score", "created_at", "topics")
            .limit(k))


# B9
def training_rows(posts: DataFrame, limit: int = 1000) -> DataFrame:
    """The ``limit`` newest posts with a score.  The order is found without the texts; only rows of the chosen keys
    carry theirs to the last step."""
    rows = posts.filter(F.col("engagement_score").isNotNull())
    order = [F.desc_nulls_last("created_at"), F.col("uniqueid")]
    chosen = rows.select("uniqueid", "created_at").orderBy(*order).limit(limit).select(F.col("uniqueid").alias("_chosen")).distinct()
    return (rows.select("uniqueid", "text", "engagement_score", "topics", "created_at")
            .join(chosen, F.col("uniqueid").eqNullSafe(F.col("_chosen")), "left_semi").orderBy(*order).limit(limit))


# B10
def history_filter(history: DataFrame, start: str, end: str, min_predicted: float = 0.0) -> DataFrame:
    day = F.to_date("feedback_collected_at")
    return (history.filter((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date"))
                           & (F.col("predicted_engagement") >= F.lit(min_predicted)))
            .select("seq", "predicted_engagement", "actual_engagement",
                    F.round((F.try_divide(F.col("actual_engagement"), F.col("predicted_engagement")) - 1) * 100, 6)
                    .alias("pct_vs_predicted")))


# B12
def pending_feedback(history: DataFrame, limit: int = 100) -> DataFrame:
    return (history.filter(F.col("actual_engagement").isNull())
            .orderBy(F.desc("seq")).select("seq", "run_id", "iteration", "predicted_engagement").limit(limit))


# B13
def recent_count(posts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return posts.agg(F.count_if(F.coalesce(F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(days)),
                                           F.lit(False))).alias("recent_tweets"))


# B14 (uses C5)
def verified_predicate() -> Column:
    p, tp = F.col("processed"), F.col("topics")
    done = ((p == "completed") & F.col("text_length").isNotNull() & F.col("sentiment").isNotNull()
            & tp.isNotNull() & (tp != ""))
    return F.coalesce(done | (p == "skipped"), F.lit(False))


def verify_update(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Of the given ids, how many are completed with all fields, or skipped."""
    batch = posts.join(ids.select("uniqueid").distinct(), "uniqueid", "left_semi")
    return batch.agg(F.count(F.lit(1)).alias("checked"), F.count_if(verified_predicate()).alias("verified"))


# B15
def error_posts(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("processed") == "error").select("uniqueid")


# F1
def recent_posts(posts: DataFrame, limit: int = 100) -> DataFrame:
    if limit < 0:
        raise ValueError("limit must be non-negative")
    return (posts.orderBy(F.desc_nulls_last("created_at"), "uniqueid")
            .select("uniqueid", "author_username", "created_at").limit(limit))


# F2
def best_index(scores: Column) -> Column:
    """0-based position of the highest score; first position on ties (``np.argmax``)."""
    idx = F.transform(scores, lambda s, i: F.struct(s.alias("s"), (-i).alias("neg_i")))
    best = F.array_max(idx)
    return -best.getField("neg_i")


def best_variation(df: DataFrame, key: str, candidates: str, scores: str) -> DataFrame:
    bi = best_index(F.col(scores))
    return df.select(key, bi.alias("best_idx"),
                     F.element_at(F.col(candidates), bi + 1).alias("best_variation"),
                     F.element_at(F.col(scores), bi + 1).alias("best_score"))


# F3
def best_prompt(prompts: DataFrame, default_prompt: str | None = None) -> DataFrame:
    """Prompt with the best average engagement; earliest version on ties."""
    best = prompts.agg(F.max_by(F.struct("version", "prompt"),
                                F.struct("avg_engagement", (-F.col("version")).alias("nv"))).alias("b"))
    out = best.select(F.col("b.version").alias("version"), F.col("b.prompt").alias("prompt"))
    if default_prompt is not None:
        out = out.select(F.col("version"), F.coalesce("prompt", F.lit(default_prompt)).alias("prompt"))
    return out


# F4
def ranked_variations(history: DataFrame, score_fn) -> DataFrame:
    """Candidates of each run's last iteration, ordered by score (global sort)."""
    last = history.groupBy("run_id").agg(F.max("iteration").alias("iteration"))
    rows = history.join(last, ["run_id", "iteration"], "left_semi")
    cands = rows.select("run_id", "seq", F.posexplode("variations").alias("idx", "variation"))
    return (cands.withColumn("score", score_fn(F.col("variation")))
            .select("run_id", "seq", "idx", "score")
            .orderBy("run_id", F.desc("score"), "idx"))


# F5
def top_topic_vocabulary(posts: DataFrame, n: int = 100) -> DataFrame:
    return (posts.select(F.explode(T.split_topics("topics")).alias("topic"))
            .groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "topic").limit(n))


# F6
def _digest_bound(rows: int, n: int) -> str | None:
    """A hexadecimal digest below which n of ``rows`` random ones lie almost surely; none where that is most of the range."""
    share = (n + 8 * n ** 0.5 + 32) / max(rows, 1)
    return f"{int(share * 2 ** 32):08x}" if share < 0.5 else None


def episode_sample(df: DataFrame, key: str, episodes: int, n: int, seed: int = 42) -> DataFrame:
    """Per episode, n rows without replacement, chosen by a seeded digest.

    Episodes are generated per key (no join).  The n-th least digest of an episode is
    near ``n / rows`` of their range, so those far above it are left out before the
    shuffle (all are kept if an episode turns out to have fewer than n below the bound);
    ``row_number() <= n`` per episode is planned with a partial window-group-limit.  The
    other columns are joined to the ``episodes * n`` keys that were picked.
    """
    from pyspark.sql import Window
    ep = df.select(key, F.explode(F.sequence(F.lit(1), F.lit(episodes))).alias("episode"))
    ep = ep.withColumn("_h", F.md5(F.concat_ws(":", key, F.col("episode").cast("string"), F.lit(str(seed))).cast("binary")))
    bound = _digest_bound(df.count(), n)
    if bound:
        low = ep.filter(F.col("_h") < bound)
        least = low.groupBy("episode").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("e"), F.min("n").alias("n")).first()
        if least["e"] == episodes and least["n"] >= n:
            ep = low
    w = Window.partitionBy("episode").orderBy("_h", key)
    picked = ep.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).select(key, "episode")
    return df.join(picked, key).select(*df.columns, "episode")
