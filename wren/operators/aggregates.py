"""Aggregation operators over the post table.

Each function is ``DataFrame -> DataFrame``.  Group-bys rely on Spark's
partial (map-side) aggregation, so a hot key (one author or topic holding a
third of all rows) is combined inside every task before the shuffle and costs
one row per task, not one row per post.  Top-k reports end in
``orderBy(...).limit(k)``, which plans as ``TakeOrderedAndProject`` (a per-task
top-k, then a merge of k rows per task).  Every ordering has a final unique key
so ties are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .quantiles import exact_percentiles

R = 6  # decimal places for reported means / ratios


def rnd(c: Column, places: int = R) -> Column:
    """Round and fold -0.0 into 0.0 so engines agree on the sign of zero."""
    return F.round(c, places) + F.lit(0.0)


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


# D1 ------------------------------------------------------------------------
def total_and_avg(posts: DataFrame, score: str = "engagement_score") -> DataFrame:
    return posts.agg(
        F.count(F.lit(1)).alias("total_tweets"),
        F.coalesce(rnd(F.avg(score)), F.lit(0.0)).alias("avg_engagement"),
    )


# D2 ------------------------------------------------------------------------
def top_authors(posts: DataFrame, k: int = 10, score: str = "engagement_score") -> DataFrame:
    return (
        posts.groupBy("author_username")
        .agg(F.count(F.lit(1)).alias("tweet_count"), rnd(F.avg(score)).alias("avg_engagement"))
        .orderBy(F.desc_nulls_last("avg_engagement"), F.asc_nulls_first("author_username"))
        .limit(k)
    )


# D3 ------------------------------------------------------------------------
def top_topics(posts: DataFrame, k: int = 20, score: str = "engagement_score") -> DataFrame:
    """Split the comma string, trim spaces, drop empties, count and average."""
    exploded = posts.select(F.explode(T.split_topics("topics")).alias("topic"), F.col(score))
    return (
        exploded.groupBy("topic")
        .agg(F.count(F.lit(1)).alias("tweet_count"), rnd(F.avg(score)).alias("avg_engagement"))
        .orderBy(F.desc("tweet_count"), F.desc_nulls_last("avg_engagement"), F.asc("topic"))
        .limit(k)
    )


# D4 ------------------------------------------------------------------------
def engagement_stats(posts: DataFrame, score: str = "engagement_score") -> DataFrame:
    return posts.agg(
        rnd(F.avg(score)).alias("avg_engagement"),
        F.max(score).alias("max_engagement"),
        F.min(score).alias("min_engagement"),
        rnd(F.avg("like_count")).alias("avg_likes"),
        rnd(F.avg("retweet_count")).alias("avg_retweets"),
        rnd(F.avg("reply_count")).alias("avg_replies"),
    )


# D5 ------------------------------------------------------------------------
def topic_distribution(posts: DataFrame) -> DataFrame:
    """Count whole topic strings first, then split: the explode runs on the
    (small) set of distinct strings instead of on every post."""
    per_string = posts.groupBy(F.coalesce(F.col("topics"), F.lit("")).alias("topics")).count()
    parts = F.filter(F.transform(F.split("topics", ","), lambda x: T.strip_all(x)), lambda x: x != "")
    return (
        per_string.select(F.explode(parts).alias("topic"), "count")
        .groupBy("topic").agg(F.sum("count").alias("tweet_count"))
    )


# D6 ------------------------------------------------------------------------
def topic_string_counts(posts: DataFrame, k: int = 20) -> DataFrame:
    return (
        posts.groupBy("topics").agg(F.count(F.lit(1)).alias("tweet_count"))
        .orderBy(F.desc("tweet_count"), F.asc_nulls_first("topics"))
        .limit(k)
    )


# D7 ------------------------------------------------------------------------
def unique_topics(posts: DataFrame) -> DataFrame:
    """Distinct topic strings, the null string counted as one value."""
    return posts.select("topics").distinct().agg(F.count(F.lit(1)).alias("unique_topics"))


# D8 ------------------------------------------------------------------------
IMPORTANCE_FEATURES = (
    "text_length", "sentiment", "hashtag_count", "mention_count", "url_count",
    "emoji_count", "word_count", "avg_word_length", "flesch_reading_ease",
)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; null when a side
    is constant (ANSI-safe, no division error)."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def feature_importance(features: DataFrame, target: str = "engagement_score",
                       cols: tuple[str, ...] = IMPORTANCE_FEATURES) -> DataFrame:
    """|corr(feature, target)| scaled by the largest; one aggregation pass.

    The features of a row are evaluated once, into an array that is exploded with
    the target beside it; the tasks then add up one row of moments per feature."""
    listed = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    pairs = features.select(F.col(target).cast("double").alias("y"), F.explode(listed).alias("f")).select("y", "f.feature", "f.x")
    long = pairs.groupBy("feature").agg(F.abs(guarded_corr(F.col("x"), F.col("y"))).alias("corr"))
    mx = long.agg(F.max("corr").alias("mx"))
    return (long.crossJoin(F.broadcast(mx))
            .select("feature",
                    rnd(F.when(F.col("mx") > 0, F.col("corr") / F.col("mx")).otherwise(F.col("corr")))
                    .alias("importance")))


# D9 ------------------------------------------------------------------------
def duplicate_ids(posts: DataFrame, key: str = "uniqueid") -> DataFrame:
    return (posts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


# D10 -----------------------------------------------------------------------
MISSING_FIELDS = {"text": "text", "created_at": "created_at", "author": "author_username",
                  "engagement_score": "engagement_score"}


def missing_fields(posts: DataFrame) -> DataFrame:
    return posts.agg(*[count_if(F.col(src).isNull()).alias(f"missing_{name}")
                       for name, src in MISSING_FIELDS.items()])


# D11 -----------------------------------------------------------------------
def health_report(posts: DataFrame, as_of: Column, key: str = "uniqueid", days: int = 7) -> DataFrame:
    recent = F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(days))
    one_pass = posts.agg(
        F.count(F.lit(1)).alias("total_documents"),
        count_if(recent).alias("recent_tweets"),
        *[count_if(F.col(src).isNull()).alias(f"missing_{name}") for name, src in MISSING_FIELDS.items()],
    )
    dups = duplicate_ids(posts, key).agg(F.count(F.lit(1)).alias("duplicate_count"))
    return one_pass.crossJoin(F.broadcast(dups))


# D12 -----------------------------------------------------------------------
def null_counts(df: DataFrame) -> DataFrame:
    cols = df.columns
    wide = df.agg(*[count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    stack = "stack({n}, {pairs}) AS (column_name, null_count)".format(
        n=len(cols), pairs=", ".join(f"'{c}', `{c}`" for c in cols))
    return wide.selectExpr(stack)


# D13 -----------------------------------------------------------------------
def iqr_outliers(posts: DataFrame, score: str = "engagement_score", key: str = "uniqueid") -> DataFrame:
    """Rows strictly outside [q1 - 1.5 IQR, q3 + 1.5 IQR] (exact quartiles)."""
    q1, q3 = exact_percentiles(posts, score, [0.25, 0.75])
    if q1 is None:
        return posts.select(key, score).limit(0)
    iqr = q3 - q1
    lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    return posts.filter((F.col(score) < F.lit(lo)) | (F.col(score) > F.lit(hi))).select(key, score)


# D14 -----------------------------------------------------------------------
def describe_column(df: DataFrame, column: str) -> DataFrame:
    """pandas ``describe()``: count, mean, sample std, min, quartiles, max."""
    q = exact_percentiles(df, column, [0.25, 0.5, 0.75])
    c = F.col(column)
    base = df.agg(
        F.count(c).alias("count"), rnd(F.avg(c)).alias("mean"), rnd(F.stddev_samp(c)).alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
    )
    return base.select("*", *[rnd(F.lit(v).cast("double")).alias(n) for n, v in zip(("p25", "p50", "p75"), q)])


def text_length_describe(posts: DataFrame) -> DataFrame:
    return describe_column(posts.select(F.length("text").alias("text_length")), "text_length")


# D15 -----------------------------------------------------------------------
def date_range(posts: DataFrame) -> DataFrame:
    return posts.agg(F.min("created_at").alias("earliest"), F.max("created_at").alias("latest"))


# D16 -----------------------------------------------------------------------
def eda_engagement_stats(posts: DataFrame, score: str = "engagement_eda") -> DataFrame:
    return posts.agg(
        F.sum(score).alias("total_engagement"), rnd(F.avg(score)).alias("mean_engagement"),
        F.max(score).alias("max_engagement"), F.min(score).alias("min_engagement"),
        rnd(F.stddev_samp(score)).alias("std_engagement"),
    )


# D17 -----------------------------------------------------------------------
def equal_width_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max; the max lands in the last bin."""
    rng = df.agg(F.min(column).cast("double").alias("mn"), F.max(column).cast("double").alias("mx"))
    x = F.col(column).cast("double")
    width = F.col("mx") - F.col("mn")
    b = F.when(width > 0, F.least(F.floor((x - F.col("mn")) * bins / width).cast("int") + 1, F.lit(bins))) \
        .otherwise(F.lit(1))
    return (df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(rng))
            .groupBy(b.alias("bin"), "mn", "mx").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", rnd(F.col("mn") + (F.col("bin") - 1) * (F.col("mx") - F.col("mn")) / bins).alias("bin_start"),
                    "n"))


# D18 / D19 -----------------------------------------------------------------
def hourly_counts(posts: DataFrame) -> DataFrame:
    return (posts.filter(F.col("created_at").isNotNull())
            .groupBy(F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("n")))


def daily_counts(posts: DataFrame) -> DataFrame:
    return (posts.filter(F.col("created_at").isNotNull())
            .groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n")))


# D20 -----------------------------------------------------------------------
def top_items(df: DataFrame, array_col: Column, name: str, k: int = 20) -> DataFrame:
    return (df.select(F.explode(array_col).alias(name))
            .groupBy(name).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(name)).limit(k))


def hashtags(text: str | Column) -> Column:
    return F.regexp_extract_all(T._c(text), F.lit(r"#([\p{L}\p{N}_]+)"), 1)


def mentions(text: str | Column) -> Column:
    return F.regexp_extract_all(T._c(text), F.lit(r"@([\p{L}\p{N}_]+)"), 1)


def top_hashtags(posts: DataFrame, k: int = 20) -> DataFrame:
    return top_items(posts, hashtags("text"), "hashtag", k)


# D21 / D22 -----------------------------------------------------------------
def top_users_by_count(posts: DataFrame, k: int = 20) -> DataFrame:
    return (posts.filter(F.col("author_username").isNotNull())
            .groupBy("author_username").agg(F.count(F.lit(1)).alias("tweet_count"))
            .orderBy(F.desc("tweet_count"), F.asc("author_username")).limit(k))


def top_users_by_engagement(posts: DataFrame, score: str = "engagement_eda", k: int = 20) -> DataFrame:
    return (posts.filter(F.col("author_username").isNotNull())
            .groupBy("author_username").agg(rnd(F.avg(score)).alias("avg_engagement"))
            .orderBy(F.desc_nulls_last("avg_engagement"), F.asc("author_username")).limit(k))


# D23 / D24 -----------------------------------------------------------------
def cluster_stats(df: DataFrame, cluster: str = "cluster", score: str = "engagement_eda") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), rnd(F.avg(score)).alias("avg_engagement"))


def cluster_top_tags(df: DataFrame, cluster: str = "cluster", k: int = 5) -> DataFrame:
    """Per cluster the k most frequent hashtags and mentions.

    ``row_number() <= k`` over (cluster, kind) is planned with a partial
    window-group-limit before the shuffle, so a hot cluster ships at most k
    rows per task.
    """
    from pyspark.sql import Window
    tags = df.select(cluster, F.lit("hashtag").alias("kind"), F.explode(F.col("hashtags")).alias("tag"))
    ments = df.select(cluster, F.lit("mention").alias("kind"), F.explode(F.col("mentions")).alias("tag"))
    counted = tags.unionByName(ments).groupBy(cluster, "kind", "tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(cluster, "kind").orderBy(F.desc("n"), F.asc("tag"))
    return counted.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).drop("rk")


# D25 -----------------------------------------------------------------------
def trending_topics(posts: DataFrame, as_of: Column, k: int = 20, score: str = "engagement_score") -> DataFrame:
    recent = posts.filter(
        (F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(1)))
        & F.col("topics").isNotNull() & (F.col("topics") != ""))
    return (recent.groupBy("topics")
            .agg(F.count(F.lit(1)).alias("tweet_count"), rnd(F.avg(score)).alias("avg_engagement"))
            .orderBy(F.desc_nulls_last("avg_engagement"), F.asc("topics")).limit(k))


# D26 -----------------------------------------------------------------------
def pipeline_status(posts: DataFrame) -> DataFrame:
    p, tp = F.col("processed"), F.col("topics")
    return posts.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(p.isNull() | (p == "")).alias("unprocessed"),
        count_if(F.col("text_length").isNull() | F.col("sentiment").isNull()).alias("missing_features"),
        count_if(tp.isNull() | tp.isin("", "[]", "null")).alias("missing_topics"),
        count_if(p == "completed").alias("completed"),
        count_if(p == "skipped").alias("skipped"),
        count_if(p == "error").alias("error"),
    )


# D44 / D45 / D46 -----------------------------------------------------------
def table_profile(df: DataFrame) -> DataFrame:
    """Row count and mean serialized (JSON) row size in bytes."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  rnd(F.avg(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).alias("avg_row_bytes"))


def sample_types(df: DataFrame) -> DataFrame:
    """Field names and types (from the schema; no data is read)."""
    spark = df.sparkSession
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                 "field string, type string")


def training_summary(df: DataFrame, score: str = "engagement_eda") -> DataFrame:
    """Samples, count above the median, mean engagement."""
    (median,) = exact_percentiles(df, score, [0.5])
    return df.agg(
        F.count(F.lit(1)).alias("samples"),
        count_if(F.col(score) > F.lit(median)).alias("high_engagement"),
        rnd(F.avg(score)).alias("mean_engagement"),
    )
