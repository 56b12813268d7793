"""Lexicon lookups over whole texts.

Per-row library calls of the reference (sentiment, topic extraction, stop
words) become joins of exploded word tokens with a word table.  A word table
is usually far below ``spark.sql.autoBroadcastJoinThreshold``, by whose byte size
Catalyst and AQE choose the join; the per-post aggregate runs map-side first (one
partial row per post per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import ENGLISH_STOP_WORDS

# Default sentiment lexicon (word, polarity) and keyword->topic
# table.  Both are inputs; these defaults are the ones the tests use.
DEFAULT_LEXICON = (("the", "0.30"), ("and", "-0.20"), ("le", "0.50"), ("la", "-0.40"), ("on", "0.10"))
DEFAULT_TOPIC_WORDS = (("the", "english"), ("and", "english"), ("der", "german"), ("und", "german"),
                       ("le", "french"), ("la", "french"), ("el", "spanish"), ("de", "europe"))
MAX_TOPICS = 5
#: Least z-score of a learnt word, added count of the smoothing, topics whose words are good and bad.
LEAST_Z, SMOOTHING = 3.0, 0.5
GOOD, BAD = "good", "poor"


def learnt_words(posts: DataFrame, topics: str = "topics", key: str = "uniqueid", text: str = "text",
                 least_z: float = LEAST_Z) -> DataFrame:
    """``word, topic, z``: how far a word's odds of standing in a text of a topic exceed those elsewhere.

    Counted over all posts with topics (a comma string), each word once per post.
    For a word and a topic, the log odds ratio of holding the word, with
    ``SMOOTHING`` added to each of the four counts, is divided by its standard
    deviation (the root of the sum of their reciprocals), so a rare word needs a
    clearer difference than a frequent one.  Words from ``least_z`` on are
    returned.  One shuffle of (word, topic) pairs, summed up in the tasks first:
    its size follows the vocabulary, not the corpus.  Posts without topics or
    without text teach nothing.
    """
    named = F.array_distinct(F.filter(F.transform(F.split(topics, ","), lambda t: F.trim(t)), lambda t: t != ""))
    taught = posts.filter(F.col(topics).isNotNull() & F.col(text).isNotNull()).select(
        F.concat(named, F.array(F.lit(""))).alias("_topics"), F.col(text).alias("_text"))
    # the words are cut inside explode: a column of them is cut again for each filter that Spark derives from its explode
    words = F.explode(F.array_distinct(T.words("_text"))).alias("word")
    per_set = taught.select("_topics", words).groupBy("word", "_topics").agg(F.count(F.lit(1)).alias("_n"))
    per_topic = per_set.select("word", F.explode("_topics").alias("topic"), "_n").groupBy("word", "topic").agg(F.sum("_n").alias("_in"))
    every = per_topic.filter(F.col("topic") == "").select("word", F.col("_in").alias("_all"))
    held = per_topic.filter(F.col("topic") != "").join(every, "word")
    size = taught.select(F.explode("_topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("_posts"))
    total = size.filter(F.col("topic") == "").select(F.col("_posts").alias("_total"))  # one row
    counted = held.join(size, "topic").crossJoin(F.broadcast(total))
    a, b = F.col("_in") + SMOOTHING, F.col("_posts") - F.col("_in") + SMOOTHING
    c = F.col("_all") - F.col("_in") + SMOOTHING
    d = F.col("_total") - F.col("_posts") - F.col("_all") + F.col("_in") + SMOOTHING
    z = (F.log(a) - F.log(b) - F.log(c) + F.log(d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return counted.select("word", "topic", F.round(z, 6).alias("z")).filter(F.col("z") >= least_z)


def learnt_lexicon(words: DataFrame, good: str = GOOD, bad: str = BAD) -> DataFrame:
    """``word, polarity`` from ``learnt_words``: ``z / (1 + z)`` for words of ``good`` posts, less the same for ``bad`` ones."""
    told = words.filter(F.col("topic").isin(good, bad)).withColumn(
        "_p", F.col("z") / (F.col("z") + 1) * F.when(F.col("topic") == good, 1).otherwise(-1))
    return told.groupBy("word").agg(F.round(F.sum("_p"), 2).cast("decimal(4,2)").alias("polarity"))


def lexicon_table(spark: SparkSession, rows=DEFAULT_LEXICON) -> DataFrame:
    return spark.createDataFrame([(w, p) for w, p in rows], "word string, polarity string") \
        .select("word", F.col("polarity").cast("decimal(4,2)").alias("polarity"))


def topic_words_table(spark: SparkSession, rows=DEFAULT_TOPIC_WORDS) -> DataFrame:
    return spark.createDataFrame(list(rows), "word string, topic string")


def _tokens(posts: DataFrame, key: str, text: str) -> DataFrame:
    return posts.select(key, F.explode(T.words(text)).alias("word"))


def sentiment(posts: DataFrame, lexicon: DataFrame, key: str = "uniqueid", text: str = "text") -> DataFrame:
    """Mean polarity (sentiment) and mean |polarity| (subjectivity) of the
    lexicon words in each text; 0 when none match (S4 via C8)."""
    hits = (_tokens(posts, key, text).join(lexicon, "word")
            .withColumn("_c", (F.col("polarity") * 100).cast("long")))
    per = hits.groupBy(key).agg(F.sum("_c").alias("_s"), F.sum(F.abs("_c")).alias("_a"),
                                F.count(F.lit(1)).alias("_n"))
    return (posts.select(key).join(per, key, "left")
            .select(key, F.coalesce(_exact_mean6("_s", "_n"), F.lit(0.0)).alias("sentiment"),
                    F.coalesce(_exact_mean6("_a", "_n"), F.lit(0.0)).alias("subjectivity")))


def _exact_mean6(total_cents: str, n: str):
    """Mean of hundredths rounded half away from zero to 6 places, in integer
    arithmetic, so the result does not depend on the summation order."""
    units = F.expr(f"div(abs({total_cents}) * 20000 + {n}, 2 * {n})")
    return F.signum(F.col(total_cents)) * units / 1_000_000 + F.lit(0.0)


def extract_topics(posts: DataFrame, topic_words: DataFrame, key: str = "uniqueid", text: str = "text",
                   k: int = MAX_TOPICS, short_replies: bool = True) -> DataFrame:
    """Up to k topics per post, most keyword hits first (ties by name); short
    replies get the single topic ``short reply`` (S15), or are read like others
    without ``short_replies``."""
    toks = _tokens(posts.filter(~T.is_short_reply(text)) if short_replies else posts, key, text)
    hits = toks.join(topic_words, "word").groupBy(key, "topic").agg(F.count(F.lit(1)).alias("n"))
    # one list per post, bounded by the size of the topic table
    ranked = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "topic")))
                                   .alias("_r"))
    top = ranked.select(key, F.slice(F.transform("_r", lambda s: s.getField("topic")), 1, k).alias("topics_list"))
    base = posts.select(key, (T.is_short_reply(text) if short_replies else F.lit(False)).alias("_short"))
    return (base.join(top, key, "left")
            .select(key, F.when(F.col("_short"), F.array(F.lit(T.SHORT_REPLY_TOPIC)))
                    .otherwise(F.coalesce("topics_list", F.array().cast("array<string>"))).alias("topics_list")))


def with_processed_text(df: DataFrame, text: str = "text", out: str = "processed_text") -> DataFrame:
    """lower -> word tokens -> drop English stop words -> join with spaces.

    The stop-word test is Spark ML's ``StopWordsRemover`` (a hash-set lookup
    in the JVM), not a per-token scan of the list."""
    from pyspark.ml.feature import StopWordsRemover
    toks = df.withColumn("_tok", T.words(text))
    rm = StopWordsRemover(inputCol="_tok", outputCol="_kept", stopWords=list(ENGLISH_STOP_WORDS),
                          caseSensitive=True)
    return rm.transform(toks).withColumn(out, F.array_join("_kept", " ")).drop("_tok", "_kept")


def fit_topic_one_hot(df: DataFrame, topics_col: str = "topics_list", vocab_size: int = 100):
    """Encoder over the ``vocab_size`` most frequent topics, ordered by count, then name (ties never depend on partitions)."""
    from pyspark.ml.feature import CountVectorizerModel
    counts = df.select(F.explode(topics_col).alias("topic")).filter(F.col("topic").isNotNull()).groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"))
    vocabulary = [r["topic"] for r in counts.orderBy(F.desc("n"), "topic").limit(vocab_size).collect()]
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol=topics_col, outputCol="topic_vec", binary=True)


def topic_one_hot(df: DataFrame, topics_col: str = "topics_list", vocab_size: int = 100):
    """Binary indicator vector over the most frequent topics."""
    model = fit_topic_one_hot(df, topics_col, vocab_size)
    return model.transform(df), model
