"""Rewrite rounds whose candidates append to their seed (M8, M9), without tokenising a candidate.

The fixed rewrites add punctuation or an emoji, so a candidate's features follow from
its seed's counts and those of the suffix: lengths, emojis, sentences and words add up
with a correction where the two meet, and words, syllables, sentiment and topics stay.
A seed is tokenised and joined with the word tables once; every later round starts from
the counts of the candidate that was chosen.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ensure_checkpoint_dir
from . import lexicon as LX
from .feedback import epsilon_greedy

#: The fixed rewrites in their order.
SUFFIXES = ("", "!", " " + T.ROCKET, "?", " " + T.SPARKLES)

Predict = Callable[[DataFrame], DataFrame]  # adds ``predicted_engagement`` for numeric features and ``topics_list``


def _last(text: Column) -> Column:
    return F.substring(text, -1, 1)


def measure(seeds: DataFrame, lexicon: DataFrame, topic_words: DataFrame, key: str = "uniqueid") -> DataFrame:
    """``(key, text, counts)``: all that a score needs to know of a text, from one tokenisation."""
    t = F.col("text")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    own = seeds.select(
        key, "text", T.text_length(t).alias("chars"), T.word_count(t).alias("words"), T.hashtag_count(t).alias("hashtags"),
        T.mention_count(t).alias("mentions"), T.emoji_count(t).alias("emojis"), T.count_matches(t, T.SENTENCE_END).alias("ends"),
        zero(T.syllables(t)).alias("syllables"), zero(F.size(T.whitespace_words(t))).alias("parts"),
        F.coalesce(t.startswith("@"), F.lit(False)).alias("reply"),
        F.coalesce(_last(t).isin(".", "!", "?"), F.lit(False)).alias("ended"),
        F.coalesce((t == "") | _last(t).rlike(r"\s"), F.lit(False)).alias("spaced"))
    felt = LX.sentiment(seeds.select(key, "text"), lexicon, key, "text")
    named = LX.extract_topics(seeds.select(key, "text"), topic_words, key, "text", short_replies=False)
    done = own.join(felt, key).join(named.withColumnRenamed("topics_list", "named"), key)
    return done.select(key, "text", F.struct(*[c for c in done.columns if c not in (key, "text")]).alias("counts"))


def append_counts(no_text: Column, counts: Column, suffix: Column) -> Column:
    """The counts with ``suffix``, which has no word character, at the end; those of a null text stay as they are."""
    c = counts.getField
    joins = ~suffix.rlike(r"^\s") & ~c("spaced")  # the suffix goes on with the last whitespace-separated word
    run_on = suffix.rlike("^[.!?]") & c("ended")
    changed = counts
    for name, value in {
        "chars": c("chars") + F.length(suffix), "emojis": c("emojis") + T.count_matches(suffix, T.EMOJI),
        "ends": c("ends") + T.count_matches(suffix, T.SENTENCE_END) - run_on.cast("int"),
        "parts": c("parts") + F.size(T.whitespace_words(suffix)) - joins.cast("int"),
        "reply": F.when(c("chars") == 0, suffix.startswith("@")).otherwise(c("reply")),
        "ended": _last(suffix).isin(".", "!", "?"), "spaced": _last(suffix).rlike(r"\s"),
    }.items():
        changed = changed.withField(name, value)
    return F.when(no_text | (suffix == ""), counts).otherwise(changed)


def append(text: Column, counts: Column, suffix: Column) -> tuple[Column, Column]:
    """Text and counts with ``suffix`` at the end; a null text stays as it is."""
    return F.concat(text, suffix), append_counts(text.isNull(), counts, suffix)


def features(counts: Column) -> dict[str, Column]:
    """The model's inputs from the counts, equal to those of the text."""
    c = counts.getField
    ease = F.lit(206.835) - F.lit(1.015) * (c("words") / F.greatest(F.lit(1), c("ends"))) - F.lit(84.6) * (c("syllables") / c("words"))
    return {
        "text_length": c("chars"), "word_count": c("words"), "hashtag_count": c("hashtags"), "mention_count": c("mentions"),
        "emoji_count": c("emojis"), "flesch_reading_ease": F.when(c("words") > 0, ease).otherwise(F.lit(0.0)),
        "sentiment": c("sentiment"), "subjectivity": c("subjectivity"),
        "topics_list": F.when(c("reply") & (c("parts") <= 3), F.array(F.lit(T.SHORT_REPLY_TOPIC))).otherwise(c("named")),
    }


def optimize_appended(seeds: DataFrame, predict: Predict, lexicon: DataFrame, topic_words: DataFrame, n_iterations: int = 3,
                      n_variations: int = 5, epsilon: float = 0.0, suffixes: tuple[str, ...] = SUFFIXES,
                      key: str = "uniqueid") -> DataFrame:
    """The history of ``optimize.optimize_posts`` with its fixed rewrites: seed plus each of ``suffixes``."""
    if not 1 <= n_iterations <= 10:
        raise ValueError("n_iterations must be within 1..10")
    if any(re.search(r"\w", s) for s in suffixes):
        raise ValueError("a suffix with word characters changes the words of its seed")
    ensure_checkpoint_dir(seeds.sparkSession)
    texts = seeds.select(key, "text")
    again = texts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit(True).alias("again")).checkpoint(eager=True)
    measured, t = measure(texts, lexicon, topic_words, key), F.col("text")
    # Rounds carry what was appended, not the texts; only the rows of a key that repeats carry theirs.
    if again.isEmpty():
        state = measured.select(key, F.lit(False).alias("again"), F.lit(None).cast("string").alias("own"),
                                t.isNull().alias("no_text"), "counts")
        alone = texts
    else:
        state = measured.join(again, key, "left").withColumn("again", F.coalesce("again", F.lit(False))).select(
            key, "again", F.when(F.col("again"), t).alias("own"), t.isNull().alias("no_text"), "counts")
        alone = texts.join(again, key, "left_anti")

    def scored(df: DataFrame) -> DataFrame:
        return predict(df.withColumns(features(F.col("counts")))).withColumnRenamed("predicted_engagement", "score")

    first = scored(state).select(
        key, F.lit(0).alias("iteration"), "again", "own", "no_text", F.lit("").alias("base"), F.lit("").alias("tail"), "score",
        F.lit(None).cast("array<string>").alias("repeated"), F.lit(None).cast("int").alias("selected_idx"),
        F.lit(False).alias("is_exploration"), "counts")
    rounds = [first.checkpoint(eager=True)]
    for i in range(1, n_iterations + 1):
        rows = rounds[-1].select(key, "again", "own", "no_text", F.col("tail").alias("base"), F.col("counts").alias("of_seed"),
                                 F.posexplode(F.array(*[F.lit(s) for s in suffixes[:n_variations]])).alias("idx", "suffix"))
        tail = F.concat("base", "suffix")
        # a post's candidates: at most ``n_variations`` rows
        fields = ("idx", "text", "score", "counts", "again", "own", "no_text", "base", "tail")
        per = scored(rows.select(key, "idx", F.concat("own", tail).alias("text"), tail.alias("tail"), "again", "own", "no_text", "base",
                                 append_counts(F.col("no_text"), F.col("of_seed"), F.col("suffix")).alias("counts"))).groupBy(key).agg(
            F.sort_array(F.collect_list(F.struct(*fields))).alias("_c"),
            F.max_by("idx", F.struct("score", (-F.col("idx")).alias("ni"))).alias("best_idx"))
        chosen = epsilon_greedy(per, F.col(key), F.lit(i), F.size("_c"), F.col("best_idx"), epsilon)
        pick = F.element_at("_c", F.col("selected_idx") + 1)
        rounds.append(chosen.select(
            key, F.lit(i).alias("iteration"), *[pick.getField(c).alias(c) for c in ("again", "own", "no_text", "base", "tail", "score")],
            F.when(pick.getField("again"), F.transform("_c", lambda c: c.getField("text"))).alias("repeated"),
            F.col("selected_idx").cast("int").alias("selected_idx"), "is_exploration",
            pick.getField("counts").alias("counts")).checkpoint(eager=True))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    whole = F.when(F.col("again"), F.col("own")).otherwise(t)
    tried = F.array(*[F.concat(t, "base", F.lit(s)) for s in suffixes[:n_variations]])
    return out.drop("counts").join(alone, key, "left").select(
        key, "iteration", F.concat(whole, "tail").alias("tweet"), F.col("score").alias("predicted_engagement"),
        F.when(F.col("iteration") == 0, F.array().cast("array<string>")).when(F.col("again"), F.col("repeated")).otherwise(tried)
        .alias("variations"), "selected_idx", "is_exploration")
