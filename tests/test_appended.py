"""Rounds on counts: equal to rounds that tokenise every candidate."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wren.operators import appended as AP
from wren.operators import lexicon as LX
from wren.operators import ml as ML
from wren.operators import optimize as OPT

TEXTS = ["", " ", "hi", "hi!", "hi ", "what?!", "@a b", "@a b c", "@a b c ", "@", "#x @y great news. Bad day", "end.", None,
         "love \U0001F680", "ΟΔΟΣ great", "tech and tech!\n", "line\nend.\n", "@a love it", "hate? ! ", "xyz brr tsk", "a\u00a0"]


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(TEXTS)], "uniqueid string, text string")


def plain_features(spark, df):
    f = ML.numeric_features(df).drop("sentiment", "subjectivity").join(LX.sentiment(df, LX.lexicon_table(spark)), "uniqueid")
    return f.join(LX.extract_topics(df, LX.topic_words_table(spark)), "uniqueid")


def test_counts_of_appended_texts_give_the_features_of_the_texts(spark, seeds):
    suffixes = [*AP.SUFFIXES, "...", ". ", " !", "\n", "@ ?", "  "]
    state = AP.measure(seeds, LX.lexicon_table(spark), LX.topic_words_table(spark))
    for _ in range(2):  # counts of appended texts are appended to again
        rows = state.select("uniqueid", F.col("text").alias("seed"), F.col("counts").alias("was"),
                            F.posexplode(F.array(*[F.lit(s) for s in suffixes])).alias("i", "suffix"))
        text, counts = AP.append(F.col("seed"), F.col("was"), F.col("suffix"))
        state = rows.select(F.concat_ws(":", "uniqueid", "i").alias("uniqueid"), text.alias("text"), counts.alias("counts")).checkpoint()
    names = [*ML.NUMERIC_FEATURES, "topics_list"]
    got = {r["uniqueid"]: tuple(r[1:]) for r in state.withColumns(AP.features(F.col("counts"))).select("uniqueid", *names).collect()}
    want = {r["uniqueid"]: tuple(r[1:]) for r in plain_features(spark, state.select("uniqueid", "text")).select("uniqueid", *names).collect()}
    assert len(got) == len(TEXTS) * len(suffixes) ** 2 and got == want


def test_rounds_equal_those_that_tokenise_every_candidate(spark, seeds):
    predict = lambda df: df.withColumn("predicted_engagement", (
        F.col("text_length") * 0.01 + F.col("emoji_count") * 2 - F.abs(F.col("flesch_reading_ease") - 60) * 0.1
        + F.col("sentiment") + F.size("topics_list") * 0.5 + F.array_contains("topics_list", "short reply").cast("int")))

    def scorer(df):
        keyed = df.withColumn("_k", F.concat_ws(":", *[F.col(c).cast("string") for c in df.columns if c != "text"]))
        f = plain_features(spark, keyed.select(F.col("_k").alias("uniqueid"), "text"))
        return keyed.join(predict(f).select(F.col("uniqueid").alias("_k"), F.col("predicted_engagement").alias("score")), "_k").drop("_k")

    rows = lambda df: sorted(map(repr, df.collect()))
    some = seeds.filter("text IS NOT NULL")
    want = OPT.optimize_posts(some, scorer, n_iterations=2, n_variations=5, epsilon=0.3)
    got = AP.optimize_appended(some, predict, LX.lexicon_table(spark), LX.topic_words_table(spark), 2, 5, 0.3)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert AP.optimize_appended(seeds.limit(0), predict, LX.lexicon_table(spark), LX.topic_words_table(spark), 1).count() == 0
    with pytest.raises(ValueError):
        AP.optimize_appended(some, predict, LX.lexicon_table(spark), LX.topic_words_table(spark), suffixes=(" now",))


def test_rounds_carry_no_texts(spark, seeds, monkeypatch):
    predict = lambda df: df.withColumn("predicted_engagement", F.col("text_length") * 1.0)
    stored, kind = [], type(seeds)
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: stored.append(self.columns) or real(self, *a, **k))
    some = seeds.filter("uniqueid IN ('p2', 'p3', 'p12')")
    got = AP.optimize_appended(some, predict, LX.lexicon_table(spark), LX.topic_words_table(spark), 1)
    assert stored and not any({"text", "tweet", "variations"} & set(c) for c in stored)
    assert {(r["uniqueid"], r["tweet"]) for r in got.filter("iteration = 1").collect()} == {
        ("p2", "hi \U0001F680"), ("p3", "hi! \U0001F680"), ("p12", None)}
