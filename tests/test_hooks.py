"""User hooks: batch calls on distinct texts, retries, fallback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wren.operators import hooks as H


def test_map_topics_joins_back_to_every_row(spark):
    df = spark.createDataFrame([(1, "a #x"), (2, "a #x"), (3, "b")], "id long, text string")
    out = H.map_topics(df, lambda ts: [[w[1:] for w in t.split() if w.startswith("#")] for t in ts])
    got = {r["id"]: r["topics_list"] for r in out.collect()}
    assert got == {1: ["x"], 2: ["x"], 3: []}


def test_failing_service_falls_back_to_empty(spark):
    def broken(texts):
        raise RuntimeError("service down")
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    got = H.map_candidates(df, broken, retries=2).first()
    assert got["candidates"] == []


def test_wrong_length_result_is_retried_then_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    out = H.map_topics(df, lambda ts: [["one too many"]] * (len(ts) + 1), retries=2)
    assert all(r["topics_list"] == [] for r in out.collect())


def test_candidates_are_padded_downstream(spark):
    from wren.functions import text as T
    df = spark.createDataFrame([(1, "hi")], "id long, text string")
    c = H.map_candidates(df, lambda ts: [[t + "!"] for t in ts])
    got = c.select(T.pad_variations("candidates", "text", 3)).first()[0]
    assert got == ["hi!", "hi?", "hi?"]


def test_one_bad_text_costs_itself_only(spark):
    def service(texts):
        if "bad 77" in texts:
            raise ValueError("cannot take this one")
        return [[t] for t in texts]
    df = spark.createDataFrame([(i, f"bad {i}") for i in range(200)] + [(500, None)], "id long, text string")
    out = {r["id"]: r for r in H.map_topics(df, service, retries=1).collect()}
    assert len(out) == 201 and out[77]["topics_list"] == [] and out[77]["topics_list_failed"]
    assert out[500]["topics_list"] == [] and not out[500]["topics_list_failed"]
    assert all(out[i]["topics_list"] == [f"bad {i}"] and not out[i]["topics_list_failed"] for i in range(200) if i != 77)


def test_every_option_of_the_feature_job_has_effect(spark):
    from wren.operators import lexicon as LX
    from wren.operators.landing import ProcessingOptions
    from wren.sources import fixtures as FX
    from wren.streaming.feature_job import ENGAGEMENT_COLUMNS, feature_job

    from .conftest import SF001

    posts = (FX.posts(spark, SF001).limit(5).withColumn("processed", F.lit(None).cast("string"))
             .withColumn("topics", F.lit("old")).withColumn("n", F.row_number().over(Window.orderBy("uniqueid")))
             .withColumn("uniqueid", F.col("n").cast("string"))
             .withColumn("text", F.element_at(F.array(F.lit("one two three"), F.lit("@a hi"), F.lit("boom goes it now"),
                                                      F.lit("two words"), F.lit(None).cast("string")), F.col("n"))).drop("n"))
    posts = posts.cache()
    lexicon, words = LX.lexicon_table(spark), LX.topic_words_table(spark)

    def service(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("service down")
        return [[f"n{len(t)}"] for t in texts]

    def run(fn=service, **options):
        opts = ProcessingOptions(**{"delay_between": 0.0, "max_retries": 1, "max_tweets": None, **options})
        out = feature_job(posts, opts, lexicon, words, fn)
        return out.columns, {r["uniqueid"]: (r["topics"], r["processed"]) for r in out.collect()}

    columns, rows = run()
    assert set(ENGAGEMENT_COLUMNS) <= set(columns)
    assert rows == {"1": ("n13", "completed"), "2": ("short reply", "skipped"), "3": ("old", "error"), "4": ("n9", "completed"),
                    "5": ("old", "completed")}
    columns, rows = run(process_topics=False, process_engagement=False)
    assert not set(ENGAGEMENT_COLUMNS) & set(columns)
    assert {k: v for k, v in rows.items() if k != "2"} == {k: ("old", "completed") for k in "1345"}
    assert run(min_word_count=3)[1].keys() == {"1", "3"}
    assert run(max_tweets=2)[1].keys() == {"1", "2"}
    assert run(skip_short_replies=False)[1]["2"] == ("n5", "completed")
    posts.unpersist()
