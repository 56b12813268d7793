"""Aggregations and top-k on the sample tables, including ties and nulls."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wren.operators import aggregates as A
from wren.operators import selection as S
from wren.operators.enrich import with_scores
from wren.operators.quantiles import exact_percentiles


def test_top_topics_split_trim_drop_empty(spark, edge_posts):
    got = {r["topic"]: r["tweet_count"] for r in A.top_topics(with_scores(edge_posts)).collect()}
    assert got == {"tech": 4, "ai": 3, "data": 1, "science": 1}


def test_top_topics_ties_are_deterministic(spark, sample_posts):
    rows = A.top_topics(with_scores(sample_posts), k=2).collect()
    assert [r["topic"] for r in rows] == ["dl", "ml"]  # same count, higher engagement first, then name


def test_topic_distribution_counts_whole_strings_then_splits(spark, edge_posts):
    got = {r["topic"]: r["tweet_count"] for r in A.topic_distribution(edge_posts).collect()}
    assert got == {"tech": 4, "ai": 3, "data": 1, "science": 1}


def test_unique_topics_counts_null_once(spark, edge_posts):
    assert A.unique_topics(edge_posts).first()[0] == 7


def test_top_authors_null_key_is_a_group(spark, sample_posts):
    df = with_scores(sample_posts.union(sample_posts.withColumn("author_username", F.lit(None))))
    rows = A.top_authors(df).collect()
    assert any(r["author_username"] is None for r in rows)


@pytest.mark.parametrize("n", [1, 2, 5, 100, 1001])
def test_exact_percentiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = rng.integers(0, 50, n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_percentiles(df, "x", probs, partitions=7)
    assert got == pytest.approx(list(np.percentile(vals, [p * 100 for p in probs])))


def test_exact_percentiles_empty(spark):
    df = spark.createDataFrame([], "x double")
    assert exact_percentiles(df, "x", [0.5]) == [None]


def test_iqr_outliers_strict_bounds(spark):
    df = spark.createDataFrame([(f"k{i}", float(v)) for i, v in enumerate([1, 2, 3, 4, 100, -50])],
                               "uniqueid string, engagement_score double")
    got = sorted(r["uniqueid"] for r in A.iqr_outliers(df).collect())
    q1, q3 = np.percentile([1, 2, 3, 4, 100, -50], [25, 75])
    exp = sorted(f"k{i}" for i, v in enumerate([1, 2, 3, 4, 100, -50]) if v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))
    assert got == exp


def test_histogram_max_lands_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 10]], "x double")
    got = {r["bin"]: r["n"] for r in A.equal_width_histogram(df, "x", 5).collect()}
    assert got == {1: 2, 2: 1, 5: 1}


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r["bin"], r["n"]) for r in A.equal_width_histogram(df, "x", 50).collect()] == [(1, 2)]


def test_feature_importance_constant_feature_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 7.0)], "a double, b double, engagement_score double")
    got = {r["feature"]: r["importance"] for r in A.feature_importance(df, cols=("a", "b")).collect()}
    assert got["a"] == 1.0 and got["b"] is None


def test_pipeline_status_counts(spark, edge_posts):
    r = A.pipeline_status(edge_posts).first()
    assert (r["total"], r["unprocessed"], r["completed"], r["skipped"], r["error"]) == (8, 2, 4, 1, 1)
    assert r["missing_topics"] == 2 and r["missing_features"] == 2


def test_posts_to_process_keeps_null_status(spark, edge_posts):
    got = sorted(r["uniqueid"] for r in S.posts_to_process(edge_posts, None).collect())
    assert got == ["test3", "test4"]


def test_recent_posts_rejects_negative_limit(spark, sample_posts):
    with pytest.raises(ValueError):
        S.recent_posts(sample_posts, -1)
    assert [r["uniqueid"] for r in S.recent_posts(sample_posts, 2).collect()] == ["test1", "test2"]


def test_best_index_first_on_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0],), ([0.5, 0.1],)], "s array<double>")
    assert [r[0] for r in df.select(S.best_index(F.col("s"))).collect()] == [1, 0, 0]


def test_cluster_top_tags_k_per_cluster(spark, edge_posts):
    from wren.operators.enrich import with_tags
    df = with_tags(edge_posts).withColumn("cluster", F.lit(0))
    rows = A.cluster_top_tags(df, k=5).collect()
    assert {(r["kind"], r["tag"]) for r in rows} == {("hashtag", "ai"), ("hashtag", "été"), ("mention", "bob"),
                                                     ("mention", "carl")}
