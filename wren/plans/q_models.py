"""Model jobs as named queries.

These have no exact SQL oracle (trees, k-means and boosting are not
bit-comparable across libraries); the checks are rows-only plus the property
tests in ``tests/test_models.py``.  Label-only metrics on given labels (D38-D40)
do have SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as LX
from ..operators import ml as ML
from ..operators import optimize as OPT
from ..operators.aggregates import cluster_stats, cluster_top_tags, rnd
from ..operators.appended import optimize_appended
from ..operators.enrich import with_tags
from ..operators.feedback import episode_summary
from ..operators.landing import upsert, write_results
from ..operators.model_store import ModelStore
from ..session import scratch_path, stored
from ..sources import fixtures as FX
from .catalog import register
from .views_sql import with_views as V


def model_posts(spark: SparkSession, sf: str) -> DataFrame:
    from .q_posts import scored
    return LX.with_processed_text(scored(spark, sf))


class EngagementModel:
    """Text features + lexicon sentiment + topic indicators -> scaled GBT (M6, M8)."""

    def __init__(self, spark: SparkSession, max_iter: int = 100):
        self.spark = spark
        self.max_iter = max_iter
        self.lexicon = LX.lexicon_table(spark)
        self.topic_words = LX.topic_words_table(spark)

    def _features(self, df: DataFrame, key: str) -> DataFrame:
        sent = LX.sentiment(df, self.lexicon, key, "text")
        feats = ML.numeric_features(df.select(key, "text", *[c for c in df.columns if c not in (key, "text")]))
        feats = feats.drop("sentiment", "subjectivity").join(sent, key, "left")
        topics = LX.extract_topics(df.select(key, "text"), self.topic_words, key, "text")
        return feats.join(topics, key, "left")

    def fit(self, train: DataFrame, key: str = "uniqueid", label: str = "engagement_score") -> "EngagementModel":
        f = self._features(train.select(key, "text", label), key)
        f = stored(f.select(key, label, *ML.NUMERIC_FEATURES, "topics_list"), "features")  # the fit reads them many times
        self.cv = LX.fit_topic_one_hot(f)
        self.model = ML.train_regressor(self.cv.transform(f), label, "topic_vec", max_iter=self.max_iter)
        return self

    def save(self, store: ModelStore) -> str:
        """Encoder, regressor and word tables under one run id."""
        return store.save({"topic_encoder": self.cv, "regressor": self.model},
                          {"lexicon": self.lexicon, "topic_words": self.topic_words})

    @classmethod
    def load(cls, store: ModelStore, run_id: str | None = None) -> "EngagementModel":
        run, em = store.load(run_id), cls(store.spark)
        em.cv, em.model = run.models["topic_encoder"], run.models["regressor"]
        em.lexicon, em.topic_words = run.tables["lexicon"], run.tables["topic_words"]
        return em

    def score(self, df: DataFrame, key: str = "uniqueid") -> DataFrame:
        return self.predict(self._features(df, key))

    def predict(self, features: DataFrame) -> DataFrame:
        return ML.predict(self.model, self.cv.transform(features))


def _trained(spark, sf, max_iter=100):
    p = stored(model_posts(spark, sf).select("uniqueid", "text", "engagement_score"), "posts")
    train = p.filter(ML.split_flag(F.col("uniqueid")))
    return p, EngagementModel(spark, max_iter).fit(train)


@register("tfidf_features", "M1 S11")
def q_tfidf_features(spark, sf):
    out, _ = ML.tfidf(model_posts(spark, sf).select("uniqueid", "processed_text"))
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("tfidf")
    return out.select("uniqueid", F.size(F.filter(arr, lambda x: x != 0)).alias("n_terms"),
                      rnd(F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x))).alias("l2_norm"))


@register("cluster_posts", "M2 M1")
def q_cluster_posts(spark, sf):
    feats, _ = ML.tfidf(model_posts(spark, sf).select("uniqueid", "processed_text"))
    clustered, _ = ML.cluster_posts(feats, 5)
    return clustered.select("uniqueid", "cluster")


@register("train_test_split", "M3", V("""
SELECT uniqueid, ('0x' || substr(md5(uniqueid || ':42'), 1, 8))::BIGINT % 100 < 80 AS is_train FROM posts""", "posts"))
def q_train_test_split(spark, sf):
    return FX.posts(spark, sf).select("uniqueid", ML.split_flag(F.col("uniqueid")).alias("is_train"))


@register("median_label", "D38", V("""
SELECT uniqueid, cast(engagement_eda > (SELECT quantile_cont(engagement_eda, 0.5) FROM sposts) AS INTEGER) AS label
FROM sposts""", "sposts"))
def q_median_label(spark, sf):
    from .q_posts import scored
    return ML.median_label(scored(spark, sf), "engagement_eda").select("uniqueid", "label")


_GIVEN = "SELECT doc_id % 2 AS actual, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS predicted FROM posts"


def _given_labels(spark, sf):
    p = FX.posts(spark, sf)
    return p.select((F.col("doc_id") % 2).cast("int").alias("label"),
                    F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("prediction"))


@register("confusion_matrix", "D39", V(f"""
SELECT actual, predicted, count(*) AS n FROM ({_GIVEN}) GROUP BY 1, 2""", "posts"))
def q_confusion_matrix(spark, sf):
    return ML.confusion_matrix(_given_labels(spark, sf))


@register("classification_report", "D40", V(f"""
WITH cm AS (SELECT actual, predicted, count(*) AS n FROM ({_GIVEN}) GROUP BY 1, 2),
cls AS (SELECT actual AS c FROM cm UNION SELECT predicted FROM cm),
per AS (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE actual = c), 0) AS support,
          coalesce((SELECT sum(n) FROM cm WHERE predicted = c), 0) AS pn,
          coalesce((SELECT sum(n) FROM cm WHERE actual = c AND predicted = c), 0) AS tp FROM cls),
m AS (SELECT c, CASE WHEN pn = 0 THEN 0.0 ELSE tp / pn END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r,
        support, tp FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m),
t AS (SELECT sum(support) AS total, sum(tp) AS correct FROM f)
SELECT cast(c AS VARCHAR) AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1,
  cast(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', round(correct / total, 6), round(correct / total, 6), round(correct / total, 6),
  cast(total AS BIGINT) FROM t
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), cast(any_value(total) AS BIGINT)
  FROM f, t
UNION ALL SELECT 'weighted avg', round(sum(p * support) / any_value(total), 6), round(sum(r * support) / any_value(total), 6),
  round(sum(f1 * support) / any_value(total), 6), cast(any_value(total) AS BIGINT) FROM f, t""", "posts")
          .replace("\nWITH cm AS", ",\ncm AS", 1))
def q_classification_report(spark, sf):
    return ML.classification_report(ML.confusion_matrix(_given_labels(spark, sf)))


def _classifier(spark, sf):
    p = ML.median_label(model_posts(spark, sf), "engagement_eda").select("uniqueid", "processed_text", "label")
    # vocabulary and weights come from the training part alone
    feats, pipe = ML.tfidf(p, train=ML.split_flag(F.col("uniqueid")))
    train = feats.filter(ML.split_flag(F.col("uniqueid")))
    test = feats.filter(~ML.split_flag(F.col("uniqueid")))
    store = ModelStore(spark, scratch_path(spark, "models/classifier"))
    run = store.load(store.save({"vectorizer": pipe, "classifier": ML.train_classifier(train, "tfidf", "label")}))
    return run.models["classifier"], run.models["vectorizer"], run.models["classifier"].transform(test)


@register("engagement_classifier", "M4 M3 M13 D39 D40")
def q_engagement_classifier(spark, sf):
    _, _, pred = _classifier(spark, sf)
    return ML.classification_report(ML.confusion_matrix(pred, "label", "prediction"))


@register("classifier_importance", "M5")
def q_classifier_importance(spark, sf):
    model, pipe, _ = _classifier(spark, sf)
    vocab = [s for s in pipe.stages if hasattr(s, "vocabulary")][0].vocabulary
    return ML.classifier_importance(model, vocab, spark)


@register("engagement_regressor", "M6 M8 M13 C9 S20")
def q_engagement_regressor(spark, sf):
    p, em = _trained(spark, sf)
    store = ModelStore(spark, scratch_path(spark, "models/engagement"))
    em = EngagementModel.load(store, em.save(store))
    test = p.filter(~ML.split_flag(F.col("uniqueid"))).select("uniqueid", "text", "engagement_score")
    return em.score(test).select("uniqueid", "engagement_score", rnd(F.col("predicted_engagement"))
                                 .alias("predicted_engagement"))


@register("optimize_posts", "M9 M10 M8 S19 S25")
def q_optimize_posts(spark, sf):
    """Fixed rewrites scored from the counts of their seeds; every seed is tokenised once."""
    p, em = _trained(spark, sf)
    hist = optimize_appended(p.select("uniqueid", "text"), em.predict, em.lexicon, em.topic_words, n_iterations=3,
                             n_variations=5, epsilon=0.1)
    return OPT.optimization_records(hist).select("uniqueid", rnd(F.col("improvement")).alias("improvement"),
                                                 F.md5("optimized_text").alias("optimized_md5"))


#: The reference's episodes, and the share of its table that each draws: 50 of 1,000 posts.
EPISODES, DRAWN, OF = 100, 50, 1000


@register("simulate_training", "M12")
def q_simulate_training(spark, sf):
    """Every post is optimized; an episode draws as large a share of the table as the reference's."""
    p, em = _trained(spark, sf)
    batch_size = max(DRAWN, -(-p.count() * DRAWN // OF))
    rows = OPT.simulate_training(p, None, EPISODES, batch_size, rounds=lambda seeds: optimize_appended(
        seeds, em.predict, em.lexicon, em.topic_words, n_iterations=3, n_variations=5))
    return episode_summary(rows)


@register("cluster_pipeline", "M15 A12 A13 D23 D24 S6 S11 S12")
def q_cluster_pipeline(spark, sf):
    p = with_tags(model_posts(spark, sf))
    feats, _ = ML.tfidf(p.drop("text"))
    clustered, _ = ML.cluster_posts(feats, 5)
    labels = clustered.select("uniqueid", "processed_text", F.col("engagement_eda").alias("engagement_score"),
                              "cluster").checkpoint(eager=True)
    snap, _ = upsert(FX.posts(spark, sf), labels, ["processed_text", "engagement_score", "cluster"])
    write_results(cluster_top_tags(clustered), scratch_path(spark, "results/cluster_top_tags"), "json")
    write_results(snap.select("uniqueid", "cluster"), scratch_path(spark, "results/post_clusters"), "parquet")
    return cluster_stats(labels.withColumnRenamed("engagement_score", "engagement_eda"), "cluster", "engagement_eda")
