"""Model jobs: properties that hold whatever the library (no bit-equality)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wren.operators import ml as ML
from wren.operators.lexicon import with_processed_text
from wren.sources import fixtures as FX

from .conftest import SF001


@pytest.fixture(scope="module")
def prepared(spark):
    from wren.plans.q_posts import scored
    return with_processed_text(scored(spark, SF001)).cache()


def test_tfidf_rows_are_unit_length(spark, prepared):
    out, model = ML.tfidf(prepared, max_features=200)
    from pyspark.ml.functions import vector_to_array
    norms = out.select(F.aggregate(vector_to_array("tfidf"), F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert all(abs(r["n"] - 1.0) < 1e-9 or r["n"] == 0.0 for r in norms)
    vocab = [s for s in model.stages if hasattr(s, "vocabulary")][0].vocabulary
    assert len(vocab) <= 200 and any(" " in t for t in vocab)  # bigrams present


def test_kmeans_labels_and_determinism(spark, prepared):
    feats, _ = ML.tfidf(prepared, max_features=200)
    a, _ = ML.cluster_posts(feats, 5)
    b, _ = ML.cluster_posts(feats, 5)
    la = {r["uniqueid"]: r["cluster"] for r in a.select("uniqueid", "cluster").collect()}
    lb = {r["uniqueid"]: r["cluster"] for r in b.select("uniqueid", "cluster").collect()}
    assert la == lb and set(la.values()) <= set(range(5)) and len(la) == prepared.count()


def test_split_is_stable_under_repartitioning(spark):
    p = FX.posts(spark, SF001).select("uniqueid")
    a = {r[0]: r[1] for r in p.select("uniqueid", ML.split_flag(F.col("uniqueid"))).collect()}
    b = {r[0]: r[1] for r in p.repartition(7).select("uniqueid", ML.split_flag(F.col("uniqueid"))).collect()}
    assert a == b and 0.7 < sum(a.values()) / len(a) < 0.9


def test_regressor_beats_mean_predictor(spark):
    data = ML.synthetic_features(spark, 600)
    model = ML.train_regressor(data, "engagement_score", max_iter=20)
    pred = ML.predict(model, data)
    mean = data.agg(F.avg("engagement_score")).first()[0]
    err = pred.agg(F.avg(F.abs(F.col("predicted_engagement") - F.col("engagement_score")))).first()[0]
    base = data.agg(F.avg(F.abs(F.col("engagement_score") - F.lit(mean)))).first()[0]
    assert err < base


def test_model_store_roundtrip(spark, tmp_path):
    data = ML.synthetic_features(spark, 200)
    model = ML.train_regressor(data, "engagement_score", max_iter=5)
    path = ML.save_model(model, str(tmp_path / "m"))
    again = ML.load_model(path)
    a = ML.predict(model, data).select("predicted_engagement").collect()
    b = ML.predict(again, data).select("predicted_engagement").collect()
    assert a == b


def test_a_run_is_stored_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """Vectorizer, classifier, regressor, encoder and word tables under one run id predict as before."""
    from pyspark.ml import PipelineModel

    from wren.operators import lexicon as LX
    from wren.operators.model_store import ModelStore

    texts = spark.createDataFrame([(k, f"word{k % 3} more words of {k % 7}", k % 2, ["a", "b"][: k % 3]) for k in range(60)],
                                  "id long, processed_text string, label int, topics_list array<string>")
    feats, vectorizer = ML.tfidf(texts, max_features=50)
    classifier = ML.train_classifier(feats, "tfidf", "label", num_trees=5, max_depth=3)
    data = ML.synthetic_features(spark, 200)
    regressor = ML.train_regressor(data, "engagement_score", max_iter=3)
    encoder = LX.fit_topic_one_hot(texts)
    models = {"vectorizer": vectorizer, "classifier": classifier, "regressor": regressor, "encoder": encoder}
    store = ModelStore(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.load()
    first = store.save(models, {"lexicon": LX.lexicon_table(spark)})
    run = store.load()
    assert run.run_id == first and set(run.models) == set(models)
    predict = lambda vec, cls: cls.transform(vec.transform(texts)).select("id", "prediction", "probability").collect()
    assert sorted(predict(run.models["vectorizer"], run.models["classifier"])) == sorted(predict(vectorizer, classifier))
    assert ML.predict(run.models["regressor"], data).select("predicted_engagement").collect() == \
        ML.predict(regressor, data).select("predicted_engagement").collect()
    assert run.models["encoder"].transform(texts).collect() == encoder.transform(texts).collect()
    assert sorted(run.tables["lexicon"].collect()) == sorted(LX.lexicon_table(spark).collect())
    # a run that breaks before its manifest is never seen, and its id may be used again
    with pytest.raises(ZeroDivisionError):
        with monkeypatch.context() as m:
            m.setattr(ModelStore, "_publish", lambda *a: 1 / 0)
            store.save({"encoder": encoder}, run_id="second")
    assert store.runs() == [first] and store.load().run_id == first
    store.save({"encoder": encoder}, run_id="second")
    assert store.runs() == [first, "second"] and store.load().run_id == "second" and store.load(first).run_id == first
    with pytest.raises(ValueError):
        store.save({"encoder": encoder}, run_id="second")
    assert isinstance(store.load(first).models["regressor"], PipelineModel)


def test_topic_vocabulary_by_count_then_name(spark):
    from wren.operators import lexicon as LX

    rows = [(1, ["b", "a"]), (2, ["c", "b"]), (3, ["a"]), (4, None), (5, []), (6, ["d"])]
    df = spark.createDataFrame(rows, "id long, topics_list array<string>")
    for parts in (1, 3, 6):
        out, model = LX.topic_one_hot(df.repartition(parts), vocab_size=3)
        assert model.vocabulary == ["a", "b", "c"]  # c before d by name
        assert {r["id"]: list(r["topic_vec"].toArray()) for r in out.filter("topics_list IS NOT NULL").collect()} == {
            1: [1, 1, 0], 2: [0, 1, 1], 3: [1, 0, 0], 5: [0, 0, 0], 6: [0, 0, 0]}


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1)], "label int, prediction int")
    rows = {r["label"]: r for r in ML.classification_report(ML.confusion_matrix(df)).collect()}
    assert rows["0"]["precision"] == 0.0 and rows["0"]["recall"] == 0.0 and rows["0"]["support"] == 1
    assert rows["1"]["precision"] == pytest.approx(0.666667) and rows["1"]["recall"] == 1.0
    assert rows["accuracy"]["precision"] == pytest.approx(0.666667)


def test_training_takes_every_post_and_episodes_grow_with_the_table(spark, monkeypatch):
    from wren.operators import selection as S
    from wren.plans import q_models as Q

    p = spark.createDataFrame([(f"p{k}", f"text {k}" + "!" * (k % 4)) for k in range(2040)], "uniqueid string, text string")
    fitted, taken, rounds = [], [], Q.optimize_appended

    class Fitted:
        lexicon, topic_words = Q.LX.lexicon_table(spark), Q.LX.topic_words_table(spark)

        @staticmethod
        def predict(df):
            return df.withColumn("predicted_engagement", F.col("text_length") * 1.0)

    monkeypatch.setattr(Q, "_trained", lambda spark, sf, max_iter=100: fitted.append(max_iter) or (p, Fitted()))
    monkeypatch.setattr(Q, "optimize_appended", lambda seeds, *a, **k: taken.append(seeds.count()) or rounds(seeds, *a, **k))
    got = Q.q_simulate_training(spark, "").collect()
    assert fitted == [100] and taken == [2040]
    assert sorted(r["episode"] for r in got) == list(range(1, 101)) and {r["n"] for r in got} == {102}
    # what is left out by the bound before the shuffle changes no draw
    cut = sorted(S.episode_sample(p, "uniqueid", 7, 102).select("episode", "uniqueid").collect())
    monkeypatch.setattr(S, "_digest_bound", lambda rows, n: None)
    assert cut == sorted(S.episode_sample(p, "uniqueid", 7, 102).select("episode", "uniqueid").collect())
    monkeypatch.setattr(S, "_digest_bound", lambda rows, n: "01")  # too few below it
    assert cut == sorted(S.episode_sample(p, "uniqueid", 7, 102).select("episode", "uniqueid").collect())
