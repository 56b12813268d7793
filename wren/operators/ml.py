"""Model jobs on tables with Spark ML.

Training and scoring are distributed Spark ML stages; nothing is collected
to the driver except fitted model parameters (vocabulary of at most 1,000
terms, k centres, tree ensembles), whose size is bounded by the parameters.
Random choices are seeded hashes of keys, so a re-run (or a task retry after
an executor loss) gives the same split, sample and exploration draws.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (IDF, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer,
                                SQLTransformer, StandardScaler, StopWordsRemover, VectorAssembler)
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import ENGLISH_STOP_WORDS
from ..session import ensure_checkpoint_dir
from .aggregates import rnd
from .quantiles import exact_percentiles

SEED = 42
NUMERIC_FEATURES = ("text_length", "word_count", "hashtag_count", "mention_count", "emoji_count",
                    "flesch_reading_ease", "sentiment", "subjectivity")


# M1 -------------------------------------------------------------------------
def tfidf(df: DataFrame, text: str = "processed_text", max_features: int = 1000,
          train: Column | None = None) -> tuple[DataFrame, PipelineModel]:
    """``df`` with its ``tfidf`` column and the fitted model; fitted on the rows where ``train`` holds, else on all.

    Uni- and bigrams of 2+ character word tokens without stop words, top
    ``max_features`` terms by corpus frequency, smoothed idf + 1 weighting and
    L2-normalised rows (the weighting of the reference's vectorizer).  The texts
    are cut into terms twice, for the vocabulary and for the counts of its terms,
    which are stored; weights and models read these.
    """
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    stop = StopWordsRemover(inputCol="_tok", outputCol="_uni", stopWords=list(ENGLISH_STOP_WORDS))
    bi = NGram(n=2, inputCol="_uni", outputCol="_bi")
    concat = SQLTransformer(statement="SELECT *, concat(_uni, _bi) AS _terms FROM __THIS__")
    chosen = (lambda rows: rows) if train is None else lambda rows: rows.filter(train)
    cut = Pipeline(stages=[tok, stop, bi, concat]).fit(df)
    # The vocabulary is picked by (count, term): CountVectorizer would break ties by the order of partitions.
    counts = cut.transform(chosen(df)).select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "term").limit(max_features).collect()  # max_features rows at most
    cv = CountVectorizerModel.from_vocabulary([r["term"] for r in top] or [""], inputCol="_terms", outputCol="_tf")
    # A checkpoint keeps partitions and their order, on which the seeded draws of clusters and trees depend.
    ensure_checkpoint_dir(df.sparkSession)
    tf = cv.transform(cut.transform(df)).drop("_tok", "_uni", "_bi", "_terms").checkpoint(eager=True)
    idf = IDF(inputCol="_tf", outputCol="_idf_unused").fit(chosen(tf))
    # Spark's idf is ln((n+1)/(df+1)); the reference adds 1 to it.
    scale = ElementwiseProduct(inputCol="_tf", outputCol="_tfidf",
                               scalingVec=DenseVector([w + 1.0 for w in idf.idf.toArray()]))
    norm = Normalizer(inputCol="_tfidf", outputCol="tfidf", p=2.0)
    out = norm.transform(scale.transform(tf)).drop("_tf", "_tfidf")
    return out, PipelineModel(stages=[*cut.stages, cv, scale, norm])


# M2 -------------------------------------------------------------------------
def cluster_posts(features: DataFrame, k: int = 5, features_col: str = "tfidf") -> tuple[DataFrame, object]:
    km = KMeans(k=k, seed=SEED, featuresCol=features_col, predictionCol="cluster")
    model = km.fit(features)
    return model.transform(features), model


# M3 -------------------------------------------------------------------------
def split_flag(key: Column, train_pct: int = 80, seed: int = SEED) -> Column:
    """Deterministic 80/20 split by a digest of key and seed (the same in any engine and partitioning)."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < train_pct


# D38 ------------------------------------------------------------------------
def median_label(df: DataFrame, score: str, name: str = "label") -> DataFrame:
    (median,) = exact_percentiles(df, score, [0.5])
    return df.withColumn(name, (F.col(score) > F.lit(median)).cast("int"))


# D39 / D40 ------------------------------------------------------------------
def confusion_matrix(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def classification_report(cm: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support, plus accuracy and macro /
    weighted averages, from a confusion matrix (zero division -> 0)."""
    per_actual = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    per_pred = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("predicted_n"))
    tp = cm.filter(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    classes = per_actual.select("cls").union(per_pred.select("cls")).distinct()
    m = (classes.join(per_actual, "cls", "left").join(per_pred, "cls", "left").join(tp, "cls", "left")
         .na.fill(0, ["support", "predicted_n", "tp"]))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    rows = m.select(F.col("cls").cast("string").alias("label"), prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"), F.col("support").cast("long").alias("support"), "tp")
    tot = rows.agg(F.sum("support").alias("total"), F.sum("tp").alias("correct"))
    summary = rows.crossJoin(F.broadcast(tot)).groupBy("total", "correct").agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"), F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    t = F.col("total")
    acc = F.coalesce(F.try_divide(F.col("correct").cast("double"), t), F.lit(0.0))
    extra = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 t.cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), t.cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.coalesce(F.try_divide(F.col("wp"), t), F.lit(0.0)).alias("precision"),
                 F.coalesce(F.try_divide(F.col("wr"), t), F.lit(0.0)).alias("recall"),
                 F.coalesce(F.try_divide(F.col("wf"), t), F.lit(0.0)).alias("f1"), t.cast("long").alias("support")),
    )).alias("r")).select("r.*")
    out = rows.drop("tp").unionByName(extra)
    return out.select("label", rnd(F.col("precision")).alias("precision"), rnd(F.col("recall")).alias("recall"),
                      rnd(F.col("f1")).alias("f1"), "support")


# M4 / M5 --------------------------------------------------------------------
def train_classifier(train: DataFrame, features_col: str = "tfidf", label: str = "label",
                     num_trees: int = 100, max_depth: int = 10):
    rf = RandomForestClassifier(featuresCol=features_col, labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                seed=SEED)
    return rf.fit(train)


def classifier_importance(model, vocabulary: list[str], spark: SparkSession) -> DataFrame:
    """Term -> importance, for every term of the vocabulary (whose size bounds the rows)."""
    imp = model.featureImportances.toArray()
    rows = sorted(((t, float(imp[i])) for i, t in enumerate(vocabulary)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(rows, "term string, importance double")


# M6 / M8 --------------------------------------------------------------------
def numeric_features(posts: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    """S1-S4 feature columns for any table with ``uniqueid`` and ``text``."""
    feats = T.text_features("text")
    out = posts.withColumns(feats)
    if sentiment is not None:
        out = out.drop("sentiment", "subjectivity").join(sentiment, "uniqueid", "left").na.fill(
            0.0, ["sentiment", "subjectivity"])
    else:
        out = out.withColumns({"sentiment": F.lit(0.0), "subjectivity": F.lit(0.0)})
    return out


def train_regressor(train: DataFrame, label: str = "engagement_score", extra_vector: str | None = None,
                    max_iter: int = 100, step: float = 0.1, depth: int = 5) -> PipelineModel:
    """Assemble (features added as 0 when missing, fixed order), scale, boosted trees."""
    cols = list(NUMERIC_FEATURES) + ([extra_vector] if extra_vector else [])
    prepared = train.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                                  for c in NUMERIC_FEATURES})
    asm = VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, stepSize=step, maxDepth=depth,
                       seed=SEED, predictionCol="predicted_engagement")
    return Pipeline(stages=[asm, scaler, gbt]).fit(prepared)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    prepared = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC_FEATURES})
    return model.transform(prepared).drop("_raw", "features")


# M7 -------------------------------------------------------------------------
def synthetic_features(spark: SparkSession, n: int = 1000, seed: int = SEED) -> DataFrame:
    """Random feature rows with a linear target plus noise (test helper only)."""
    r = spark.range(n)
    cols = {
        "text_length": (F.rand(seed) * 280).cast("int"), "word_count": (F.rand(seed + 1) * 50).cast("int"),
        "hashtag_count": (F.rand(seed + 2) * 5).cast("int"), "mention_count": (F.rand(seed + 3) * 3).cast("int"),
        "emoji_count": (F.rand(seed + 4) * 4).cast("int"), "flesch_reading_ease": F.rand(seed + 5) * 100,
        "sentiment": F.rand(seed + 6) * 2 - 1, "subjectivity": F.rand(seed + 7),
    }
    out = r.withColumns(cols)
    target = (F.col("text_length") * 0.1 + F.col("hashtag_count") * 5 + F.col("mention_count") * 3
              + F.col("emoji_count") * 2 + F.col("sentiment") * 10 + F.randn(seed + 8) * 5)
    return out.withColumn("engagement_score", target)


# M13 ------------------------------------------------------------------------
def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
