"""Quality classifier with hierarchical empirical Bayes (operator 7).

A document's own evidence comes from two logistic models, for low quality and
for toxicity, over its format and over words and word beginnings that are
strongly tied to a label.  They are fitted on a bounded sample of labelled
documents.  The evidence of all documents is then summed by site: the share of
bad documents of a host is shrunk towards the global share, that of a path of
the host towards the host, the more so the fewer documents there are, with
strengths estimated from the spread between sites.  A document's probability is
its own evidence with the prior of its path, itself left out, in place of the
global one.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import broadcast_if_small, map_text

#: Labelled documents that the models are fitted on at most.
SAMPLE_DOCS = 20_000
#: A word (or beginning) is telling with this many labelled documents, this share of them bad, and this z-score; the most kept for a label.
MIN_DOCS, MIN_PRECISION, MIN_Z, MAX_WORDS = 5, 0.9, 3.0, 5000
#: Examples of each class below which no model is fitted for a label.
MIN_EXAMPLES = 10
#: The prior of a site moves a document's log-odds by at most this much.
MAX_SHIFT = 2.0
#: Sites that are broadcast at most; beyond that Spark joins by shuffle.
MAX_BROADCAST_SITES = 200_000

WORD = re.compile(r"[^\W\d_]+")
LABELS = ("low", "toxic")


def units(words: set[str]) -> set[str]:
    """Words, and beginnings of four letters (marked ``^``)."""
    return words | {"^" + w[:4] for w in words if len(w) > 4}


def format_features(text: str, words: list[str]) -> list[float]:
    n = max(1, len(words))
    letters = max(1, sum(map(len, words)))
    again = sum(a == b for a, b in zip(words, words[1:]))
    upper = sum(1 for w in words if w.isupper())
    return [
        min(1.0, sum(map(text.count, "#*$%&<>")) / n), min(1.0, text.count("|") / n), min(1.0, text.count("!") / n),
        upper / n, again / n, min(1.0, sum(map(text.count, "0123456789")) / letters),
        1 - len(set(words)) / n if n <= 200 else 1 - min(1.0, len(set(words)) / (n ** 0.9)), math.log1p(len(words)) / 10,
    ]


@dataclass
class Model:
    """Telling words of each label and the coefficients (bias last) of its logistic model, None where nothing could be fitted."""

    telling: dict[str, frozenset] = field(default_factory=dict)
    weights: dict[str, list[float] | None] = field(default_factory=dict)

    def features(self, text: str) -> list[float]:
        words = WORD.findall(text)
        own = units({w.lower() for w in words})
        hits = [len(own & self.telling.get(k, frozenset())) for k in LABELS]
        return [*format_features(text, words), *[x for h in hits for x in (float(h > 0), math.log1p(h))]]

    def probability(self, text: str | None) -> float:
        """Of being bad (low quality or toxic), from the document alone."""
        x = self.features(text or "")
        good = 1.0
        for k in LABELS:
            w = self.weights.get(k)
            if w is not None:
                z = w[-1] + sum(a * b for a, b in zip(w, x))
                good *= 1 / (1 + math.exp(max(-30.0, min(30.0, z))))
        return 1 - good


def _telling_words(sample: DataFrame) -> dict[str, frozenset]:
    """From ``(text, low, toxic)``: the telling words of each label, by document counts in a grouped aggregation."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [(u, low, tox) for t, low, tox in zip(*(c.to_pylist() for c in part.columns))
                        for u in units({w.lower() for w in WORD.findall(t or "")})]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array([r[2] for r in rows], pa.int64())], names=["unit", "low", "toxic"])

    found = sample.select("text", "low", "toxic").mapInArrow(run, "unit string, low long, toxic long")
    sums = found.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic"))
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()
    out = {}
    for k in LABELS:
        bad, total = size[k] or 0, size["n"] or 0
        a, b = F.col(k), F.col("n") - F.col(k)
        llr = F.log((a + 0.5) / (bad + 1.0)) - F.log((b + 0.5) / (total - bad + 1.0))
        z = llr / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        top = sums.where((a >= MIN_DOCS) & (a >= MIN_PRECISION * F.col("n")) & (z >= MIN_Z)).orderBy(
            z.desc(), "unit").limit(MAX_WORDS).select("unit").collect()
        out[k] = frozenset(r["unit"] for r in top)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """``(id, text, low, toxic)`` of the labelled documents whose ids hash lowest, ``limit`` at most."""
    marks = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 0).cast("long").alias("low"),
                          (F.col("toxic") == 1).cast("long").alias("toxic")).where("id IS NOT NULL")
    marks = marks.groupBy("id").agg(F.coalesce(F.max("low"), F.lit(0)).alias("low"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    there = docs.select("id").where("id IS NOT NULL").distinct().join(marks, "id").orderBy(F.xxhash64("id"), "id").limit(limit)
    # limit rows at most; copies of a text count once, or a copied document would make all its words telling
    return docs.select("id", "text").join(F.broadcast(there), "id").dropDuplicates(["text"])


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              limit: int = SAMPLE_DOCS) -> Model:
    """The model fitted on at most ``limit`` labelled documents; without labels it rejects nothing."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = labelled_sample(read, labels, limit).persist()
    try:
        model = Model(_telling_words(sample))
        shared = docs.sparkSession.sparkContext.broadcast(model)
        schema = T.StructType([T.StructField("f", T.ArrayType(T.DoubleType()))])
        rows = map_text(sample, "text", lambda texts: [{"f": shared.value.features(t or "")} for t in texts], schema)
        rows = rows.select("low", "toxic", array_to_vector("f").alias("features")).persist()
        try:
            for k in LABELS:
                counts = {r[k]: r["count"] for r in rows.groupBy(k).count().collect()}
                model.weights[k] = None
                if min(counts.get(0, 0), counts.get(1, 0)) >= MIN_EXAMPLES:
                    fit = LogisticRegression(featuresCol="features", labelCol=k, regParam=1e-5, maxIter=100).fit(rows)
                    model.weights[k] = [*map(float, fit.coefficients), float(fit.intercept)]
        finally:
            rows.unpersist()
    finally:
        sample.unpersist()
    return Model(model.telling, model.weights)


def _strength(mean: float, between: float) -> float:
    """Pseudo-documents of a prior of this mean whose sites vary by ``between``."""
    return min(1e6, max(1.0, mean * (1 - mean) / max(between, 1e-9) - 1))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """From ``(host, path, p)``: ``(host, path, n, s, host_share)``, the global share and the strength of a path's prior.

    Shares of bad documents by host, shrunk towards the global one.  The spread
    between sites is the variance of their means beyond what chance gives;
    sites are aggregated first, so a hot host is one row per task.
    """
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")).persist()
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    n, mean = total["n"] or 0, 0.0
    if n:
        mean = min(1 - 1e-6, max(1e-6, total["s"] / n))

    def spread(sites: DataFrame, around) -> float:
        var = sites.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - around, 2)).alias("v"),
                        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
        return max(0.0, (var["v"] or 0.0) - var["k"] * mean * (1 - mean)) / max(1, var["n"] or 0)

    k_host = _strength(mean, spread(hosts, F.lit(mean)))
    shares = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_share"))
    joined = paths.join(shares.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _strength(mean, spread(joined, F.col("host_share")))
    return joined, mean, k_path


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id",
             text_col: str = "text", limit: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` plus ``p_own`` (evidence of the text), ``p_site`` (prior of its path), ``p_bad`` and ``rejected``.

    Null texts count as empty; null hosts and paths are sites of their own;
    repeated rows are judged each; without labels nothing is rejected.  Columns
    whose names clash with the results give way.
    """
    names = ("p_own", "p_site", "p_bad", "rejected")
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, id_col, text_col, limit))
    added = T.StructType([T.StructField("p_own", T.DoubleType())])
    base = docs.drop(*names)
    scored = map_text(base, text_col, lambda texts: [{"p_own": model.value.probability(t)} for t in texts], added)
    sites, mean, k_path = site_posteriors(scored.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col("p_own").alias("p")))
    own = F.col("d.p_own")
    sites = broadcast_if_small(sites, MAX_BROADCAST_SITES).alias("s")
    joined = scored.alias("d").join(sites, F.col(f"d.{host_col}").eqNullSafe(F.col("s.host")) & F.col(f"d.{path_col}").eqNullSafe(F.col("s.path")))
    prior = (F.col("s.s") - own + k_path * F.col("s.host_share")) / (F.col("s.n") - 1 + k_path)
    prior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), prior))
    logit = lambda p: F.log(p / (1 - p))
    shift = F.greatest(F.lit(-MAX_SHIFT), F.least(F.lit(MAX_SHIFT), logit(prior) - (math.log(mean / (1 - mean)) if mean else 0.0)))
    safe = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), own))
    p_bad = 1 / (1 + F.exp(-(logit(safe) + shift)))
    return joined.select(*[F.col(f"d.`{c}`") for c in base.columns], own.alias("p_own"), prior.alias("p_site"), p_bad.alias("p_bad"),
                         (p_bad > 0.5).alias("rejected"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text", "lang", "source"), labels).select("doc_id", "p_own", "p_site", "p_bad", "rejected")
