"""Rewrite-and-rank rounds over whole tables of posts.

The reference optimizes one text per request in a Python loop.  Here one
round handles every post at once: candidates are generated per row
(``posexplode``), scored by a Spark ML model, and the best candidate per post
is chosen with ``max_by`` (a group holds one post's candidates, at most
``n_variations`` rows).  The driver loops over *rounds only* (at most 10);
each round's result is checkpointed to the shared checkpoint folder, so the
plan does not grow with the number of rounds and a lost executor only
recomputes the current round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ensure_checkpoint_dir
from .feedback import epsilon_greedy

Scorer = Callable[[DataFrame], DataFrame]  # adds ``score`` for column ``text``


def fallback_candidates(seed: Column, n: int) -> Column:
    """Candidates when no generator is configured: the reference's fixed
    rewrites of the seed (S19 error path)."""
    return T.error_variations(seed, n)


def optimize_posts(seeds: DataFrame, scorer: Scorer, n_iterations: int = 3, n_variations: int = 5,
                   generator: Callable[[DataFrame], DataFrame] | None = None, epsilon: float = 0.0,
                   key: str = "uniqueid") -> DataFrame:
    """History rows ``(key, iteration, tweet, predicted_engagement, variations,
    selected_idx, is_exploration)`` for every seed post and round."""
    if not 1 <= n_iterations <= 10:
        raise ValueError("n_iterations must be within 1..10")
    spark = seeds.sparkSession
    ensure_checkpoint_dir(spark)
    current = scorer(seeds.select(key, "text")).select(key, "text", F.col("score"))
    history = current.select(key, F.lit(0).alias("iteration"), F.col("text").alias("tweet"),
                             F.col("score").alias("predicted_engagement"),
                             F.array().cast("array<string>").alias("variations"),
                             F.lit(None).cast("int").alias("selected_idx"), F.lit(False).alias("is_exploration"))
    rounds = [history.checkpoint(eager=True)]
    current = current.select(key, "text").checkpoint(eager=True)
    for i in range(1, n_iterations + 1):
        if generator is not None:
            cands = generator(current).select(key, "text", T.pad_variations(
                F.col("candidates"), F.col("text"), n_variations).alias("variations"))
        else:
            cands = current.select(key, "text", fallback_candidates(F.col("text"), n_variations).alias("variations"))
        flat = cands.select(key, F.posexplode("variations").alias("idx", "text"))
        scored = scorer(flat)
        per = scored.groupBy(key).agg(
            F.sort_array(F.collect_list(F.struct("idx", "text", "score"))).alias("_c"),
            F.max_by("idx", F.struct("score", (-F.col("idx")).alias("ni"))).alias("best_idx"))
        chosen = epsilon_greedy(per, F.col(key), F.lit(i), F.size("_c"), F.col("best_idx"), epsilon)
        pick = F.element_at("_c", F.col("selected_idx") + 1)
        rec = chosen.select(key, F.lit(i).alias("iteration"), pick.getField("text").alias("tweet"),
                            pick.getField("score").alias("predicted_engagement"),
                            F.transform("_c", lambda c: c.getField("text")).alias("variations"),
                            F.col("selected_idx").cast("int").alias("selected_idx"), "is_exploration")
        rec = rec.checkpoint(eager=True)
        rounds.append(rec)
        current = rec.select(key, F.col("tweet").alias("text"))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def optimization_records(history: DataFrame, key: str = "uniqueid") -> DataFrame:
    """Per post: seed, result, score before and after, improvement %."""
    g = history.groupBy(key).agg(
        F.min_by("tweet", "iteration").alias("original_text"), F.max_by("tweet", "iteration").alias("optimized_text"),
        F.min_by("predicted_engagement", "iteration").alias("original_engagement"),
        F.max_by("predicted_engagement", "iteration").alias("optimized_engagement"))
    o, n = F.col("original_engagement"), F.col("optimized_engagement")
    return g.withColumn("improvement", F.when(o > 0, (n / o - 1) * 100).otherwise(F.lit(0.0)))


def simulate_training(posts: DataFrame, scorer: Scorer | None, episodes: int, batch_size: int,
                      n_iterations: int = 3, n_variations: int = 5, key: str = "uniqueid",
                      rounds: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Episodes of sampled posts, reward = improvement.

    Every post is optimized, once and in the same rounds as all others: the candidates
    are deterministic, so a post drawn in several episodes has one improvement.  Episodes
    draw keys only.  ``rounds`` makes the history of the seeds instead of ``optimize_posts``."""
    from .selection import episode_sample
    sample = episode_sample(posts.select(key), key, episodes, batch_size)
    seeds = posts.select(key, "text").distinct()
    hist = rounds(seeds) if rounds else optimize_posts(seeds, scorer, n_iterations, n_variations, key=key)
    rec = optimization_records(hist, key).select(
        key, F.when(F.col("original_engagement") != 0,
                    (F.col("optimized_engagement") - F.col("original_engagement"))
                    / F.col("original_engagement") * 100).otherwise(F.lit(0.0)).alias("improvement"))
    return sample.select("episode", key).join(rec, key)
