"""User hooks for per-text services (U1 topics, U2 rewrite candidates).

The reference calls a remote language model once per row.  Here a user
callable ``list[str] -> list[list[str]]`` is invoked once per Arrow batch
inside ``mapInPandas`` (so a batch of texts goes out per call), only on the
*distinct* texts (the expensive step never repeats for a repeated text), with
bounded retries and growing delays; a batch that still fails is halved until
the failing texts stand alone, which yield the fallback (empty list) and are
marked in a ``*_failed`` column.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TextFn = Callable[[list[str]], list[list[str]]]


def _call_with_retries(fn: TextFn, texts: list[str], retries: int, delay_s: float) -> list[tuple[list[str], bool]]:
    """``(result, failed)`` per text.  A batch that fails all its tries is halved
    down to single texts, so a text that the service cannot take costs itself only."""
    for attempt in range(retries):
        try:
            out = fn(texts)
            if len(out) != len(texts):
                raise ValueError("hook returned a different number of results")
            return [(list(x) if x is not None else [], False) for x in out]
        except Exception:  # noqa: BLE001 - any failure of the user service
            if attempt < retries - 1 and delay_s > 0:
                time.sleep(delay_s * (attempt + 1))
    if len(texts) == 1:
        return [([], True)]
    half = len(texts) // 2
    return [r for part in (texts[:half], texts[half:]) for r in _call_with_retries(fn, part, retries, delay_s)]


def _key(text) -> Column:
    return F.sha2(text, 256)


def map_texts(df: DataFrame, fn: TextFn, text: str = "text", out: str = "result",
              retries: int = 3, delay_s: float = 0.0) -> DataFrame:
    """``(text_key, out array<string>, out_failed)`` for the distinct texts of ``df``; ``text_key`` is their SHA-256."""
    distinct = df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    keyed = distinct.select(_key("text").alias("text_key"), "text")

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            res = _call_with_retries(fn, texts, retries, delay_s) if texts else []
            yield pd.DataFrame({"text_key": pdf["text_key"], out: [r for r, _ in res], f"{out}_failed": [f for _, f in res]})

    return keyed.mapInPandas(run, f"text_key string, {out} array<string>, {out}_failed boolean")


def _joined(df: DataFrame, found: DataFrame, text: str, out: str) -> DataFrame:
    """Results on every row, matched by the digest of its text; none for a null text."""
    empty = F.array().cast("array<string>")
    rows = df.withColumn("text_key", _key(F.col(text))).join(found, "text_key", "left").drop("text_key")
    return rows.withColumn(out, F.coalesce(out, empty)).withColumn(f"{out}_failed", F.coalesce(f"{out}_failed", F.lit(False)))


def map_topics(df: DataFrame, fn: TextFn, text: str = "text", retries: int = 3, delay_s: float = 0.0) -> DataFrame:
    """Topics per text from a user service, joined back to every row; empty for null texts and failed calls."""
    return _joined(df, map_texts(df, fn, text, "topics_list", retries, delay_s), text, "topics_list")


def map_candidates(df: DataFrame, fn: TextFn, text: str = "text", retries: int = 3,
                   delay_s: float = 0.0) -> DataFrame:
    """Rewrite candidates per text; empty results fall back to the padding rule."""
    return _joined(df, map_texts(df, fn, text, "candidates", retries, delay_s), text, "candidates")
