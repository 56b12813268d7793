"""Column enrichment of the post table: scores (S5-S10) and text features.

Pure projections: they add columns inside the scan's codegen stage and never
shuffle, so they can be applied to any post table before any operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import engagement as E
from ..functions import text as T
from .aggregates import hashtags, mentions


def with_scores(posts: DataFrame, as_of: Column | None = None) -> DataFrame:
    cols = {
        "engagement_score": E.engagement("pipeline"),
        "engagement_eda": E.engagement("eda", {"favorite_count": "like_count"}),
        "popularity_index": E.popularity_index(E.engagement("pipeline"), "author_followers"),
        "follower_following_ratio": E.follower_ratio("author_followers", "author_following"),
    }
    return posts.withColumns(cols)


def with_tags(posts: DataFrame) -> DataFrame:
    return posts.withColumns({"hashtags": hashtags("text"), "mentions": mentions("text")})


def with_text_features(posts: DataFrame, text: str = "text") -> DataFrame:
    feats = T.text_features(text)
    feats.pop("text_length")  # the stored column is kept; see ``fresh_text_length``
    feats["url_count"] = T.url_count(text)
    feats["avg_word_length"] = T.avg_word_length(text)
    return posts.withColumns(feats)
