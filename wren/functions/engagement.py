"""Engagement, popularity and author columns.

All functions return ``Column`` expressions, so they compile into whole-stage
codegen next to the scan; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three engagement weight sets used by the reference.
#   pipeline: like 1.0, retweet 2.0, reply 1.5, quote 1.5
#   eda:      retweet 1, favorite 2, reply 3
#   feedback: like 1.0, retweet 2.0, reply 1.5, quote 1.8, bookmark 1.2
WEIGHTS = {
    "pipeline": {"like_count": 1.0, "retweet_count": 2.0, "reply_count": 1.5, "quote_count": 1.5},
    "eda": {"retweet_count": 1.0, "favorite_count": 2.0, "reply_count": 3.0},
    "feedback": {"like_count": 1.0, "retweet_count": 2.0, "reply_count": 1.5,
                 "quote_count": 1.8, "bookmark_count": 1.2},
}


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_or_zero(c: str | Column) -> Column:
    """Lenient numeric coercion: bad or missing values become 0."""
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(0.0))


def engagement(weights: str | dict = "pipeline", cols: dict | None = None) -> Column:
    """Weighted sum of engagement counts.

    ``cols`` maps a weight name to the column that holds it (for example
    ``{"favorite_count": "like_count"}`` when a table uses the other API dialect).
    The weights have one decimal place, so the sum is formed in DECIMAL and cast
    to double once: the result does not depend on the summation order.
    """
    w = WEIGHTS[weights] if isinstance(weights, str) else weights
    cols = cols or {}
    total = None
    for name, weight in w.items():
        src = _c(cols.get(name, name))
        term = F.coalesce(src.cast("string").try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")) \
            * F.lit(weight).cast("decimal(3,1)")
        total = term if total is None else total + term
    return total.cast("double")


def safe_denominator(c: str | Column) -> Column:
    """Missing, non-numeric or zero counts become 1 (the reference's fallback)."""
    v = _c(c).cast("string").try_cast("double")
    return F.coalesce(F.nullif(v, F.lit(0.0)), F.lit(1.0))


def popularity_index(score: str | Column, followers: str | Column) -> Column:
    """score / sqrt(followers), followers 0 or bad -> 1."""
    return _c(score) / F.sqrt(safe_denominator(followers))


def follower_ratio(followers: str | Column, following: str | Column) -> Column:
    """followers / following, following 0 or bad -> 1."""
    return numeric_or_zero(followers) / safe_denominator(following)


def creation_time(created: str | Column) -> Column:
    """Timestamp of a creation date as the dialects write it, null if none fits.

    Fixed values, the forms: ISO dates and times with or without offset,
    ``Wed Oct 10 20:19:24 +0000 2018``, ``Wed, 10 Oct 2018 20:19:24 +0000``,
    seconds (9 to 11 digits) or milliseconds (12 to 14 digits) since 1970."""
    s = F.trim(_c(created).cast("string"))
    since = s.try_cast("bigint")
    return F.coalesce(
        F.when(s.rlike("^[0-9]{9,11}$"), F.timestamp_seconds(since)).when(s.rlike("^[0-9]{12,14}$"), F.timestamp_millis(since)),
        F.try_to_timestamp(s),
        F.try_to_timestamp(F.substring(s, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")),
        F.try_to_timestamp(F.substring(s, 6, 100), F.lit("d MMM yyyy HH:mm:ss Z")))


def account_age_days(created: str | Column, as_of: Column) -> Column:
    """Whole 24-hour periods since account creation; 0 when unknown."""
    return F.coalesce(F.timestamp_diff("DAY", creation_time(created), as_of), F.lit(0)).cast("int")


def confidence(score: str | Column) -> Column:
    """min(0.95, max(0.5, score / 100))."""
    return F.least(F.lit(0.95), F.greatest(F.lit(0.5), _c(score) / 100))


def improvement_pct(new: str | Column, old: str | Column) -> Column:
    """(new / old - 1) * 100, 0 when old <= 0."""
    o, n = _c(old), _c(new)
    return F.when(o > 0, (n / o - 1) * 100).otherwise(F.lit(0.0))
