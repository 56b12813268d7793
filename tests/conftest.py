"""Shared fixtures: one local session, the reference's 3-row sample table and
edge-case rows (null text, null topics, ties, duplicate keys, zero followers)."""

from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wren.session import get_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4, app_name="wren-tests")
    yield s
    s.stop()


POST_SCHEMA = ("uniqueid string, text string, author_username string, created_at timestamp, like_count long, "
               "retweet_count long, reply_count long, quote_count long, view_count long, bookmark_count long, "
               "lang string, topics string, author_followers long, author_following long, processed string, "
               "text_length long, sentiment double")

NOW = datetime(2024, 1, 31)


def _row(i, text, topics, likes, processed="completed", followers=100, following=10, author=None,
         text_length=10, sentiment=0.1):
    return (f"test{i}", text, author or f"user{i}", NOW - timedelta(days=i), likes, likes // 2, likes // 5,
            likes // 10, likes * 10, likes // 3, "en", topics, followers, following, processed, text_length, sentiment)


@pytest.fixture(scope="session")
def sample_posts(spark):
    """The reference's 3 sample posts (counts 10/20/30 ...)."""
    rows = [_row(1, "Test tweet 1", "tech,ai", 10), _row(2, "Test tweet 2", "data,science", 20),
            _row(3, "Test tweet 3", "ml,dl", 30)]
    return spark.createDataFrame(rows, POST_SCHEMA)


@pytest.fixture(scope="session")
def edge_posts(spark):
    rows = [
        _row(1, "Test tweet 1 #ai @bob", "tech,ai", 10),
        _row(2, "Test tweet 2", "data, science ,", 20),
        _row(3, "Test tweet 3!", None, 30, processed=None),
        _row(4, None, "tech", 30, processed=""),
        _row(5, "@carl ok", "ai", 0, followers=0, following=0),
        _row(6, "Émile a écrit ça 🚀 #été", "tech", 10, processed="error", text_length=None),
        _row(7, "   ", "", 10, processed="skipped", sentiment=None),
        _row(8, "dup", "ai,tech", 10, author="user1"),
    ]
    return spark.createDataFrame(rows, POST_SCHEMA)
