"""Spark results equal the DuckDB oracle SQL on the smallest tables (a
sample of the driver's correctness gate, exact float comparison)."""

from __future__ import annotations

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wren.sources.tables import TABLES

from .conftest import SF001

_spec = importlib.util.spec_from_file_location(
    "check_oracle", os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools", "check_oracle.py"))
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)
check.STRICT = True

SAMPLE = ["top_topics", "top_authors", "topic_distribution", "feature_importance", "iqr_outliers",
          "engagement_histogram", "cluster_top_tags", "posts_to_process", "short_reply", "landing_flatten",
          "insert_new_posts", "upsert_features", "feedback_match", "variation_metrics", "epsilon_update",
          "prompt_versions", "valid_requests", "in_flight", "lexicon_sentiment", "extract_topics",
          "parse_variations", "classification_report", "load_history"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF001)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert check._rows(sdf.columns, srows) == check._rows(dcols, drows)
