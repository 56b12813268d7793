"""Rows that every operator must stand: nulls, empty, blank and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 997}" for i in range(30_000))

EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a", 1),
    (2, None, "en", "a", 2),
    (3, "", None, "a", 3),
    (4, " \t\n \x0b\x0c\r ", "en", None, 4),
    (5, "one", "en", "b", 5),
    (6, LONG, "en", "b", 6),
    (7, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a", 7),
    (7, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a", 7),
    (8, "Ünïcode ΣΑΣ 漢字   nbsp. 🎉 é", "de", "b", 8),
    (9, "x" * 20_000, "en", "b", 9),
    (10, "\n\n\n", "en", "b", 10),
    (None, "no id here, only words that nobody else has said before.", "en", "a", 11),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_words long"  # n_words clashes with results


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def edge_benchmark(spark):
    words = [f"w{i}" for i in range(100, 140)]
    return spark.createDataFrame(
        [(1, " ".join(words)), (2, None), (3, ""), (4, "one"), (10, "fox JUMPS, over"), (10, "fox JUMPS, over"), (None, "漢字 nobody")],
        "item_id long, text string")
