"""Quality rules, lines first (operator 8).

Each line is judged by itself: a repeated line, a line of menu or markup
symbols, a line without sentence marks or made of exclamations, and a licence or
site notice fail.  Failed lines are removed; a document that loses more than
half of its words with them is rejected, as is one that fails the base rules.
One pass over the texts, no shuffle.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import map_text

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: A line fails with more than one symbol in so many words.
WORDS_PER_SYMBOL = 5
#: A line of so many words or more needs a sentence mark.
MIN_WORDS_FOR_MARK = 8
SENTENCE_MARKS = ".!?…。"
#: A line fails with more than one exclamation mark in so many words.
WORDS_PER_EXCLAMATION = 2
#: Notices fail in lines of at most so many words.
MAX_NOTICE_WORDS = 30
#: Phrases of licences and site notices.
NOTICES = ("all rights reserved", "licensed under", "released under", "privacy policy", "terms of use",
           "terms of service", "accept cookies", "enable javascript", "sign up for", "click here")
#: A document goes if it loses more than this share of its words.
MAX_LOST = (1, 2)

NOTICE = re.compile("|".join(NOTICES), re.IGNORECASE | re.ASCII)


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of ``size`` (a power of two) words that the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    step = 1
    while step < size:  # windows of twice the length are pairs of ranks; ranks are exact, no hashing
        pair = rank[:-step] * len(words) + rank[step:]
        _, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        step *= 2
    twice = counts[rank] >= 2
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_fails(line: str, n_words: int) -> bool:
    """The rules for one line that has words."""
    if sum(map(line.count, SYMBOLS)) * WORDS_PER_SYMBOL > n_words:
        return True
    if n_words >= MIN_WORDS_FOR_MARK and not any(m in line for m in SENTENCE_MARKS):
        return True
    if line.count("!") * WORDS_PER_EXCLAMATION > n_words:
        return True
    return n_words <= MAX_NOTICE_WORDS and NOTICE.search(line) is not None


def judge(text: str | None) -> dict:
    """All measures of one text, the verdict, and the text without its failed lines."""
    text = text or ""
    words = text.encode("utf-8").split()  # splits at the six ASCII spaces
    seen: set[str] = set()
    n_dup = n_failed = kept_words = 0
    kept_lines = []
    for line in text.split("\n"):
        n = len(line.encode("utf-8").split())
        if not n:
            kept_lines.append(line)
            continue
        again = line in seen
        seen.add(line)
        n_dup += again
        if again or line_fails(line, n):
            n_failed += 1
        else:
            kept_words += n
            kept_lines.append(line)
    n_words, n_repeat = len(words), repeated_words(words)
    base_failed = n_words < 20 or 100 * n_repeat > 30 * n_words
    num, den = MAX_LOST
    return {
        "n_words": n_words, "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": not base_failed and (n_words - kept_words) * den <= num * n_words,
        "n_failed_lines": n_failed, "kept_words": kept_words, "clean_text": "\n".join(kept_lines),
    }


RESULT = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("n_failed_lines", T.LongType()), T.StructField("kept_words", T.LongType()),
    T.StructField("clean_text", T.StringType())])


def line_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures, the verdict ``kept`` and ``clean_text`` (failed lines removed), one row per row.

    Null and empty texts have no words and fail the base rules; repeated rows
    are judged each; columns whose names clash with the results give way.
    """
    return map_text(docs, text_col, lambda texts: [judge(t) for t in texts], RESULT)


def rule_digests(docs: DataFrame) -> DataFrame:
    return line_rules(docs.select("doc_id", "text")).drop("text", "clean_text")


#: The same in DuckDB SQL.
DIGEST_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (
          SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2) GROUP BY 1),
ln AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
              row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM ln),
lf AS (SELECT *, again
          OR 5 * len(regexp_extract_all(line, '[#*$%&|<>]')) > n
          OR (n >= 8 AND NOT regexp_matches(line, '[.!?…。]'))
          OR 2 * len(regexp_extract_all(line, '!')) > n
          OR (n <= 30 AND regexp_matches(line, '(?i)all rights reserved|licensed under|released under|privacy policy|terms of use|terms of service|accept cookies|enable javascript|sign up for|click here')) AS fails
       FROM lw WHERE n > 0),
la AS (SELECT doc_id, count(*) FILTER (again) AS n_dup, count(*) FILTER (fails) AS n_failed, sum(CASE WHEN fails THEN 0 ELSE n END) AS kw FROM lf GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
       len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
       coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
       len(ws) < 20 OR 100 * coalesce(n_repeat, 0) > 30 * len(ws) AS base_failed,
       NOT (len(ws) < 20 OR 100 * coalesce(n_repeat, 0) > 30 * len(ws)) AND 2 * (len(ws) - coalesce(kw, 0)) <= len(ws) AS kept,
       coalesce(n_failed, 0)::BIGINT AS n_failed_lines, coalesce(kw, 0)::BIGINT AS kept_words
FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN la USING (doc_id)
"""
