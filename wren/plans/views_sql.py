"""DuckDB SQL for the derived views (the oracle side of ``wren.sources.fixtures``).

Each entry is one or more common table expressions; ``with_views`` prepends the
ones a query needs, in dependency order.
"""

from __future__ import annotations

VIEW_SQL: dict[str, str] = {
    "_n": "_n AS (SELECT max(doc_id) + 1 AS n FROM documents)",
    "_eng": """_eng AS (
  SELECT e.event_id % _n.n AS doc_id,
    cast(sum(CASE WHEN event_type = 'click'    THEN 1 ELSE 0 END) AS BIGINT) AS like_count,
    cast(sum(CASE WHEN event_type = 'signup'   THEN 1 ELSE 0 END) AS BIGINT) AS retweet_count,
    cast(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS reply_count,
    cast(sum(CASE WHEN event_type = 'error'    THEN 1 ELSE 0 END) AS BIGINT) AS quote_count,
    cast(sum(CASE WHEN event_type = 'view'     THEN 1 ELSE 0 END) AS BIGINT) AS bookmark_count,
    min(ts) AS created_at
  FROM events e CROSS JOIN _n GROUP BY e.event_id % _n.n)""",
    "_docs": """_docs AS (
SELECT doc_id, doc_id AS base_id, lang, source, n_chars,
  CASE WHEN doc_id % 4 = 1 THEN concat(text, ' #', lang)
       WHEN doc_id % 4 = 2 THEN concat(text, ' @', source, ' #', lang, '!')
       WHEN doc_id % 4 = 3 THEN concat(text, '?')
       ELSE text END AS text FROM documents
UNION ALL
SELECT doc_id + n, doc_id, lang, source, length(concat('@', source, ' ok')), concat('@', source, ' ok')
FROM documents, _n WHERE doc_id % 17 = 0)""",
    "posts": """posts AS (
SELECT d.doc_id, concat('t', cast(d.doc_id AS varchar)) AS uniqueid,
  d.source AS author_username, d.lang,
  d.text AS text,
  CASE WHEN l.doc_id IS NULL THEN NULL
       WHEN l.toxic = 1 THEN concat(d.lang, ', toxic,')
       ELSE concat(d.lang, ',', CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END) END AS topics,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 11 = 1 THEN '' WHEN d.doc_id % 11 = 2 THEN 'error'
       WHEN d.doc_id % 11 = 3 THEN 'skipped' ELSE 'completed' END AS processed,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE d.n_chars END AS text_length,
  CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE cast(d.n_chars % 21 - 10 AS double) / 10 END AS sentiment,
  c.c_custkey AS author_following, cast(floor(abs(c.c_acctbal)) AS bigint) AS author_followers,
  e.like_count, e.retweet_count, e.reply_count, e.quote_count, e.bookmark_count,
  cast(e.created_at AS timestamp) + (d.doc_id % 28) * interval '1' day AS created_at
FROM _docs d
LEFT JOIN _eng e ON d.base_id = e.doc_id
LEFT JOIN labels l ON d.base_id = l.doc_id
LEFT JOIN customer c ON c.c_custkey = d.doc_id % (SELECT max(c_custkey) + 1 FROM customer))""",
    "history": """history AS (
SELECT p.doc_id AS seq, cast(floor(p.doc_id / 4.0) AS bigint) AS run_id, p.doc_id % 4 AS iteration, p.text AS tweet,
  cast(length(p.text) % 40 + 1 AS double) / 4 AS predicted_engagement, p.doc_id % 10 = 0 AS is_exploration,
  CASE WHEN p.doc_id % 3 = 0 THEN NULL ELSE cast(p.like_count * 1.0 + p.retweet_count * 2.0 + p.reply_count * 1.5
    + p.quote_count * 1.8 + p.bookmark_count * 1.2 AS double) END AS actual_engagement,
  CASE WHEN p.doc_id % 3 = 0 THEN NULL ELSE p.created_at END AS feedback_collected_at,
  [p.text, concat(p.text, '!'), concat(p.text, '?')] AS variations
FROM posts p)""",
    "prompts": """prompts AS (
SELECT item_id AS version, text AS prompt, cast(item_id * 37 % 101 AS double) AS avg_engagement,
  cast(item_id * 37 % 101 + 20 AS double) AS max_engagement, cast(item_id * 37 % 101 - 20 AS double) AS min_engagement,
  cast(item_id * 13 % 50 AS double) AS improvement_rate, cast(item_id * 7 % 10 AS double) / 10 AS consistency,
  cast(100 + item_id * 11 % 180 AS double) AS avg_length, cast(item_id % 3 AS double) AS hashtag_ratio,
  cast(item_id % 2 AS double) AS emoji_ratio, cast(item_id % 4 AS double) / 4 AS question_ratio,
  cast(item_id % 5 AS double) / 5 AS exclamation_ratio, cast(item_id % 10 AS double) / 10 AS topic_coverage,
  timestamp '2024-01-01 00:00:00' + item_id * interval '1' hour AS timestamp
FROM benchmark)""",
    "requests": """requests AS (
SELECT e.event_id AS request_id, e.user_id AS client_id, e.event_type AS endpoint, cast(e.ts AS timestamp) AS started_at,
  e.value / 100 AS latency_s, CASE WHEN e.event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN e.event_id % 29 = 0 THEN '' ELSE concat(p.text, CASE WHEN e.event_id % 5 = 0 THEN substr(p.text, 1, 60) ELSE '' END) END AS text,
  CASE WHEN e.event_id % 9 = 0 THEN NULL ELSE e.event_id % 13 END AS iterations,
  CASE WHEN e.event_id % 9 = 1 THEN NULL ELSE e.event_id % 23 END AS variations
FROM events e CROSS JOIN _n JOIN posts p ON p.doc_id = e.event_id % _n.n)""",
    # Posts with the engagement scores (S5, S6), popularity (S8), ratio (S10), tags.
    "sposts": r"""sposts AS (
SELECT *,
  cast(coalesce(like_count, 0) * 1.0 + coalesce(retweet_count, 0) * 2.0 + coalesce(reply_count, 0) * 1.5
       + coalesce(quote_count, 0) * 1.5 AS double) AS engagement_score,
  cast(coalesce(retweet_count, 0) * 1.0 + coalesce(like_count, 0) * 2.0 + coalesce(reply_count, 0) * 3.0 AS double)
    AS engagement_eda,
  regexp_extract_all(text, '#([\p{L}\p{N}_]+)', 1) AS hashtags,
  regexp_extract_all(text, '@([\p{L}\p{N}_]+)', 1) AS mentions
FROM posts)""",
    # Text features (S1-S3, S23) on top of sposts.
    "fposts": r"""fposts AS (
SELECT *,
  CASE WHEN text IS NULL THEN 0.0::DOUBLE
       WHEN _wc > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (_wc::DOUBLE / greatest(1, _ns)::DOUBLE)
                         - 84.6::DOUBLE * (_syl::DOUBLE / _wc::DOUBLE)
       ELSE 0.0::DOUBLE END AS flesch_reading_ease,
  CASE WHEN _wc > 0 THEN _wlen::DOUBLE / _wc::DOUBLE END AS avg_word_length,
  coalesce(_wc, 0) AS word_count
FROM (
  SELECT *, len(_w) AS _wc,
    list_sum(list_transform(_w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+'))))) AS _syl,
    list_sum(list_transform(_w, lambda x: length(x))) AS _wlen,
    coalesce(len(regexp_extract_all(text, '[.!?]+')), 0) AS _ns,
    coalesce(len(regexp_extract_all(text, '#[\p{L}\p{N}_]+')), 0) AS hashtag_count,
    coalesce(len(regexp_extract_all(text, '@[\p{L}\p{N}_]+')), 0) AS mention_count,
    coalesce(len(regexp_extract_all(text, 'https?://\S+')), 0) AS url_count,
    coalesce(len(regexp_extract_all(text,
      '[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{27BF}]')), 0)
      AS emoji_count
  FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS _w FROM sposts)))""",
}

VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "_n": (),
    "_eng": ("_n",),
    "_docs": ("_n",),
    "posts": ("_eng", "_docs"),
    "history": ("posts",),
    "prompts": (),
    "requests": ("posts", "_n"),
    "sposts": ("posts",),
    "fposts": ("sposts",),
}


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for dep in VIEW_DEPS.get(n, ()):
            visit(dep)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(sql: str, *names: str, extra: tuple[str, ...] = (), recursive: bool = False) -> str:
    """Prefix ``sql`` with the CTEs for ``names`` plus extra CTE strings."""
    ctes = [VIEW_SQL[n] for n in _order(names)] + list(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + sql
