"""Named queries for text columns and lexicon lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import engagement as E
from ..functions import text as T
from ..functions.stopwords import ENGLISH_STOP_WORDS
from ..operators import lexicon as LX
from ..operators.aggregates import rnd
from ..sources import fixtures as FX
from .catalog import register
from .views_sql import with_views as V

W_SQL = r"'[\p{L}\p{N}_]+'"
TOK_CTE = rf"tok AS (SELECT uniqueid, unnest(regexp_extract_all(lower(text), {W_SQL})) AS word FROM posts)"
#: The learnt word table (``LX.learnt_words``) over posts, and the lexicon made of it.
LEARNT_CTES = (r"""taught AS (
  SELECT uniqueid, list_append(list_distinct(list_filter(list_transform(string_split(topics, ','), lambda t: trim(t, ' ')),
           lambda t: t <> '')), '') AS ts,
    list_distinct(regexp_extract_all(lower(text), """ + W_SQL + r""")) AS ws
  FROM posts WHERE topics IS NOT NULL AND text IS NOT NULL)""",
               """wt AS (SELECT word, topic, count(*) AS k FROM (SELECT word, unnest(ts) AS topic FROM (
  SELECT ts, unnest(ws) AS word FROM taught)) GROUP BY word, topic)""",
               "nt AS (SELECT topic, count(*) AS n FROM (SELECT unnest(ts) AS topic FROM taught) GROUP BY topic)",
               f"""learnt AS (SELECT word, topic, z FROM (
  SELECT word, topic, round((ln(a) - ln(b) - ln(c) + ln(d)) / sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS z FROM (
    SELECT wt.word, wt.topic, wt.k + {LX.SMOOTHING}::DOUBLE AS a, nt.n - wt.k + {LX.SMOOTHING}::DOUBLE AS b,
      al.k - wt.k + {LX.SMOOTHING}::DOUBLE AS c, tot.n - nt.n - al.k + wt.k + {LX.SMOOTHING}::DOUBLE AS d
    FROM wt JOIN nt USING (topic) JOIN wt al ON al.word = wt.word AND al.topic = '' CROSS JOIN (SELECT n FROM nt WHERE topic = '') tot
    WHERE wt.topic <> '')) WHERE z >= {LX.LEAST_Z})""",
               f"""lex AS (SELECT word, cast(round(sum(CASE WHEN topic = '{LX.GOOD}' THEN z / (z + 1) ELSE -(z / (z + 1)) END), 2)
  AS decimal(4,2)) AS polarity FROM learnt WHERE topic IN ('{LX.GOOD}', '{LX.BAD}') GROUP BY word)""",
               "tw AS (SELECT word, topic FROM learnt)")

_SHORT_SQL = r"""(starts_with(text, '@') AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 3)"""


#: Age of the author's account in ``FX.with_author_created``, from the numbers that the strings are made of.
AGE_SQL = """CASE WHEN doc_id % 8 >= 6 THEN 0
  ELSE (1706659200 - (1262304000 + doc_id % 4000 * 86400 + doc_id * 7919 % 86400)) // 86400 END"""

#: Sentiment and topics of every post that has any, by the learnt tables.
FELT_CTE = """felt AS (
SELECT p.uniqueid,
  coalesce(sign(s.tot) * ((abs(s.tot) * 20000 + s.n) // (2 * s.n)) / 1000000.0, 0.0)::DOUBLE + 0.0 AS sentiment,
  coalesce(((s.ab * 20000 + s.n) // (2 * s.n)) / 1000000.0, 0.0)::DOUBLE + 0.0 AS subjectivity
FROM posts p LEFT JOIN (SELECT uniqueid, sum(cast(polarity * 100 AS BIGINT)) AS tot,
                               sum(abs(cast(polarity * 100 AS BIGINT))) AS ab, count(*) AS n
                        FROM tok JOIN lex USING (word) GROUP BY uniqueid) s ON p.uniqueid = s.uniqueid)"""
NAMED_CTE = f"""named AS (
SELECT p.uniqueid, CASE WHEN {_SHORT_SQL.replace('text', 'p.text')} THEN 'short reply' ELSE coalesce(r.topics, '') END AS topics
FROM posts p LEFT JOIN (
  SELECT uniqueid, string_agg(topic, ',' ORDER BY n DESC, topic) AS topics FROM (
    SELECT uniqueid, topic, n, row_number() OVER (PARTITION BY uniqueid ORDER BY n DESC, topic) AS rk FROM (
      SELECT uniqueid, topic, count(*) AS n FROM tok JOIN tw USING (word) GROUP BY 1, 2))
  WHERE rk <= 5 GROUP BY uniqueid) r ON p.uniqueid = r.uniqueid)"""


@register("lexicon_sentiment", "C8 S4", V("SELECT * FROM felt", "posts", extra=(TOK_CTE, *LEARNT_CTES, FELT_CTE)))
def q_lexicon_sentiment(spark, sf):
    """Sentiment by the polarity learnt from the labels of the posts."""
    return LX.sentiment(FX.posts(spark, sf), FX.learnt_lexicon(spark, sf))


@register("learnt_words", "S4 S15 C8", V("SELECT word, topic, z FROM learnt", "posts", extra=LEARNT_CTES))
def q_learnt_words(spark, sf):
    return LX.learnt_words(FX.posts(spark, sf))


@register("extract_topics", "S15 C8 S14 B6", V("SELECT * FROM named", "posts", extra=(TOK_CTE, *LEARNT_CTES, NAMED_CTE)))
def q_extract_topics(spark, sf):
    """Topics by the words learnt from the labels of the posts."""
    t = LX.extract_topics(FX.posts(spark, sf), FX.learnt_words(spark, sf))
    return t.select("uniqueid", T.topics_to_csv(F.col("topics_list")).alias("topics"))


_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"


PROCESSED_SQL = f"""array_to_string(list_filter(regexp_extract_all(lower(text), {W_SQL}),
  lambda w: NOT list_contains({_STOP_SQL}, w)), ' ')"""


@register("preprocess_text", "S11", V(f"SELECT uniqueid, {PROCESSED_SQL} AS processed_text FROM posts", "posts"))
def q_preprocess_text(spark, sf):
    return LX.with_processed_text(FX.posts(spark, sf).select("uniqueid", "text")).select("uniqueid", "processed_text")


@register("parse_list", "S12", V("""
SELECT uniqueid, concat(lang, '|', author_username) AS from_literal, concat(lang, '|', author_username) AS from_csv,
  '' AS from_null FROM posts""", "posts"))
def q_parse_list(spark, sf):
    p = FX.posts(spark, sf)
    literal = F.concat(F.lit("['"), F.col("lang"), F.lit("', '"), F.col("author_username"), F.lit("']"))
    csv = F.concat(F.col("lang"), F.lit(","), F.col("author_username"))
    return p.select("uniqueid",
                    F.array_join(T.parse_list(literal), "|").alias("from_literal"),
                    F.array_join(T.parse_list(csv), "|").alias("from_csv"),
                    F.array_join(T.parse_list(F.lit(None).cast("string")), "|").alias("from_null"))


@register("parse_topics_json", "S13 S14", V("""
SELECT uniqueid, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(lang, ',', author_username) END AS topics FROM posts""",
                                            "posts"))
def q_parse_topics_json(spark, sf):
    p = FX.posts(spark, sf)
    js = F.when(F.col("doc_id") % 3 == 0, F.lit("not json")).otherwise(
        F.to_json(F.struct(F.array("lang", "author_username").alias("topics"))))
    return p.select("uniqueid", T.topics_to_csv(T.parse_topics_json(js)).alias("topics"))


def _numbered(text):
    """Numbered-list text from a post: even lines open items 1, 2, ...; odd
    lines continue them (a fixture rule)."""
    lines = F.split(text, "\n")
    return F.array_join(F.transform(lines, lambda l, i: F.when(i % 2 == 0, F.concat((i / 2 + 1).cast("int").cast("string"),
                                                                                      F.lit(". "), l)).otherwise(l)), "\n")


@register("parse_variations", "S18 S19", V(r"""
SELECT uniqueid, len(padded) AS n_items, md5(array_to_string(padded, ' | ')) AS items_md5 FROM (
  SELECT uniqueid,
    (CASE WHEN len(items) = 0 THEN [text] ELSE items END
     || list_transform(range(greatest(5 - len(CASE WHEN len(items) = 0 THEN [text] ELSE items END), 0)),
          lambda _: CASE WHEN NOT contains(f, '!') THEN f || '!'
                         WHEN NOT contains(f, '?') THEN replace(f, '!', '?')
                         ELSE f || ' ' || chr(128640) END))[1:5] AS padded
  FROM (SELECT p.uniqueid, p.text, coalesce(it.items, []) AS items,
               (CASE WHEN len(coalesce(it.items, [])) = 0 THEN [p.text] ELSE it.items END)[1] AS f
        FROM posts p LEFT JOIN (
          SELECT uniqueid, list(item ORDER BY grp) FILTER (WHERE item <> '') AS items FROM (
            SELECT uniqueid, grp,
              regexp_replace(CASE WHEN first(body ORDER BY pos) = '' THEN ''
                   ELSE string_agg(body, ' ' ORDER BY pos) FILTER (WHERE body <> '') END, '^\s+|\s+$', '', 'g') AS item
            FROM (SELECT uniqueid, pos, grp,
                    CASE WHEN is_start THEN regexp_replace(regexp_replace(l, '^[^.]*\.', ''), '^\s+|\s+$', '', 'g')
                         ELSE l END AS body
                  FROM (SELECT uniqueid, pos, l, is_start,
                          sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER (PARTITION BY uniqueid ORDER BY pos) AS grp
                        FROM (SELECT uniqueid, pos, l,
                                regexp_extract(l, '^([0-9]+)\.', 1) <> ''
                                AND NOT starts_with(regexp_extract(l, '^([0-9]+)\.', 1), '0')
                                AND TRY_CAST(regexp_extract(l, '^([0-9]+)\.', 1) AS INTEGER) BETWEEN 1 AND 5 AS is_start
                              FROM (SELECT uniqueid, generate_subscripts(ls, 1) AS pos, unnest(ls) AS l FROM (
                                      SELECT uniqueid, list_transform(string_split(text, chr(10)),
                                        lambda x, i: regexp_replace(CASE WHEN (i - 1) % 2 = 0
                                          THEN cast((i - 1) // 2 + 1 AS VARCHAR) || '. ' || x ELSE x END,
                                          '^\s+|\s+$', '', 'g')) AS ls FROM posts)))))
            WHERE grp > 0 GROUP BY uniqueid, grp)
          GROUP BY uniqueid) it ON p.uniqueid = it.uniqueid))""", "posts"))
def q_parse_variations(spark, sf):
    p = FX.posts(spark, sf)
    items = T.parse_variations(_numbered(F.col("text")), 5)
    padded = T.pad_variations(items, F.col("text"), 5)
    return p.select("uniqueid", F.size(padded).alias("n_items"), F.md5(F.array_join(padded, " | ")).alias("items_md5"))


@register("engagement_features", "S5 S8 S9 S10 S16", V("""
SELECT uniqueid, engagement_score,
  round(engagement_score / sqrt(CASE WHEN author_followers IS NULL OR author_followers = 0 THEN 1
                                     ELSE author_followers END), 6) AS popularity_index,
  round(coalesce(author_followers, 0) / (CASE WHEN author_following IS NULL OR author_following = 0 THEN 1
                                               ELSE author_following END), 6) AS follower_following_ratio,
  """ + AGE_SQL + """ AS account_age_days,
  round(least(0.95, greatest(0.5, engagement_score / 100)), 6) AS confidence
FROM sposts""", "sposts"))
def q_engagement_features(spark, sf):
    from .q_posts import scored
    p = FX.with_author_created(scored(spark, sf))
    return p.select("uniqueid", "engagement_score", rnd(F.col("popularity_index")).alias("popularity_index"),
                    rnd(F.col("follower_following_ratio")).alias("follower_following_ratio"),
                    E.account_age_days("author_created", FX.as_of_lit()).alias("account_age_days"),
                    rnd(E.confidence("engagement_score")).alias("confidence"))


PROMPT_SUFFIX = " Keep every variation under 280 characters."


@register("prompt_guard", "S24", V(f"""
SELECT version, (length(prompt || '{PROMPT_SUFFIX}') <= 1000 AND prompt || '{PROMPT_SUFFIX}' <> prompt) AS replaced,
  length(CASE WHEN length(prompt || '{PROMPT_SUFFIX}') <= 1000 THEN prompt || '{PROMPT_SUFFIX}' ELSE prompt END)
    AS prompt_length
FROM prompts""", "prompts"))
def q_prompt_guard(spark, sf):
    p = FX.prompts(spark, sf)
    new = F.concat(F.col("prompt"), F.lit(PROMPT_SUFFIX))
    keep = (F.length(new) <= 1000) & (new != F.col("prompt"))
    chosen = F.when(F.length(new) <= 1000, new).otherwise(F.col("prompt"))
    return p.select("version", keep.alias("replaced"), F.length(chosen).alias("prompt_length"))


@register("topic_one_hot", "C9 S20", V("""
SELECT n.uniqueid, cast(count(v.idx) AS INTEGER) AS n_topics, coalesce(string_agg(v.idx, ',' ORDER BY v.idx), '') AS topic_ids
FROM named n LEFT JOIN each USING (uniqueid) LEFT JOIN vocabulary v USING (topic) GROUP BY 1""", "posts", extra=(
    TOK_CTE, *LEARNT_CTES, NAMED_CTE,
    "each AS (SELECT uniqueid, unnest(string_split(topics, ',')) AS topic FROM named WHERE topics <> '')",
    "vocabulary AS (SELECT topic, row_number() OVER (ORDER BY count(*) DESC, topic) - 1 AS idx FROM each GROUP BY topic "
    "ORDER BY idx LIMIT 100)")))
def q_topic_one_hot(spark, sf):
    from pyspark.ml.functions import vector_to_array

    t = LX.extract_topics(FX.posts(spark, sf), FX.learnt_words(spark, sf))
    vec, _ = LX.topic_one_hot(t, "topics_list", 100)
    ids = F.filter(F.transform(vector_to_array("topic_vec"), lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return vec.select("uniqueid", ids.alias("ids")).select(
        "uniqueid", F.size("ids").alias("n_topics"), F.array_join("ids", ",").alias("topic_ids"))
