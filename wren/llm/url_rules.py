"""URL filters by mined association rules (operator 10), DataFrame functions only.

Fixed host and path rules come first.  For every other URL, Spark's FP-growth
mines combinations of URL tokens from labelled pages; those that imply
``block`` with enough support and confidence become rules, and an inverted
index from token to rule matches them against the URLs.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import broadcast_if_small

#: Fixed rules: (host and its subdomains, start of the path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A mined rule needs this confidence, and this many blocked pages, however many pages have labels.
MIN_CONFIDENCE, MIN_PAGES = 0.9, 20
#: Rows of the inverted index that are broadcast at most; beyond that Spark joins by shuffle.
MAX_BROADCAST_INDEX = 1_000_000

SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest fixed rule that fits, or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host and its parent domains, path words, extension, query keys, fragment.

    Runs of digits are written ``0``.
    """
    text = F.coalesce(url, F.lit(""))
    host, path = url_host(url), F.regexp_replace(url_path(url), "[0-9]+", "0")
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.split(path, "[/._-]+"), lambda w: F.concat(F.lit("path="), w))
    query = F.split(F.regexp_extract(text, r"(?s)\?([^#]*)", 1), "&")
    keys = F.transform(query, lambda q: F.concat(F.lit("key="), F.split(q, "=")[0]))
    parts = F.concat(F.array(F.concat(F.lit("scheme="), F.regexp_extract(text, r"(?s)^(.*?)://", 1)),
                             F.concat(F.lit("fragment="), F.regexp_extract(text, r"(?s)#(.*)$", 1))), parents, words, keys)
    return F.array_distinct(F.filter(parts, lambda t: ~t.endswith("=")))


def mine_rules(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Token combinations that imply ``block``: ``(rule_id, tokens, confidence, support)``.

    ``labelled`` has ``url`` and the boolean ``blocked``.  Of two rules of which
    one's tokens contain the other's, the shorter one stays, as it fits wherever
    the longer one does.  Fewer labelled pages than ``min_pages``, no rules.
    """
    baskets = labelled.where("blocked IS NOT NULL").select(F.concat(
        url_tokens(F.col("url")), F.array(F.when(F.col("blocked"), "label=block").otherwise("label=allow"))).alias("items"))
    n = baskets.count()
    empty = "rule_id long, tokens array<string>, confidence double, support double"
    if n < max(min_pages, 1):
        return labelled.sparkSession.createDataFrame([], empty)
    support = max(min_pages - 0.5, 0.0) / n  # Spark rounds the count up, so half a page less can't ask for one more
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(
        (F.element_at("consequent", 1) == "label=block") & ~F.array_contains("antecedent", "label=allow")).select(
        F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    rules = rules.withColumn("rule_id", F.xxhash64("tokens"))
    # A rule is dropped if leaving out one of its tokens gives a rule as well.
    without = rules.select("rule_id", F.explode("tokens").alias("t"), "tokens").where(F.size("tokens") > 1).select(
        "rule_id", F.xxhash64(F.array_except("tokens", F.array("t"))).alias("part"))
    covered = without.join(rules.select(F.col("rule_id").alias("part")), "part").select("rule_id").distinct()
    return rules.join(covered, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support")


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` of ``urls`` that some mined rule fits, by the inverted index of the rules' tokens."""
    index = rules.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    tokens = urls.select("url").distinct().select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    hits = tokens.join(broadcast_if_small(index, MAX_BROADCAST_INDEX), "token")
    full = hits.groupBy("url", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n = need")
    return full.select("url").distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages``: ``id_col, host, path, rule, verdict``.

    ``labels`` has ``id_col`` and ``blocked``.  Null URLs and those without
    ``://`` have empty host and path and fit no fixed rule; a URL that no rule
    fits is allowed.  Repeated rows are judged each; other columns play no part.
    """
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    marked = labels.select(F.col(id_col).alias("id"), "blocked")
    labelled = read.join(marked.groupBy("id").agg(F.max("blocked").alias("blocked")), "id")
    mined = mine_rules(labelled)
    judged = read.select("id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = judged.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    blocked = matched_urls(judged.where("fixed IS NULL AND url IS NOT NULL"), mined).withColumn("mined", F.lit("block"))
    return judged.join(blocked, "url", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "mined", F.lit("allow")).alias("verdict"))


def url_verdicts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages judged with the labels of the same ids: low quality or toxic means ``block``."""
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return judge_urls(pages, marks)
