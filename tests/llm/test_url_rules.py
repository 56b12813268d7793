from itertools import combinations

import pytest
from pyspark.sql import functions as F

from wren.llm.url_rules import RULES, judge_urls, matched_urls, mine_rules, url_tokens


def by_hand(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


URLS = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "http://example.org/en/2", "http://x.org", "http://x.org?q", "http://x.org/",
        "http://aorg/", "http://b.com/fr/", "http://b.com/de/9#t", "http://b.com/deutsch", "http://b.com/fr", "ftp://u:p@h.com:8/de/", "no scheme",
        "", None, "://org/", "http://a://b.org/x", "http://É.org/ÀB", "http://h.net/\nde/", "http://notexample.org/es/", "http:///path"]


def test_fixed_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    rows = judge_urls(pages, labels).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == {i: by_hand(u) for i, u in enumerate(URLS)}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(400):
        host = ["a.net", "spam.net", "b.net", "c.spam.net"][i % 4]
        section = ["buy", "news", "win"][i % 3]
        bad = "spam" in host and section != "news" or section == "win" and i % 8 == 1
        rows.append((i, f"http://{host}/{section}/{i}?id={i}", bad))
    return spark.createDataFrame(rows, "page_id long, url string, blocked boolean")


def test_rules_equal_all_combinations_counted(labelled):
    baskets = [(frozenset(r["t"]), r["blocked"]) for r in labelled.select(url_tokens(F.col("url")).alias("t"), "blocked").collect()]
    n, least = len(baskets), max(0.002, 20 / len(baskets))
    tokens = sorted({t for b, _ in baskets for t in b})
    good = set()
    for size in range(1, 7):
        for c in combinations(tokens, size):
            c = frozenset(c)
            if any(c - {t} in good or any(g < c for g in good) for t in c):
                continue
            hits = [bad for b, bad in baskets if c <= b]
            if hits and sum(hits) / n >= least - 1e-12 and sum(hits) / len(hits) >= 0.9:
                good.add(c)
    mined = mine_rules(labelled).collect()
    assert {frozenset(r["tokens"]) for r in mined} == good and good


def test_the_same_pages_give_a_rule_in_a_table_of_any_size(spark):
    bad = [(i, f"http://bad.net/{i}", True) for i in range(20)]
    for n in (0, 300, 20_000):
        rows = bad + [(100 + i, f"http://h{i % 40}.com/p{i % 7}/{i}", False) for i in range(n)]
        mined = mine_rules(spark.createDataFrame(rows, "page_id long, url string, blocked boolean")).collect()
        assert ["host=bad.net"] in [r["tokens"] for r in mined]
        less = [r for r in rows if r[0] != 0]
        assert not mine_rules(spark.createDataFrame(less, "page_id long, url string, blocked boolean")).collect()


def test_matching_by_index(spark, labelled):
    mined = mine_rules(labelled)
    rules = [set(r["tokens"]) for r in mined.collect()]
    got = {r["url"] for r in matched_urls(labelled, mined).collect()}
    want = {r["url"] for r in labelled.select("url", url_tokens(F.col("url")).alias("t")).collect() if any(k <= set(r["t"]) for k in rules)}
    assert got == want and got
    unseen = spark.createDataFrame([(1, "http://new.spam.net/buy/777"), (2, "http://new.net/news/1"), (2, "http://new.net/news/1")], "page_id long, url string")
    verdicts = sorted((r["page_id"], r["verdict"]) for r in judge_urls(unseen.unionByName(labelled.select("page_id", "url")), labelled).collect() if r["host"].startswith("new"))
    assert verdicts == [(1, "block"), (2, "allow"), (2, "allow")]


def test_edge_tables(spark, labelled):
    none = labelled.where("false")
    assert judge_urls(none.drop("blocked"), labelled.select("page_id", "blocked")).count() == 0
    assert mine_rules(none).count() == 0
    clash = labelled.withColumn("verdict", F.lit("x")).withColumn("host", F.lit(1))
    assert judge_urls(clash, none.select("page_id", "blocked")).columns == ["page_id", "host", "path", "rule", "verdict"]
