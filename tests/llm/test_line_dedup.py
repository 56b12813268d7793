import random

import duckdb
import pandas as pd

from wren.llm import line_dedup
from wren.llm.line_dedup import dedup_lines


def passage(k, lines=3, words=20):
    return [" ".join(f"p{k}l{i}w{j}" for j in range(words)) + "." for i in range(lines)]


def corpus():
    own = lambda i: [" ".join(f"d{i}l{n}w{j}" for j in range(15)) + "." for n in range(3)]
    rows = [(1, own(1) + passage(0)), (2, own(2)[:1] + passage(0) + own(2)[1:]), (3, passage(0) + own(3)),
            (4, own(4) + ["short line"]), (5, own(5) + ["short line"]), (6, own(6) + passage(9, 1, 51)), (7, passage(9, 1, 51) + own(7)),
            (8, own(8) + passage(8, 1, 50)), (9, own(9) + passage(8, 1, 50)), (10, own(1) + passage(0)), (11, []),
            (12, passage(7, 12, 6) + own(12)), (13, own(13) + passage(7, 12, 6)), (14, ["a", ""] * 50)]
    return [(i, "\n".join(ls)) for i, ls in rows]


def test_runs_of_over_fifty_words_stay_once(spark):
    rows = corpus()
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert out[1]["text"] == text[1] and out[4]["text"] == text[4] and out[5]["text"] == text[5]
    assert out[8]["text"] == text[8] and out[9]["text"] == text[9]  # fifty words are not more than fifty
    for i in (2, 3):
        assert not set(passage(0)) & set(out[i]["text"].split("\n")) and out[i]["n_removed"] == 3
    assert out[7]["n_removed"] == 1 and out[6]["n_removed"] == 0
    assert out[10]["text"] == "" and out[10]["n_removed"] == 6


def test_against_sql(spark):
    rows = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = {r[0]: r[1:] for r in con.execute(line_dedup.DIGEST_SQL).fetchall()}
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()} == want


def must_go(rows, more_than=50):
    """Lines ``(id, pos)`` of every run of lines of over fifty words that stands at an earlier place too: brute force."""
    places = {}
    lines = {i: t.split("\n") for i, t in rows}
    for i in sorted(lines):
        for p, x in enumerate(lines[i]):
            places.setdefault(x, []).append((i, p))
    gone = set()
    for i, ls in lines.items():
        for p, x in enumerate(ls):
            for j, q in places[x]:
                if (j, q) >= (i, p):
                    break
                if p and q and ls[p - 1] == lines[j][q - 1]:
                    continue  # counted from where it begins
                n = 0
                while p + n < len(ls) and q + n < len(lines[j]) and ls[p + n] == lines[j][q + n]:
                    n += 1
                if sum(len(y.split()) for y in ls[p:p + n]) > more_than:
                    gone |= {(i, p + k) for k in range(n)}
    return gone


def removed(spark, rows):
    """Lines ``(id, pos)`` that the operator removed, where no line stands twice in a document."""
    out = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = set()
    for i, t in rows:
        left, at = out[i].split("\n") if out[i] else [], 0
        for p, x in enumerate(t.split("\n")):
            if at < len(left) and left[at] == x:
                at += 1
            else:
                gone.add((i, p))
        assert at == len(left)
    return gone


def test_passages_of_short_lines_are_found_whole(spark):
    """Passages of over fifty words in lines of any length, among fresh lines: all of it goes, nothing else."""
    rng = random.Random(5)
    fresh = iter(range(10**9))
    line = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n))
    rows, planted, around = [], [], [1, 6, 11, 12, 15]
    for _ in range(300):
        kind = rng.choice([1, 3, 6, 10, 11, 12, 25, 0])
        passage, n = [], 0
        while n <= 50:
            k = kind or rng.choice([0, 1, 5, 11, 12, 20, 45])
            passage.append(line(k) if k else "")
            n += k
        if passage[-1] and passage[0]:
            planted.append(passage)
    for passage in planted:
        for _ in range(3):
            head, tail = ([line(rng.choice(around)) for _ in range(rng.randrange(4))] for _ in "ab")
            rows.append((len(rows), "\n".join(head + passage + tail)))
    want = must_go(rows)
    assert len(want) >= 2 * sum(map(len, planted)) and removed(spark, rows) == want


def test_no_repeated_run_is_missed(spark):
    """Few different lines, so that runs overlap, repeat in one document and meet lines of other places."""
    rng = random.Random(7)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.choice([0, 1, 4, 9, 11, 12, 18, 30]))) for k in range(400)]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(3, 14))] for _ in range(25)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.4 else [rng.choice(pool)] for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(x for p in parts for x in p)))
    gone = marked_removed(spark, rows)
    assert must_go(rows) and must_go(rows) <= gone
    # and what goes stands at an earlier place, line by line
    first = {}
    for i, t in rows:
        for p, x in enumerate(t.split("\n")):
            first.setdefault(x, (i, p))
    assert all(first[dict(rows)[i].split("\n")[p]] < (i, p) for i, p in gone)


def marked_removed(spark, rows):
    """As ``removed`` where lines repeat within a document: the places come from the pieces."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame(rows, "id long, text string").withColumn("__th", F.xxhash64("text"))
    lines, gone = {i: t.split("\n") for i, t in rows}, set()
    for r in line_dedup.removable_pieces(base, "id", "text").collect():
        for p in r["places"]:
            assert "\n".join(lines[r["g_id"]][p["first"]:p["first"] + p["n"]]) == p["piece"]
            gone |= {(r["g_id"], p["first"] + k) for k in range(p["n"])}
    return gone


def test_random_documents_against_sql(spark):
    rng = random.Random(11)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.choice([0, 1, 4, 9, 11, 12, 18, 30]))) for k in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(120)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.execute(line_dedup.DIGEST_SQL).fetchall())
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == want


def test_a_hot_line_is_broadcast_and_salted(spark, monkeypatch):
    """Keys above the bound take the broadcast, pieces above the salt are sent several times: the same result."""
    rows = [(i, "\n".join([f"own line {i}", *passage(0), f"end {i}"])) for i in range(60)] + corpus_after(1000)
    run = lambda: sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    plain = run()
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 1)
    assert run() == plain
    monkeypatch.setattr(line_dedup, "SALT_ROWS", 7)
    assert run() == plain and sum(r[3] for r in plain) >= 59 * 3


def corpus_after(n):
    return [(n + i, t) for i, t in corpus()]


def test_edge_rows(edge_docs, no_docs):
    docs = edge_docs.withColumnRenamed("n_words", "n_lines")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_lines", "n_removed"]
    rows = {(r["doc_id"]): r for r in out.collect()}
    assert out.count() == edge_docs.count() and rows[2]["text"] is None and rows[2]["n_lines"] == 0
    assert rows[3]["text"] == "" and rows[10]["n_lines"] == 4 and rows[10]["n_removed"] == 0
    assert rows[6]["n_removed"] == 0 and rows[None]["n_removed"] == 0
    assert dedup_lines(no_docs).count() == 0


def test_columns_named_like_those_of_the_joins(spark):
    """Whatever the caller's other columns are called, they pass through."""
    from pyspark.sql import functions as F

    passage = "\n".join(f"a line of words that stands in two documents and has number {k} of them all" for k in range(8))
    docs = spark.createDataFrame([(1, passage), (2, "own line\n" + passage), (3, None)], "doc_id long, text string")
    extra = ["wanted", "w_id", "w_th", "__th", "g_id", "g_th", "places", "__lines", "__gone", "__left", "__result", "first", "in0", "id", "key"]
    plain = sorted(map(tuple, dedup_lines(docs).collect()))
    out = dedup_lines(docs.select(*[F.lit(c).alias(c) for c in extra], "doc_id", "text"))
    assert out.columns == [*extra, "doc_id", "text", "n_lines", "n_removed"]
    assert sorted(tuple(r)[len(extra):] for r in out.collect()) == plain
    assert all(tuple(r)[:len(extra)] == tuple(extra) for r in out.collect())
    assert [r[3] for r in plain] == [0, 8, 0]
