import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wren.llm.merkle import FIELDS, fold, manifest, proof_report


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    parts = [None if v is None else str(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in parts))


def climb(nodes):
    """Levels of a list of digests up to the one that remains, and each place's siblings (left, right) level by level."""
    places, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf, at in enumerate(places):
            run = nodes[at // 8 * 8:at // 8 * 8 + 8]
            paths[leaf].append((run[:at % 8], run[at % 8 + 1:]))
            places[leaf] = at // 8
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    parts = defaultdict(list)
    for r in rows:
        parts[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    built = {p: climb([x[2] for x in sorted(parts[p], key=lambda x: x[:3])]) for p in names}
    root, tops = climb([built[p][0] for p in names]) if names else (None, [])
    out = []
    for p, top in zip(names, tops):
        for (_, _, leaf, r), path in zip(sorted(parts[p], key=lambda x: x[:3]), built[p][1]):
            text, path = r["text"], path + top
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h = leaf_of(r, text)
            for left, right in path:
                h = sha("".join([*left, h, *right]))
            out.append((r["doc_id"], leaf, built[p][0], root, sha("".join("".join([*left, *right]) for left, right in path)), h, h == root))
    return sorted(out, key=str)


def check(docs):
    got = sorted(map(tuple, proof_report(docs).collect()), key=str)
    assert got == brute(docs.collect())
    return got


def test_edge_rows(edge_docs, no_docs):
    check(edge_docs.withColumnRenamed("n_words", "n_chars").withColumn("part", F.lit("clash")).withColumn("i", F.lit(1)))
    assert proof_report(no_docs.withColumnRenamed("n_words", "n_chars")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 520])
def test_every_shape_of_tree(spark, n):
    """One part of n rows (a lone leaf, full and short last runs) beside small ones and a null one."""
    rows = [(i * 7 % 1009, f"Text {i}", "en", None if i % 5 else "s", i) for i in range(n)]
    rows += [(2000 + i, "Äb" if i else None, "d" if i % 2 else None, "s", None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = check(docs)
    assert 0 < sum(r[-1] for r in got) <= len(got)


def test_many_parts(spark):
    rows = [(i, f"T{i}", f"l{i % 75}", "s", 1) for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_hot_id_and_copies(spark):
    """A third of the rows has one id; equal rows are leaves of their own."""
    rows = [(5 if i % 3 else i, "same" if i % 2 else f"T{i}", "en", "s", 1) for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4))


def test_own_fields_and_untouched_rows(spark):
    docs = spark.createDataFrame([(i, str(i), "x") for i in range(20)], "k long, v string, g string")
    made = manifest(docs, fields=["k", "v"], id_col="k", part_col="g")
    rows = made.withColumn("again", fold(F.col("leaf"), F.col("path"))).collect()
    assert len(rows) == 20 and all(r["again"] == r["root"] and r["changed_leaf"] is None for r in rows)
    assert FIELDS == ["doc_id", "source", "lang", "n_chars", "text"]
