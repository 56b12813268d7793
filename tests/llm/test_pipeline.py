import corpus_pipeline
from wren.llm.queries import ORACLE_SQL, QUERIES

from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input: the decisions take effect and nothing else changes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "decontaminate", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        a, b = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in docs.collect()}
        assert set(b) <= set(a) and docs.count() == len(b)
        if name != "bpe":
            assert docs.columns == columns
        if name in ("quality_classifier", "jaccard_join", "decontaminate"):
            assert all(a[i] == b[i] for i in b)
        if name == "line_dedup":
            for i, r in b.items():
                assert set(r["text"].split("\n")) <= set(a[i]["text"].split("\n")) and r["n_chars"] == len(r["text"])
        if name == "jaccard_join":
            texts = [(i, r["text"]) for i, r in sorted(a.items())]
            assert set(b) == {i for i, (n, c) in groups(texts, 5, 80, 100).items() if c == i}
        if name == "decontaminate":
            assert set(b) == {i for i, r in a.items() if not contaminated(r["text"], items)[4]}
        if name == "bpe":
            assert set(a) == set(b) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in b.values())


def test_registered_queries():
    import __spark_entry__

    numbers = {int(q[2:].split("_")[0]) for q in QUERIES}
    assert numbers == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_empty_and_odd_documents(spark, edge_docs, tmp_path):
    docs = edge_docs.withColumnRenamed("n_words", "n_chars")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"odd{k}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0
    empty = edge_docs.withColumnRenamed("n_words", "n_chars").where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
