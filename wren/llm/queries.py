"""Named queries of the training-data operators, each over its whole table.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLE_SQL`` has
the DuckDB SQL of those that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (byte_level, decontaminate, html_text, jaccard_join, line_dedup, merkle, personal_data, quality_classifier, quality_rules,
               sharding, token_alignment, url_rules)
from .bpe import token_digests

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern that cuts texts for the byte-level vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def word_vocabulary() -> str:
    """Path of the public vocabulary file that the BPE queries use."""
    return vocabulary("word_bpe_49k.json")


@query("op1_decontaminate", decontaminate.DIGEST_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), word_vocabulary())


@query("op8_quality_rules", quality_rules.DIGEST_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_digests(table(spark, sf_dir, "documents"))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


@query("op10_url_rules")
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_groups(table(spark, sf_dir, "documents"))


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data_digests(table(spark, sf_dir, "documents"))


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


@query("op5_line_dedup", line_dedup.DIGEST_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_merkle_manifest", merkle.REPORT_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_report(table(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = byte_level.from_json(vocabulary("byte_bpe_50k.json"), split_pattern())
    b = token_alignment.read_pieces(vocabulary("piece_bpe_32k.model"))
    return token_alignment.alignment_report(table(spark, sf_dir, "documents"), a, b)


@query("op13_byte_level_bpe")
def op13_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_level.token_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern())
