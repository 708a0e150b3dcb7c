"""Corpus pipeline: quality rules, quality classifier, near-duplicates, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm import byte_cnn, dedup, packing, quality_rules, secrets
from factorspark.llm.common import durable, read_table
from factorspark.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality_rules.filtered(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network takes for label 1.

    It learns from the labelled texts of the whole source table that are not held out: the rules before it reject most of label 0.
    """
    source = read_table(spark, sf_dir, "documents")
    net = byte_cnn.fitted(source, read_table(spark, sf_dir, "labels"), ~byte_cnn.held_out(), judged=docs)
    return byte_cnn.filtered(docs, net)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of every group of near copies."""
    return dedup.deduplicated(docs)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and their length counted anew."""
    found = durable(secrets.candidates(docs), "pipeline-candidates")
    forest = secrets.trained(secrets.labelled(found), secrets.dictionary_of(read_table(spark, sf_dir, "benchmark")))
    clean = secrets.redacted(docs, forest)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("best_fit_packing", packing_stage),
]
#: Tokenizer, classifier, forest and near-duplicate stages have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    rows = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = durable(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
