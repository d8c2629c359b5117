"""The corpus pipeline: classify, deduplicate exactly and nearly, mix, tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelmill.llm.bpe_automaton import round_trip
from pixelmill.llm.exact_dedup import drop_copies
from pixelmill.llm.mixing import sampled_documents
from pixelmill.llm.near_dedup import drop_near_copies
from pixelmill.llm.quality_cnn import drop_rejected
from pixelmill.llm.queries import table, tokenizer_file
from pixelmill.session import work_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, trained on the labels, scores below 0.7 go."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return drop_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, of similarity 0.8 or more, the smallest doc_id stays."""
    return drop_near_copies(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that tokens meet the standard shares of sources, languages and topics."""
    return sampled_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the encoded and decoded text of what is left."""
    return round_trip(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: A trained network and MinHash are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
