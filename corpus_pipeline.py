"""Corpus preparation: language, exact copies, near copies, mixture, training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm.exact_dedup import exact_groups, without_dropped
from wayfold.llm.jaccard_join import near_groups, without_copies
from wayfold.llm.language import without_unidentified
from wayfold.llm.mixing import apply_mix, mix_to_targets
from wayfold.llm.packing import pack_sequences
from wayfold.llm.queries import DOMAIN_TARGETS, labelled_domains, tokenizer_path
from wayfold.runtime import spool

# SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language (no text or no letter)."""
    return without_unidentified(docs, docs, "doc_id", "text", "lang")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return without_dropped(docs, exact_groups(docs, "doc_id", "text"), "doc_id", "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the document with the smallest id stays."""
    return without_copies(docs, near_groups(docs, "doc_id", "text"), "doc_id")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: fewer poor and toxic tokens, in their place a few good documents twice."""
    labelled = labelled_domains(spark, sf_dir).withColumnRenamed("poi_id", "doc_id")
    return apply_mix(docs, mix_to_targets(docs, labelled, DOMAIN_TARGETS, "doc_id", "text", relative=True), "doc_id", "text")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in training sequences; a document drawn twice has its pieces twice."""
    return pack_sequences(docs, tokenizer_path(), "doc_id", "text")


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir))
    return docs
