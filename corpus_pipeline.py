"""Training-corpus pipeline: language ID, exact dedup, near-dedup, decontamination, BPE encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.bpe import bpe_digests
from factloom.llm.decontamination import decontaminate
from factloom.llm.exact_dedup import exact_dedup
from factloom.llm.language import known_language
from factloom.llm.shared import stored, table
from factloom.llm.simhash import near_dedup

VOCABULARY = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null and empty texts and those without a letter go.

    Where no document of the input carries a language, nothing is learned and every text with a letter stays.
    """
    return known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (null and empty ones are one group), the one with the smallest id; of repeated rows one."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id; null, empty and wordless texts are one component."""
    return near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and an empty benchmark keeps all."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of ids and decoded text, of each document that is left; a null text counts as empty, repeated rows give a row each."""
    return bpe_digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", encode_stage),
]

# Fingerprint links, tiling and encoding are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
