"""Documents to token shards: language ID, near-dedup, decontamination, mixing, output.

Each stage takes the rows its predecessor kept and returns rows with the columns of ``documents`` (the last: a row per
document written). Nulls, empty texts, repeated rows and empty tables are treated as each stage's operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontamination, language, mixing, simhash, sstable
from orrery.llm.q_sstable import TOKENIZER
from orrery.sources.tables import table
from orrery.storage import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any letter go, and long ones in which the best language finds no more than in letters at random; a null lang is filled in."""
    return language.keep_identified(docs, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with ten consecutive words of a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents up to each source's target, repeated up to three times."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted string tables; a row per document as read back."""
    return sstable.read_tables(sstable.write_tables(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
ORACLE_SQL = None  # language ID and the tokenizer are beyond SQL; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
