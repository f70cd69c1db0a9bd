"""op2: token ids of every document, written to sorted string tables and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm import sstable
from orrery.sources.tables import table

NAME = "op2_sstable"
TOKENIZER = "word_bpe_49k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_tables(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return sstable.read_tables(manifest)
