"""op1: pairs of documents that share fuzzy passages, with the passages' places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import chaining
from orrery.sources.tables import table

NAME = "op1_chaining"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.pairs(table(spark, sf_dir, "documents"))
