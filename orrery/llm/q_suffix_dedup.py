"""op5: bytes of every document covered by 50-byte strings that start in earlier documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import suffix_dedup
from orrery.sources.tables import table

NAME = "op5_induced_sorting"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("starts", "ends")
