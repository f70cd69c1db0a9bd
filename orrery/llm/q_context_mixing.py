"""op3: scores of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import context_mixing
from orrery.sources.tables import table

NAME = "op3_context_mixing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(table(spark, sf_dir, "documents"))
