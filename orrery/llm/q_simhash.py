"""op10: fingerprint and component of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import simhash
from orrery.sources.tables import table

NAME = "op10_simhash"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simhash.with_components(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
