"""op13: damaged conversations, what is wrong with each, and its cheapest repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import conversations as c
from orrery.sources.tables import table

NAME = "op13_retained_turns"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.repair(c.damage(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", *c.STATS, "cost", "audit", "repaired_sha256")
