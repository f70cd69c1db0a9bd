"""op9: predicted language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import language
from orrery.sources.tables import table

NAME = "op9_cross_parsing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held).select("doc_id", "text", "lang")
    predict = language.predictor(learn)
    return docs.select("doc_id", held.alias("held_out"), predict(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.bits")
