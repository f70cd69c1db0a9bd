"""op11: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import toxicity
from orrery.llm.language import held_out
from orrery.sources.tables import table

NAME = "op11_levenshtein_lexicon"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out(F.col("doc_id")))
    scored = toxicity.with_score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.PREDICT_AT).cast("int").alias("predicted"))
