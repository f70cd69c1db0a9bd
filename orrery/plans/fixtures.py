"""Mapping of the test tables to signals, vectors, scored runs and decision streams (a test convention)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orrery.operators.scoring import center_model, predict_distance, with_distance
from orrery.sources.signals import NORMAL_EVENTS, signals_from_events
from orrery.sources.tables import table

DIM = 64
WINDOW = 16
SHRINK = 0.99  # of R, so that both predictions occur
RHO = (0.98, 1.0)
KEY = ["kernel", "dataset", "scenario_id", "source", "target", "prep"]


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), n).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return signals_from_events(table(spark, sf, "events"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"), "label")


def source_train(v: DataFrame) -> DataFrame:
    return v.filter((F.col("label") < 5) & (F.col("vec_id") % 2 == 0))


def target_normal(v: DataFrame) -> DataFrame:
    return v.filter((F.col("label") < 5) & (F.col("vec_id") % 2 == 1))


def group_name() -> F.Column:
    return F.when(F.col("label") >= 5, "target_fault").when(F.col("vec_id") % 2 == 0, "source_train").otherwise("target_normal")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    d = with_distance(v, center_model(source_train(v), DIM))
    return d.select(
        "vec_id", "label", F.lit("linear").alias("kernel"),
        F.when(F.floor(F.col("vec_id") / 2) % 2 == 0, "alpha").otherwise("beta").alias("dataset"),
        F.lit("1_to_2").alias("scenario_id"), F.lit("A").alias("source"), F.lit("B").alias("target"),
        F.concat(F.lit("p"), (F.floor(F.col("vec_id") / 4) % 3).cast("string")).alias("prep"),
        group_name().alias("grp"), (F.col("label") >= 5).cast("int").alias("y_true"), "d", "d2", "r", "r2",
        F.round("d", 6).alias("score"), predict_distance(F.round("d", 9), F.round(F.col("r") * SHRINK, 9)).alias("y_pred"),
    )


def stream(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    y = (~F.col("event_type").isin(NORMAL_EVENTS)).cast("int")
    w = Window.partitionBy("scenario_id").orderBy("y_true", F.when(F.col("y_true") == 1, F.col("event_type")), "ts", "event_id")
    rows = e.withColumn("y_true", y).withColumn("scenario_id", F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")))
    v = F.col("value")
    return rows.select(
        "scenario_id", "event_type", "y_true", (F.row_number().over(w) - 1).cast("long").alias("stream_pos"),
        F.when(v < 5, 0).when(v < 20, 1).otherwise(2).alias("decision"), (F.lit(20.0) - v).alias("score"),
        (F.lit(1.0) + v / 100).alias("r_trace"), (v / 1000).alias("latency_s"), F.lit(1.0).alias("r_pretrain"), F.lit(1.25).alias("r_final"),
    )
