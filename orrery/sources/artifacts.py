"""Run artifacts: partitioned Parquet tables, run keys in paths, JSON documents, CSV reports."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery import schemas
from orrery.functions.kernels import Kernel
from orrery.operators.svdd import Description


def run_key_columns(path: Column) -> dict[str, Column]:
    """kernel/dataset/source_to_target/prep, or without the kernel (then linear); anything else is null."""
    parts = F.split(path, "/")
    n = F.size(parts)
    at = lambda k: F.when(n.isin(3, 4), F.element_at(parts, k))
    scenario = at(-2)
    ends = F.split(scenario, "_to_")
    number = lambda k: F.when(F.size(ends) == 2, F.element_at(ends, k).try_cast("int"))
    return {
        "kernel": F.when(n == 4, F.element_at(parts, 1)).when(n == 3, F.lit("linear")),
        "dataset": at(-3),
        "scenario_id": scenario,
        "source_rpm": number(1),
        "target_rpm": number(2),
        "preprocessing": at(-1),
    }


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Unreadable part files are skipped, as a damaged artifact must not stop an evaluation; without ``schema`` one part must be sound for its columns to be found."""
    r = spark.read.option("ignoreCorruptFiles", "true")
    return (r.schema(schema) if schema else r).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Run metrics kept as one JSON document per line or file; damaged documents are left out."""
    schema = f"{schemas.RUN_METRICS}, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def skipped_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``file, damaged, whole``: metrics files with damaged documents, and how many of each they hold."""
    schema = f"{schemas.RUN_METRICS}, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("_corrupt_record").alias("damaged"), F.count("dataset").alias("whole")).filter("damaged > 0")


def skipped_parts(spark: SparkSession, path: str) -> DataFrame:
    """``file``: Parquet files below ``path`` of which no row could be read. File names alone are listed, no contents."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    read = read_partitioned(spark, path, "_ int").select(F.col("_metadata.file_path").alias("file")).distinct()
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")  # noqa: E731 - the two sources spell schemes differently
    return there.select(bare(F.col("path")).alias("file")).join(read.select(F.regexp_replace(F.url_decode(F.regexp_replace(bare(F.col("file")), r"\+", "%2B")), "^/*", "/").alias("file")), "file", "left_anti")


def report_skipped(spark: SparkSession, metrics: str | None, parts: str) -> list[str]:
    """A message for each damaged artifact that the readers pass over."""
    found = [r.file for r in skipped_parts(spark, parts).collect()] + ([r.file for r in skipped_metrics(spark, metrics).collect()] if metrics else [])
    for f in sorted(found):
        logging.warning("skipped %s: it can't be read", f)
    return sorted(found)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def zone_rows(docs: DataFrame, column: str = "zone_json", keep: list[str] | None = None) -> DataFrame:
    """One row per (combination, group) of zone documents held as JSON text; absent numbers are null."""
    parsed = docs.withColumn("_z", F.from_json(F.col(column), schemas.ZONE_JSON))
    combos = parsed.select(*(keep or []), F.explode("_z.zone_combinations").alias("z"))
    groups = combos.select(*(keep or []), "z.r_inner_percentile", "z.r_outer_percentile", "z.r_inner", "z.r_outer", F.explode("z.by_group").alias("grp", "g"))
    return groups.select(*(keep or []), "r_inner_percentile", "r_outer_percentile", "r_inner", "r_outer", "grp", "g.*")


def write_report(df: DataFrame, path: str, decimals: int | None = 6) -> None:
    """A CSV report with header; doubles are rounded unless ``decimals`` is None."""
    cols = [F.round(c, decimals).alias(c) if t in ("double", "float") and decimals is not None else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def save_model(models: DataFrame, vectors: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(f"{path}/models")
    vectors.write.mode("overwrite").parquet(f"{path}/support_vectors")


def _run(df: DataFrame, scenario_id: str, prep: str | None) -> DataFrame:
    mine = df.filter(F.col("scenario_id") == scenario_id)
    return mine if prep is None else mine.filter(F.col("prep") == prep)


def load_kernel(models: DataFrame, scenario_id: str, prep: str | None = None) -> Kernel:
    """The kernel of a stored model."""
    r = _run(models, scenario_id, prep).select("kernel", "gamma", "coef0", "degree").first()
    if r is None:
        raise KeyError(scenario_id)
    return Kernel(r.kernel, r.gamma, r.coef0, r.degree)


def load_description(spark: SparkSession, path: str, scenario_id: str, prep: str | None = None) -> Description:
    """One stored model ready to score: its kernel and vectors (bounded by the solver's buffer) and the numbers that go with them. ``prep`` is needed
    where the scenario has several preprocessings."""
    models, vectors = load_model(spark, path)
    kernel, m = load_kernel(models, scenario_id, prep), _run(models, scenario_id, prep).first()
    rows = _run(vectors, scenario_id, prep).orderBy("sv_idx").select("alpha", "x").collect()
    x, alpha = np.array([r.x for r in rows], float), np.array([r.alpha for r in rows], float)
    return Description(kernel, m.c, x, alpha, kernel.matrix(x, x) @ alpha, kernel.diag(x), r2=m.r2, tier=m.tier, norm2=m.center_norm_sq)


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(schemas.MODELS).parquet(f"{path}/models"), spark.read.schema(schemas.SUPPORT_VECTORS).parquet(f"{path}/support_vectors")
