"""op6: words of every document that the mix takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import mixing
from orrery.sources.tables import table

NAME = "op6_fair_queueing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def mix_sql(docs: str) -> str:
    """CTEs up to ``mixed`` (doc_id, source, size, source_size, target, copies) over a relation of documents."""
    return rf"""
d AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(doc_id::VARCHAR, '') || '#{mixing.SEED}') AS hk FROM {docs}),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
wgt AS (SELECT *, (((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1)::DOUBLE AS w, ({mixing.REPEATS} * source_size)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM src),
lev AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l0 FROM wgt),
goal AS (SELECT source, source_size, least(coalesce(max(CASE WHEN l0 * w <= cap THEN l0 END) OVER () * w, cap), cap) AS target FROM lev),
q AS (SELECT d.*, source_size, target, row_number() OVER () AS rid, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY hk, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source),
copies AS (SELECT rid, size, (p * source_size + before + size)::DOUBLE / target AS finish, source FROM q, range({mixing.REPEATS}) r(p) WHERE size > 0 AND target > 0),
queue AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM copies),
n AS (SELECT rid, count(*) AS copies FROM queue WHERE total <= (SELECT sum(size) FROM d) GROUP BY rid),
mixed AS (SELECT q.*, coalesce(copies, 0) AS copies FROM q LEFT JOIN n USING (rid))"""


SQL = f"WITH {mix_sql('documents')} SELECT doc_id, size::BIGINT AS size, source_size, round(target, 4) AS target, (copies * size)::BIGINT AS taken FROM mixed"
