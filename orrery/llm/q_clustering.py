"""op12: cluster of every usable vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import clustering as c
from orrery.sources.tables import table

NAME = "op12_delta_lloyd"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = c.delta_lloyd(table(spark, sf_dir, "embeddings"))
    return c.with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds() -> str:
    out = []
    for i in range(c.ROUNDS + 1):
        out.append(f"""
a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(kept.v) AS v,
    min(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {c.CENTROIDS} + k) AS m
  FROM kept, c{i} GROUP BY rid)""")
        if i < c.ROUNDS:
            out.append(f"""
s{i} AS (SELECT k, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT m % {c.CENTROIDS} AS k, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(w, v) AS v FROM c{i} LEFT JOIN (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS w FROM s{i} GROUP BY k) USING (k))""")
    return ",".join(out)


# The plain algorithm: every vector against every centroid in every round.
SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: floor(greatest(least({c.SCALE} * x::DOUBLE, {c.LARGEST}), -{c.LARGEST}))::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {c.DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('{c.SEED}:' || coalesce(vec_id::VARCHAR, '')), vec_id NULLS FIRST, v) - 1 AS k, v FROM kept) WHERE k < {c.CENTROIDS}),{_rounds()},
r AS (SELECT vec_id, (m % {c.CENTROIDS})::INTEGER AS cluster, (m // {c.CENTROIDS})::BIGINT AS distance FROM a{c.ROUNDS})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256
FROM r JOIN c{c.ROUNDS} ON k = cluster
"""
