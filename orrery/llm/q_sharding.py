"""op7: shard of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import sharding
from orrery.sources.tables import table

NAME = "op7_lookup_shards"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), sharding.lookup_table(sharding.shard_names(spark)))


# Each turn: the shard's first free slot in its order.
SQL = f"""
WITH RECURSIVE p AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 4, '0') AS shard,
    ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 4, '0') || '#offset'), 1, 15))::BIGINT % {sharding.SLOTS} AS o,
    ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 4, '0') || '#skip'), 1, 15))::BIGINT % {sharding.SLOTS - 1} + 1 AS k
  FROM range({sharding.SHARDS}) r(i)),
lists AS (SELECT list(o ORDER BY i) AS o, list(k ORDER BY i) AS k FROM p),
fill(step, turn, slots, nxt) AS (
  SELECT 0, 0, list_resize([]::INTEGER[], {sharding.SLOTS}, -1), list_resize([]::BIGINT[], {sharding.SHARDS}, 0::BIGINT)
  UNION ALL
  SELECT step + 1, (turn + 1) % {sharding.SHARDS}, slots[1:c] || [turn] || slots[c + 2:], nxt[1:turn] || [j + 1] || nxt[turn + 2:]
  FROM (SELECT *, (o[turn + 1] + j * k[turn + 1]) % {sharding.SLOTS} AS c FROM (
    SELECT fill.*, lists.*, list_filter(range(nxt[turn + 1], {sharding.SLOTS}), lambda x: slots[(o[turn + 1] + x * k[turn + 1]) % {sharding.SLOTS} + 1] = -1)[1] AS j
    FROM fill, lists WHERE step < {sharding.SLOTS}))),
tab AS (SELECT unnest(slots) AS i, generate_subscripts(slots, 1) - 1 AS slot FROM fill WHERE step = {sharding.SLOTS}),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, slot, shard FROM d JOIN tab USING (slot) JOIN p USING (i)
"""
