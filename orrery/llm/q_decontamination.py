"""op8: words of every document inside benchmark windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import decontamination
from orrery.sources.tables import table

NAME = "op8_wu_manber"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    f = decontamination.with_hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found.*")
    return f.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words_sql(col: str) -> str:
    return rf"coalesce(regexp_extract_all({LOWER.format(col)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


def hits_sql(docs: str) -> str:
    """CTEs up to ``hits`` (rid, n_hit, items): rid numbers the rows of the relation."""
    return rf"""
dw AS (SELECT rid, {words_sql('text')} AS w FROM {docs}),
bw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words_sql('text')} AS w FROM benchmark),
bwin AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item, w, least(len(w), {decontamination.WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {decontamination.WINDOW}) + 2)) AS i FROM bw WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bwin),
dwin AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m)),
hit AS (SELECT rid, dwin.m, i, item FROM dwin JOIN bwin ON dwin.m = bwin.m AND dwin.g = bwin.g),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, m, i FROM hit)) GROUP BY rid),
its AS (SELECT rid, list(item ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid),
hits AS (SELECT dw.rid, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items, []) AS items FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid))"""


SQL = f"""WITH docs0 AS (SELECT row_number() OVER () AS rid, * FROM documents), {hits_sql('docs0')}
SELECT doc_id, n_words::BIGINT AS n_words, n_hit::BIGINT AS n_hit, len(items)::BIGINT AS n_items, sha256(array_to_string(items, ',')) AS items_sha256, n_hit > 0 AS contaminated FROM docs0 JOIN hits USING (rid)"""
