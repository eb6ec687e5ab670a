"""Operator 11 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affinis.llm.mixing import mix
from affinis.llm.registry import query, table

WEIGHTS = (5, 2, 1)

SQL = r"""
  WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           CAST('0x' || substr(md5('mix:' || doc_id), 1, 15) AS BIGINT) AS draw
    FROM documents),
  s AS (
    SELECT source, CAST(sum(size) AS HUGEINT) AS source_size,
           [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM d GROUP BY source),
  -- levels: halves of words; sources stop at 4 halves a word, 3 halves a word are shared
  l AS (
    SELECT *, 4 * source_size AS most, sum(3 * source_size) OVER () AS everything,
           coalesce(sum(4 * source_size) OVER earlier, 0) AS before,
           sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights_left
    FROM s WINDOW earlier AS (ORDER BY source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c AS (SELECT *, most * weights_left <= weight * (everything - before) AS stops FROM l),
  o AS (
    SELECT source, source_size,
           CASE WHEN stops THEN most ELSE weight * (everything - coalesce(sum(most) FILTER (stops) OVER (), 0)) END AS above,
           CASE WHEN stops THEN 2 ELSE 2 * sum(weight) FILTER (NOT stops) OVER () END AS below
    FROM c),
  b AS (SELECT source, source_size, CAST(above AS DOUBLE) / CAST(below AS DOUBLE) AS target, above // below AS budget FROM o),
  p AS (
    SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
           sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id) - d.size AS before
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
  SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
         CAST(CASE WHEN size = 0 THEN 0 ELSE budget // source_size * size
              + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
  FROM p"""


@query("op11_mixing", SQL)
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")
