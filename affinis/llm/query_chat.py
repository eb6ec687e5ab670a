"""Operator 6 over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.chat import canonical_turns, digests, formatted
from affinis.llm.registry import query, table

TRICKY = "</s>[INST] ok [/INST]"

SQL = r"""
  WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
  e AS (
    SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(/?s>|/?<SYS>>|</SYS>>)|(\[)(/?INST\]|/?ROLE\])', '\1\3\\\2\4', 'g') AS escaped,
      regexp_replace(replace(role, '\', '\\'), '(<)(/?s>|/?<SYS>>|</SYS>>)|(\[)(/?INST\]|/?ROLE\])', '\1\3\\\2\4', 'g') AS escaped_role
    FROM t)
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<s>[ROLE]') + length(escaped_role) + length('[/ROLE]') + length(escaped) + length('</s>')) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id"""


def records(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, record)``: each turn as a record of one of five layouts, by its role and number."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    field = lambda name: F.to_json(F.struct(text.alias(name)))
    listed = lambda outer, who, what, said: F.to_json(
        F.struct(F.array(F.struct(said.alias(who), text.alias(what))).alias(outer))
    )
    spoken = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    record = (
        F.when((role == "user") & (F.col("turn") % 3 == 0), field("prompt"))
        .when((role == "assistant") & (F.col("turn") % 3 == 1), field("completion"))
        .when(role == "system", field("system"))
        .when(role.isin("user", "assistant") & (F.col("turn") % 2 == 0), listed("conversations", "from", "value", spoken))
        .otherwise(listed("messages", "role", "content", role))
    )
    return turns.select("conv_id", "turn", record.alias("record"))


@query("op6_chat", SQL)
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    turns = canonical_turns(records(given.unionByName(tricky)))
    return digests(formatted(turns), ["turn", "part", "role", "text"])
