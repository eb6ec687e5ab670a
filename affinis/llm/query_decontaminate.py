"""Operator 2: ``documents`` against ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.decontaminate import with_leaks
from affinis.llm.registry import query, table


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that leaks into it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    leak = F.explode("leaks").alias("leak")
    return found.select("doc_id", leak).select(
        "doc_id", "leak.item_id", "leak.score", F.col("leak.start").alias("start_word"), F.col("leak.end").alias("end_word")
    )
