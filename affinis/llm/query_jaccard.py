"""Operator 5 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affinis.llm.jaccard import similarity_classes
from affinis.llm.registry import query, table


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies and number of links of every document."""
    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
