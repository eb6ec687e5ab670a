"""Operator 8 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.private_data import KINDS, find_private
from affinis.llm.registry import query, table
from affinis.llm.spans import digests


@query("op8_private_data")
def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *digests(F.col("private"), KINDS))
