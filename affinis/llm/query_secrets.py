"""Operator 4 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.registry import query, table
from affinis.llm.secret_scan import BASE_KINDS, find_secrets
from affinis.llm.spans import digests


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *digests(F.col("secrets"), BASE_KINDS))
