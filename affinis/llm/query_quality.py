"""Operator 3 over ``documents``, with labels from ``labels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.quality import fit, score
from affinis.llm.registry import query, table

ACCEPTED = 0.3


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels, ~held_out()))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= ACCEPTED).cast("int").alias("predicted"),
    )
