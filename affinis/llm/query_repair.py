"""Operator 13 over ``conversations``, damaged by a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.registry import query, table
from affinis.llm.repair import edits, pieces, placed, repaired_digests, report

NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes


def damaged(conversations: DataFrame) -> DataFrame:
    """Of twenty rows, by a checksum of conversation and turn: one goes, one loses its text, one its sentence
    ends, one comes twice, one gets the role ``user``."""
    said = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), lot.alias("lot"))
    rows = rows.where("lot <> 0").withColumns(
        {
            "text": F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("lot") == 4, "user").otherwise(F.col("role")),
        }
    )
    copies = F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def repaired(conversations: DataFrame, broken: DataFrame) -> DataFrame:
    """The report on every conversation of ``conversations``, of which ``broken`` are the rows."""
    rows = placed(broken)
    cut = pieces(rows)
    done = edits(cut)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    digests = repaired_digests(rows, done).withColumnRenamed("conv", "c2")
    given = conversations.select("conv_id").distinct()
    found = given.join(report(rows, cut, done).withColumnRenamed("conv", "c1"), F.col("conv_id").eqNullSafe(F.col("c1")), "left")
    found = found.join(digests, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    return found.select(
        "conv_id",
        *(F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"),
    )


@query("op13_repair")
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(given, damaged(given))
