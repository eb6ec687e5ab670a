"""Order-dependent operators that never put a whole group, or the whole table, in one task.

The rows are range-partitioned on ``keys + order`` once, so a hot key is spread over many
partitions. Each step then works inside a partition and carries one summary row per
(partition, key) across the partition borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinis.session import materialise

PART = "_part"


def ordered_parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Range-partition ``df`` and record the partition number of each row in ``_part``.

    ``order`` must end in a unique column. Range bounds come from a sample, so the numbers are
    written down: later steps must all see the same ones. Without ``partitions`` Spark sizes them.
    """
    count = [] if partitions is None else [partitions]
    ranged = df.repartitionByRange(*count, *keys, *order).withColumn(PART, F.spark_partition_id())
    return materialise(ranged, "ordered")


def _inside(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(PART, *keys).orderBy(*order)


def _earlier_parts(keys: Sequence[str]):
    # one row per (partition, key): at most the number of partitions for any single key
    return W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def _attach(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(summary, [PART, *keys], "left")


def prefix_sum(
    parts: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Running total of ``value`` per key, the current row included."""
    rows = parts.withColumn("_v", value)
    base = (
        rows.groupBy(PART, *keys)
        .agg(F.sum("_v").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(_earlier_parts(keys)), F.lit(0)))
        .drop("_sum")
    )
    local = F.sum("_v").over(_inside(keys, order).rowsBetween(W.unboundedPreceding, 0))
    joined = _attach(rows.withColumn("_local", local), base, keys)
    return joined.withColumn(out, F.col("_base") + F.col("_local")).drop("_v", "_base", "_local")


def row_numbers(parts: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position of each row within its key."""
    return prefix_sum(parts, keys, order, F.lit(1).cast("bigint"), out)


def previous_value(
    parts: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Last non-null ``value`` strictly before the row, per key."""
    rows = parts.withColumn("_v", value)
    carried = (
        rows.groupBy(PART, *keys)
        .agg(
            F.max_by(
                "_v", F.when(F.col("_v").isNotNull(), F.struct(*order))
            ).alias("_last")
        )
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(_earlier_parts(keys)))
        .drop("_last")
    )
    before = _inside(keys, order).rowsBetween(W.unboundedPreceding, -1)
    local = F.last("_v", ignorenulls=True).over(before)
    joined = _attach(rows.withColumn("_local", local), carried, keys)
    return joined.withColumn(out, F.coalesce("_local", "_carry")).drop("_v", "_carry", "_local")


def run_ids(parts: DataFrame, order: Sequence[str], key: str, out: str) -> DataFrame:
    """Number the runs of consecutive equal ``key`` in the table's order, from 1."""
    seen = previous_value(parts, [], order, F.col(key), "_prev")
    changed = F.when(F.col("_prev").eqNullSafe(F.col(key)), 0).otherwise(1).cast("bigint")
    return prefix_sum(seen, [], order, changed, out).drop("_prev")


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salts: int = 256,
) -> DataFrame:
    """First ``k`` rows of each group, exact for groups of any size.

    Each map task prunes its own rows to ``k`` per group (window group limit), ``salts``
    intermediate tasks merge those, and only ``k * salts`` rows per group reach the last step.
    The salt follows the map task, so it never weakens the map-side pruning.
    """
    rows = df
    if salts > 1:
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        first = F.row_number().over(W.partitionBy("_salt", *keys).orderBy(*order))
        rows = salted.withColumn("_r", first).where(F.col("_r") <= k).drop("_r", "_salt")
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(rank, last).where(F.col(rank) <= k)
