"""Connected components of an edge table, for graphs with hubs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from affinis.session import materialise, scratch_path


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a table, with their number and a checksum that does not depend on order."""
    spark, path, seen = edges.sparkSession, scratch_path(edges.sparkSession, "edges"), Observation()
    key = F.xxhash64("u", "v").cast("decimal(38,0)")
    edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(key).alias("sum")).write.parquet(path)
    return spark.read.schema("u long, v long").parquet(path), (seen.get["n"], seen.get["sum"])


def _hooked(edges: DataFrame) -> DataFrame:
    """``edges`` with the smallest ``v`` of each ``u`` as ``m``. A join instead of a window: the rows of
    a hub are not gathered in one task. The minima are written down, since Spark splits a skewed partition
    only where nothing is aggregated in the stage of the join."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``; a component is named by its smallest node.

    Large stars and small stars in turn: nodes are hung on the smallest neighbour until only stars
    are left, which takes a number of rounds logarithmic in the longest path. Each round is a table in
    the shared folder. Loops and repeated edges do no harm; edges with a null end are left out.
    """
    edges = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    current, before = _written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _hooked(both)
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        small = _hooked(large)
        small = small.select("v", "m").where("v <> m").toDF("u", "v").unionByName(small.select("u", "m").toDF("u", "v"))
        current, after = _written(small.distinct())
        if after == before:
            break
        before = after
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
