"""Channel metadata, stored vectors, and the sinks for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANNELS = T.StructType(
    [
        T.StructField("channel_id", T.LongType(), False),
        T.StructField("link", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("about", T.StringType()),
    ]
)


def read_channels(spark: SparkSession, path: str, schema: T.StructType = CHANNELS) -> DataFrame:
    return spark.read.schema(schema).options(
        header=True, quote='"', escape='"', multiLine=True, enforceSchema=False
    ).csv(path)


def write_embeddings(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(channel_id, embedding)``: the key replaces the position of a row in an array file."""
    kind = vectors.schema["embedding"].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError("embedding must be an array of numbers")
    vectors.select("channel_id", F.col("embedding").cast("array<double>").alias("embedding")).write.mode(
        mode
    ).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("channel_id", "embedding")


def duplicate_ids(vectors: DataFrame, key: str = "channel_id") -> DataFrame:
    """Ids that occur more than once; similarity operators need this to be empty."""
    return vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_sparse(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sparse matrix in long form ``(doc_id, term, weight)``."""
    rows.select("doc_id", "term", "weight").write.mode(mode).parquet(path)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", "term", "weight")


def embedded_channels(meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """Metadata of the channels that have a vector."""
    return meta.join(vectors.select("channel_id"), "channel_id", "left_semi")


def missing_metadata(meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors without metadata: they can be neither named nor returned."""
    return vectors.select("channel_id").join(meta.select("channel_id"), "channel_id", "left_anti")


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``; combined on the map side, so hot keys are cheap."""
    others = [c for c in rows.columns if c != key]
    picked = F.max_by(F.struct(*others), F.struct(*order)).alias("row")
    return rows.groupBy(key).agg(picked).select(key, *[F.col(f"row.{c}") for c in others])


def handle_index(meta: DataFrame) -> DataFrame:
    """``(handle, channel_id)``, one channel per handle; the later id wins."""
    by_id = latest_by(meta.select("channel_id", "link"), "channel_id", ["link"])
    handles = by_id.select(F.col("link").alias("handle"), "channel_id")
    return handles.groupBy("handle").agg(F.max("channel_id").alias("channel_id"))
