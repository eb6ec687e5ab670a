"""Vector functions: pure expressions and JVM-side feature transformers."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_WIDTH = 64


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column, length: Column) -> Column:
    """Scale to unit length; a zero vector stays zero. ``length`` is the vector's norm."""
    return F.transform(
        v, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x.cast("double") / length)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def mean_vector(vec: Column) -> Column:
    """Element-wise mean as an aggregate: partial sums per map task, one vector per group."""
    return Summarizer.mean(array_to_vector(vec))


def as_array(vec: Column) -> Column:
    return vector_to_array(vec)


def hash_bucket(token: Column, width: int = HASH_WIDTH) -> Column:
    """Bucket of a token from the first 32 bits of its md5: the same in every engine."""
    bits = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
    return F.pmod(bits, F.lit(width))


def hashed_vectors(df: DataFrame, tokens: str, out: str, width: int = HASH_WIDTH) -> DataFrame:
    """Add ``out``: the unit-length hashed bag of words of the array column ``tokens``.

    Counting runs in the JVM with one fixed vocabulary (the bucket names), so there is no
    explode, no shuffle and no Python on the way from text to vector.
    """
    names = df.withColumn(
        "_buckets", F.transform(tokens, lambda t: hash_bucket(t, width).cast("string"))
    )
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(width)], inputCol="_buckets", outputCol="_counts"
    )
    unit = Normalizer(p=2.0, inputCol="_counts", outputCol=out)
    return unit.transform(counter.transform(names)).drop("_buckets", "_counts")


def sparse_parts(vec: Column) -> Column:
    """``(idx, val)`` arrays of a sparse vector column."""
    raw = F.unwrap_udt(vec)
    return F.struct(raw["indices"].alias("idx"), raw["values"].alias("val"))
