"""Web pages as a table: landed HTML in, header, messages and subscriber counts out."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions import constants as C
from affinis.functions import html
from affinis.functions.handles import subscriber_count

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    reader = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def parse_pages(
    pages: DataFrame,
    key: str,
    header_class: str = C.HEADER_CLASS,
    message_class: str = C.MESSAGE_CLASS,
    extra_class: str = C.EXTRA_CLASS,
) -> DataFrame:
    """``(key, header, messages, extra, error)`` per page; ``error`` says why a page could not be read.

    Pages that name none of the classes skip the parser; they have no header and no messages.
    """
    schema = T.StructType(
        [
            pages.schema[key],
            T.StructField("header", T.StringType()),
            T.StructField("messages", T.ArrayType(T.StringType())),
            T.StructField("extra", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )
    named = F.lit(False)
    for name in {header_class, message_class, extra_class}:
        named = named | F.col("html").contains(name)
    task = partial(
        html.parse_batches, header_class=header_class, message_class=message_class,
        extra_class=extra_class,
    )
    reduced = pages.select(key, F.when(named, F.col("html")).otherwise("").alias("html"))
    return reduced.mapInArrow(task, schema)


def page_texts(parsed: DataFrame, key: str) -> DataFrame:
    """Messages of a page in order, then its header: ``(key, pos, text)``."""
    texts = F.concat("messages", F.array(F.coalesce("header", F.lit(""))))
    return parsed.select(key, F.posexplode(texts).alias("pos", "text"))


def subscribers(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(key, subscriber_count(F.col("extra")).alias("subscribers"))


def flat_elements(html_text: Column, tag: str) -> Column:
    """Texts of elements without inner tags, as an expression; scripts and styles are cut first."""
    body = F.regexp_replace(html_text, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    return F.regexp_extract_all(body, F.lit(rf"<{tag}(?: [^<>]*)?>([^<>]*)</{tag}>"), F.lit(1))
