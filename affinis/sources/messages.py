"""Message tables: typed scans, filters that belong to the scan, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions import constants as C
from affinis.functions.text import computed, drop_links, is_recent, words

KEY_COLUMNS = [
    "message_id", "channel_id", "views", "forwards", "replies_cnt",
    "fwd_from_channel_id", "fwd_from_message_id",
]
MESSAGES = T.StructType(
    [
        T.StructField("message_id", T.LongType(), False),
        T.StructField("channel_id", T.LongType(), False),
        T.StructField("views", T.IntegerType()),
        T.StructField("forwards", T.IntegerType()),
        T.StructField("replies_cnt", T.IntegerType()),
        T.StructField("fwd_from_channel_id", T.LongType()),
        T.StructField("fwd_from_message_id", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
# Quotes are doubled, blanks are data, and an empty text is not a missing one.
CSV_WRITE = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
CSV_READ = {"header": True, "quote": '"', "escape": '"', "enforceSchema": False}


def read_messages(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: T.StructType | None = MESSAGES,
    multiline: bool = True,
) -> DataFrame:
    """Typed scan. Columns beyond the fixed ones can be added to ``schema``.

    CSV with line breaks inside texts is read one file per task; land such data in many files,
    or once as parquet. ``multiline=False`` keeps CSV splittable when texts hold no breaks.
    """
    if format == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if format == "csv":
        reader = spark.read.options(multiLine=multiline, **CSV_READ)
        if schema is None:
            return reader.option("inferSchema", True).csv(path)
        return reader.schema(schema).csv(path)
    raise ValueError(f"unknown format {format!r}")


def write_messages(df: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    if format == "parquet":
        df.write.mode(mode).parquet(path)
    elif format == "csv":
        df.write.mode(mode).options(**CSV_WRITE).csv(path)
    else:
        raise ValueError(f"unknown format {format!r}")


def message_metadata(messages: DataFrame) -> DataFrame:
    """Keys, counters and date without the text column, which the scan then never reads."""
    return messages.select(*KEY_COLUMNS, "date")


def non_empty(messages: DataFrame) -> DataFrame:
    return messages.where("message is not null and message <> ''")


def recent(messages: DataFrame, cutoff: str = C.RECENT_AFTER) -> DataFrame:
    kind = messages.schema["date"].dataType.simpleString()
    return messages.where(is_recent(F.col("date"), kind, cutoff))


def first_rows(messages: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in ``order``; -1 means all. Comes before any filter."""
    return messages if n == -1 else messages.orderBy(*order).limit(n)


def scan_messages(
    messages: DataFrame,
    max_rows: int = -1,
    filter_by_date: bool = True,
    cutoff: str = C.RECENT_AFTER,
    order: tuple[str, ...] = ("channel_id", "message_id"),
) -> DataFrame:
    """``(message_id, channel_id, message)`` of recent, non-empty messages, by column name."""
    rows = first_rows(messages.select("message_id", "channel_id", "date", "message"), max_rows, order)
    if filter_by_date:
        rows = recent(rows, cutoff)
    return non_empty(rows).select(
        F.col("message_id").cast("bigint"), F.col("channel_id").cast("bigint"), "message"
    )


def messages_per_channel(messages: DataFrame) -> DataFrame:
    return messages.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n_messages"))


def long_messages(messages: DataFrame, min_words: int = C.LONG_MESSAGE_WORDS) -> DataFrame:
    """Messages with more than ``min_words`` words once links are gone; adds ``n_words``."""
    n_words = F.size(words(drop_links(F.col("message"))))
    return computed(messages, "n_words", n_words).where(F.col("n_words") > min_words)
