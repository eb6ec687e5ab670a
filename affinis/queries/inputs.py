"""The given tables seen as messages, channels, requests and pages, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.session import configure

CUTOFF = "2024-01-15"
MESSAGE_CUTOFF = "2024-01-01"  # documents pair with the first events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The small tables of the queries lie in one file of one split; this gives every core a part. A
    table of more splits than a quarter of the cores stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * len(df.inputFiles()) <= cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


SOURCE_ID_SQL = "CAST(substr(source, 4) AS BIGINT)"


def source_id():
    return F.expr(SOURCE_ID_SQL)


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(channel_id, message_id, message)``: every document is a message of its source."""
    return documents(spark, sf_dir).select(
        source_id().alias("channel_id"), F.col("doc_id").alias("message_id"), F.col("text").alias("message")
    )


DOCUMENT_MESSAGES_SQL = (
    f"SELECT {SOURCE_ID_SQL} AS channel_id, doc_id AS message_id, text AS message FROM documents"
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full messages: document texts with the counters and date of the event of the same id."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), "ts", "user_id", "value", "event_type"
    )
    return documents(spark, sf_dir).join(events, "doc_id").select(
        F.col("doc_id").alias("message_id"),
        source_id().alias("channel_id"),
        F.floor("value").cast("int").alias("views"),
        F.length("event_type").cast("int").alias("forwards"),
        F.length("lang").cast("int").alias("replies_cnt"),
        F.col("user_id").alias("fwd_from_channel_id"),
        F.col("doc_id").alias("fwd_from_message_id"),
        F.col("ts").alias("date"),
        F.col("text").alias("message"),
    )


MESSAGES_SQL = f"""
  SELECT d.doc_id AS message_id, {SOURCE_ID_SQL} AS channel_id,
         CAST(floor(e.value) AS INTEGER) AS views, CAST(length(e.event_type) AS INTEGER) AS forwards,
         CAST(length(d.lang) AS INTEGER) AS replies_cnt, e.user_id AS fwd_from_channel_id,
         d.doc_id AS fwd_from_message_id, e.ts AS date, d.text AS message
  FROM documents d JOIN events e ON d.doc_id = e.event_id"""


def text_date(messages_df: DataFrame) -> DataFrame:
    """Dates as text, ``2021-10-08 05:30:10+00:00``."""
    text = F.concat(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    return messages_df.withColumn("date", text)


TEXT_DATE_SQL = "strftime(date, '%Y-%m-%d %H:%M:%S') || '+00:00'"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(channel_id, embedding)``."""
    rows = spread(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("vec_id").alias("channel_id"), "embedding")


def id_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vec)``."""
    return spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the embedded channels; every tenth handle belongs to a bot."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), "source", "lang", "text"
    )
    link = F.concat(
        F.lit("chan_"), F.col("vec_id"), F.when(F.col("vec_id") % 10 == 0, "_bot").otherwise("")
    )
    title = F.concat("source", F.lit(" "), "lang", F.lit(" "), "vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id").join(docs, "vec_id", "left").select(
        F.col("vec_id").alias("channel_id"), link.alias("link"),
        F.coalesce(title, link).alias("title"), F.coalesce("text", F.lit("")).alias("about"),
    )


CHANNELS_SQL = """
  SELECT v.vec_id AS channel_id,
         'chan_' || v.vec_id || CASE WHEN v.vec_id % 10 = 0 THEN '_bot' ELSE '' END AS link,
         coalesce(d.source || ' ' || d.lang || ' ' || v.vec_id,
                  'chan_' || v.vec_id || CASE WHEN v.vec_id % 10 = 0 THEN '_bot' ELSE '' END) AS title,
         coalesce(d.text, '') AS about
  FROM embeddings v LEFT JOIN documents d ON v.vec_id = d.doc_id"""


def source_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the message channels (one per source)."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n")
    ).select(
        source_id().alias("channel_id"), F.col("source").alias("link"),
        F.concat(F.lit("Texts of "), "source").alias("title"),
        F.concat("n", F.lit(" messages")).alias("about"),
    )


def handle_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, text)``: each channel asked for in one of four spellings, plus as many
    handles that no channel has."""
    spelled = F.when(F.col("k") == 0, F.concat(F.lit("https://t.me/"), "h")).when(
        F.col("k") == 1, F.concat(F.lit("t.me/"), "h")
    ).when(F.col("k") == 2, F.concat(F.lit("@"), "h")).otherwise(F.col("h"))
    meta = channels(spark, sf_dir)
    known = meta.select("channel_id", (F.col("channel_id") % 4).alias("k"), F.col("link").alias("h"))
    unknown = meta.select(
        (F.col("channel_id") + 10_000_000).alias("channel_id"), (F.col("channel_id") % 4).alias("k"),
        F.concat(F.lit("missing_"), "channel_id").alias("h"),
    )
    return known.unionByName(unknown).select(F.col("channel_id").alias("request_id"), spelled.alias("text"))


HANDLE_REQUESTS_SQL = f"""
  SELECT request_id, CASE k WHEN 0 THEN 'https://t.me/' || h WHEN 1 THEN 't.me/' || h
                            WHEN 2 THEN '@' || h ELSE h END AS text
  FROM (SELECT channel_id AS request_id, channel_id % 4 AS k, link AS h FROM ({CHANNELS_SQL})
        UNION ALL
        SELECT channel_id + 10000000, channel_id % 4, 'missing_' || channel_id FROM ({CHANNELS_SQL}))"""


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chat_id, request_id, ts, text)``: each event is one message of its user."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "signup", "/start").when(kind == "click", C.BY_CHANNEL)
        .when(kind == "purchase", C.BY_DESCRIPTION).when(kind == "error", C.RANDOM)
        .otherwise(F.concat(F.lit("request "), "props"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("chat_id"), F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"), text.alias("text"),
    )


def chat_requests_sql() -> str:
    return f"""
  SELECT user_id AS chat_id, event_id AS request_id, ts,
         CASE event_type WHEN 'signup' THEN '/start' WHEN 'click' THEN '{C.BY_CHANNEL}'
              WHEN 'purchase' THEN '{C.BY_DESCRIPTION}' WHEN 'error' THEN '{C.RANDOM}'
              ELSE 'request ' || props END AS text
  FROM events"""


def r6(expression: str) -> str:
    """SQL: round to six digits without a negative zero."""
    return f"(round({expression}, 6) + 0.0::DOUBLE)"


def round6(column):
    return F.round(column, 6) + F.lit(0.0)
