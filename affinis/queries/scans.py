"""Scans, filters, sinks, grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.functions import text as tx
from affinis.operators.ordered import ordered_parts, row_numbers, run_ids
from affinis.queries import inputs as I
from affinis.queries import sql as Q
from affinis.queries.registry import query
from affinis.session import scratch_path
from affinis.sources import channels as ch
from affinis.sources import messages as ms

_FULL = f"""
SELECT message_id, channel_id, views, forwards, replies_cnt, fwd_from_channel_id,
       fwd_from_message_id, {I.TEXT_DATE_SQL} AS date, message FROM ({I.MESSAGES_SQL})"""


@query("scan_messages", _FULL)
def scan_messages(spark, sf):
    path = scratch_path(I.configure(spark), "messages-csv")
    ms.write_messages(I.text_date(I.messages(spark, sf)), path, "csv")
    return ms.read_messages(spark, path, "csv")


@query("roundtrip_messages", _FULL)
def roundtrip_messages(spark, sf):
    path = scratch_path(I.configure(spark), "messages")
    ms.write_messages(I.text_date(I.messages(spark, sf)), path)
    return ms.read_messages(spark, path)


@query(
    "scan_message_metadata",
    f"""SELECT message_id, channel_id, views, forwards, replies_cnt, fwd_from_channel_id,
        fwd_from_message_id, {I.TEXT_DATE_SQL} AS date FROM ({I.MESSAGES_SQL})""",
)
def scan_message_metadata(spark, sf):
    return ms.message_metadata(I.text_date(I.messages(spark, sf)))


_RECENT = f"date >= TIMESTAMP '{I.MESSAGE_CUTOFF}' + INTERVAL 1 DAY AND message IS NOT NULL AND message <> ''"


@query(
    "scan_recent_messages",
    f"SELECT message_id, channel_id, message FROM ({I.MESSAGES_SQL}) WHERE {_RECENT}",
)
def scan_recent_messages(spark, sf):
    return ms.scan_messages(I.messages(spark, sf), cutoff=I.MESSAGE_CUTOFF)


@query(
    "cap_then_filter",
    f"""SELECT message_id, channel_id, message FROM (
          SELECT * FROM ({I.MESSAGES_SQL}) ORDER BY channel_id, message_id LIMIT 400)
        WHERE {_RECENT}""",
)
def cap_then_filter(spark, sf):
    return ms.scan_messages(I.messages(spark, sf), max_rows=400, cutoff=I.MESSAGE_CUTOFF)


@query(
    "recent_filter",
    f"""SELECT event_id AS message_id, strftime(ts, '%Y-%m-%d') AS day FROM events
        WHERE split_part(strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00', ' ', 1) > '{I.CUTOFF}'""",
)
def recent_filter(spark, sf):
    events = I.table(spark, sf, "events").select(F.col("event_id").alias("message_id"), F.col("ts").alias("date"))
    return ms.recent(events, I.CUTOFF).select(
        "message_id", F.date_format("date", "yyyy-MM-dd").alias("day")
    )


@query(
    "messages_per_channel",
    f"SELECT channel_id, count(*) AS n_messages FROM ({I.DOCUMENT_MESSAGES_SQL}) GROUP BY channel_id",
)
def messages_per_channel(spark, sf):
    return ms.messages_per_channel(I.document_messages(spark, sf))


@query(
    "channel_groups",
    f"""SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY message_id) AS pos,
        message_id, message FROM ({I.DOCUMENT_MESSAGES_SQL})""",
)
def channel_groups(spark, sf):
    """Messages of each channel in order, one row per message: a hot channel stays spread out."""
    keys, order = ["channel_id"], ["message_id"]
    parts = ordered_parts(I.document_messages(spark, sf), keys, order)
    return row_numbers(parts, keys, order, "pos").select("channel_id", "pos", "message_id", "message")


_RUN_INPUT = "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations"


@query(
    "channel_runs",
    f"""SELECT run_id, role, count(*) AS n_messages, sum(n_chars)::BIGINT AS n_chars,
               min(conv_id) AS first_conv, max(conv_id) AS last_conv
        FROM (SELECT *, CAST(sum(changed) OVER (ORDER BY conv_id, turn) AS BIGINT) AS run_id
              FROM (SELECT *, CASE WHEN role = lag(role) OVER (ORDER BY conv_id, turn)
                                   THEN 0 ELSE 1 END::BIGINT AS changed FROM ({_RUN_INPUT})))
        GROUP BY run_id, role""",
)
def channel_runs(spark, sf):
    rows = I.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars")
    )
    order = ["conv_id", "turn"]
    runs = run_ids(ordered_parts(rows, [], order), order, "role", "run_id")
    return runs.groupBy("run_id", "role").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum("n_chars").alias("n_chars"),
        F.min("conv_id").alias("first_conv"), F.max("conv_id").alias("last_conv"),
    )


@query(
    "roundtrip_embeddings",
    f"""SELECT vec_id AS channel_id, pos, {I.r6('v')} AS value
        FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos,
                     unnest(embedding)::DOUBLE AS v FROM embeddings)""",
)
def roundtrip_embeddings(spark, sf):
    path = scratch_path(I.configure(spark), "embeddings")
    ch.write_embeddings(I.vectors(spark, sf), path)
    rows = ch.read_embeddings(spark, path).select("channel_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.select("channel_id", F.col("pos").cast("bigint").alias("pos"), I.round6(F.col("value")).alias("value"))


@query(
    "load_channels",
    f"SELECT channel_id, link, title FROM ({I.CHANNELS_SQL}) WHERE channel_id IN (SELECT vec_id FROM embeddings)",
)
def load_channels(spark, sf):
    return ch.embedded_channels(I.channels(spark, sf), I.vectors(spark, sf)).select("channel_id", "link", "title")


@query(
    "handle_lookup",
    f"""SELECT l.link AS handle, max(l.channel_id) AS channel_id FROM (
          SELECT source || '_' || lang AS link, doc_id AS channel_id FROM documents) l GROUP BY l.link""",
)
def handle_lookup(spark, sf):
    """Handles shared by several ids: the later id wins."""
    meta = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("channel_id"), F.concat_ws("_", "source", "lang").alias("link")
    )
    return ch.handle_index(meta)


_FIRST = f"SELECT DISTINCT channel_id FROM ({I.DOCUMENT_MESSAGES_SQL}) ORDER BY channel_id LIMIT 10"


@query(
    "limit_channels",
    f"SELECT channel_id, message_id FROM ({I.DOCUMENT_MESSAGES_SQL}) WHERE channel_id IN ({_FIRST})",
)
def limit_channels(spark, sf):
    from affinis.plans.vectors import first_channels

    return first_channels(I.document_messages(spark, sf), 10).select("channel_id", "message_id")


@query(
    "long_messages",
    f"""SELECT message_id, len({Q.words('clean')}) AS n_words FROM (
          SELECT doc_id AS message_id,
                 {Q.drop_links("text || ' https://t.me/' || source || '_chan/' || doc_id || ' @' || source || ' <b>x</b>'")} AS clean
          FROM documents) WHERE len({Q.words('clean')}) > {C.LONG_MESSAGE_WORDS}""",
)
def long_messages(spark, sf):
    return ms.long_messages(
        I.documents(spark, sf).select(F.col("doc_id").alias("message_id"), linked_text().alias("message"))
    ).select("message_id", F.col("n_words").cast("bigint").alias("n_words"))


def linked_text():
    """Document text with links, a mention and tags added; the fixture has none."""
    return F.concat(
        "text", F.lit(" https://t.me/"), "source", F.lit("_chan/"), "doc_id", F.lit(" @"), "source",
        F.lit(" <b>x</b>"),
    )
