"""Lookups by handle and description, random channels, request routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.plans import search
from affinis.plans import vectors as pv
from affinis.queries import inputs as I
from affinis.queries import sql as Q
from affinis.queries.encoders import _GROUP_ROWS, _REQUESTS
from affinis.queries.pages import CLASS, PAGE_TEXTS
from affinis.queries.registry import query
from affinis.queries.similarity import _RESULTS
from affinis.queries.texts import _HANDLE
from affinis.session import materialise, scratch_path
from affinis.sources.channels import handle_index
from affinis.streaming import lookups as sl
from affinis.streaming import routing

_ASKED = f"SELECT request_id, {_HANDLE} AS handle FROM ({I.HANDLE_REQUESTS_SQL})"


@query(
    "known_unknown_split",
    f"""SELECT request_id, coalesce(handle, '') AS handle, coalesce(channel_id, -1) AS channel_id
        FROM ({_ASKED}) LEFT JOIN (SELECT link AS handle, channel_id FROM ({I.CHANNELS_SQL})) USING (handle)""",
)
def known_unknown_split(spark, sf):
    split = search.split_known(I.handle_requests(spark, sf), handle_index(I.channels(spark, sf)))
    return split.select(
        "request_id", F.coalesce("handle", F.lit("")).alias("handle"),
        F.coalesce("channel_id", F.lit(-1).cast("bigint")).alias("channel_id"),
    )


@query(
    "lookup_by_handle",
    f"""SELECT a.request_id, r.rank, r.link, r.title, r.sim
        FROM ({_ASKED}) a JOIN ({I.CHANNELS_SQL}) c ON c.link = a.handle
        JOIN ({_RESULTS}) r ON r.channel_id = c.channel_id""",
)
def lookup_by_handle(spark, sf):
    neighbours = search.neighbour_table(I.vectors(spark, sf))
    return _shown(search.lookup_known(I.handle_requests(spark, sf), I.channels(spark, sf), neighbours))


def _shown(rows):
    return rows.select("request_id", F.col("rank").cast("bigint").alias("rank"), "link", "title",
                       I.round6(F.col("sim")).alias("sim"))


_CORPUS = Q.vector_lists(Q.group_vectors(_GROUP_ROWS, pv.CHANNELS))
_SOURCES = f"""
  SELECT {I.SOURCE_ID_SQL} AS channel_id, source AS link, 'Texts of ' || source AS title FROM documents
  GROUP BY source"""


def _search_sql(requests_sql: str, rule) -> str:
    return f"""
  SELECT request_id, rank, m.link, m.title, {I.r6('sim')} AS sim FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(sim, 9) DESC, channel_id) AS rank FROM (
      SELECT q.id AS request_id, c.id AS channel_id, {Q.cosine('q.vec', 'c.vec')} AS sim
      FROM ({Q.vector_lists(Q.group_vectors(requests_sql, rule))}) q, ({_CORPUS}) c)) h
  JOIN ({_SOURCES}) m USING (channel_id) WHERE rank <= {C.RESULTS}"""


def _channel_vectors(spark, sf):
    return materialise(pv.channel_embeddings(I.document_messages(spark, sf)), "channels")


@query("search_by_description", _search_sql(_REQUESTS, pv.DESCRIPTIONS))
def search_by_description(spark, sf):
    requests = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    return _shown(search.search_descriptions(requests, I.source_channels(spark, sf), _channel_vectors(spark, sf)))


_TURNS = "SELECT conv_id AS group_id, turn AS item_id, text FROM conversations"


def _unknown(spark, sf):
    """Conversations play the pages of unknown channels: their turns are its messages."""
    talks = I.table(spark, sf, "conversations")
    handle = F.concat(F.lit("talk_"), "conv_id")
    texts = talks.select(handle.alias("handle"), F.col("turn").alias("pos"), "text")
    requests = talks.select("conv_id").distinct().select(
        F.col("conv_id").alias("request_id"), F.concat(F.lit("@"), handle).alias("text")
    )
    return requests, texts


@query("lookup_unknown", _search_sql(_TURNS, pv.UNKNOWN_CHANNELS))
def lookup_unknown(spark, sf):
    requests, texts = _unknown(spark, sf)
    answers, _ = search.lookup_unknown(
        requests, I.source_channels(spark, sf), _channel_vectors(spark, sf), texts
    )
    return _shown(answers)


@query("lookup_incremental", _search_sql(_TURNS, pv.UNKNOWN_CHANNELS))
def lookup_incremental(spark, sf):
    """Stream of requests: none is known, all are resolved and remembered, then asked again."""
    requests, texts = _unknown(spark, sf)
    meta = I.source_channels(spark, sf)
    path = scratch_path(spark, "requests")
    requests.repartition(4).write.parquet(path)

    def stream():
        return spark.readStream.schema(requests.schema).parquet(path)

    nothing = spark.createDataFrame([], "handle string, rank int, link string, title string, sim double")
    missed_path = scratch_path(spark, "missed")
    sl.run_to_table(
        sl.unanswered_stream(stream(), nothing), missed_path, scratch_path(spark, "missed-state")
    ).awaitTermination()
    missed = spark.read.parquet(missed_path).select("request_id", "text")
    _, memo = search.lookup_unknown(missed, meta, _channel_vectors(spark, sf), texts)
    answers = materialise(search.form_results(memo, meta, ["handle"], own_handle="handle"), "answers")
    answered_path = scratch_path(spark, "answered")
    sl.run_to_table(
        sl.answer_stream(stream(), answers), answered_path, scratch_path(spark, "answered-state")
    ).awaitTermination()
    return _shown(spark.read.parquet(answered_path))


# Every third page is asked for as a known channel, the others by a handle that only a page has.
_ASK_PAGES = f"""
  SELECT page_id AS group_id, pos AS item_id, text FROM ({PAGE_TEXTS}) WHERE page_id % 3 > 0"""
_KNOWN_PAGES = f"""
  SELECT p.page_id AS request_id, h.rank, m.link, m.title, {I.r6('sim')} AS sim FROM pages p
  JOIN (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY round(sim, 9) DESC, channel_id) AS rank FROM (
          SELECT a.id AS asked, c.id AS channel_id, {Q.cosine('a.vec', 'c.vec')} AS sim
          FROM ({_CORPUS}) a, ({_CORPUS}) c WHERE a.id <> c.id)) h ON h.asked = p.page_id % 20
  JOIN ({_SOURCES}) m ON m.channel_id = h.channel_id WHERE p.page_id % 3 = 0 AND h.rank <= {C.RESULTS}"""
_BOTH = f"""
  SELECT request_id, rank, link || '_chan' AS link, title, sim
  FROM ({_search_sql(_ASK_PAGES, pv.UNKNOWN_CHANNELS)} UNION ALL {_KNOWN_PAGES})"""


def _asked_pages(spark, sf):
    """Requests for pages, the channels' metadata, and the pages under their handles."""
    pages = I.table(spark, sf, "pages")
    handle = F.concat(F.lit("page_"), "page_id")
    known = F.concat(F.lit("src"), F.col("page_id") % 20, F.lit("_chan"))
    requests = pages.select(
        F.col("page_id").alias("request_id"),
        F.concat(F.lit("@"), F.when(F.col("page_id") % 3 == 0, known).otherwise(handle)).alias("text"),
    )
    meta = I.source_channels(spark, sf).withColumn("link", F.concat("link", F.lit("_chan")))
    return requests, meta, pages.select(handle.alias("handle"), "html")


@query("lookup_pages", _BOTH)
def lookup_pages(spark, sf):
    """Known handles from the neighbour table, the others from their page: header and messages."""
    requests, meta, pages = _asked_pages(spark, sf)
    vectors = _channel_vectors(spark, sf)
    answers, _ = search.lookup(
        requests, meta, search.neighbour_table(vectors), vectors, pages,
        header_class=CLASS, message_class=CLASS,
    )
    return _shown(answers)


@query(
    "lookup_remembered",
    f"""SELECT * FROM ({_BOTH}) UNION ALL
        SELECT request_id + 10000000, rank, link, title, sim FROM ({_BOTH}) WHERE request_id % 2 = 0""",
)
def lookup_remembered(spark, sf):
    """Two arrivals: what the first one finds out is remembered, and the second asks for it again."""
    requests, meta, pages = _asked_pages(spark, sf)
    vectors = _channel_vectors(spark, sf)
    neighbours = materialise(search.neighbour_table(vectors), "neighbours")
    even = F.col("request_id") % 2 == 0
    again = requests.where(even).withColumn("request_id", F.col("request_id") + 10_000_000)
    path, out = scratch_path(spark, "arrivals"), scratch_path(spark, "answers")
    memo_path, state = scratch_path(spark, "memo"), scratch_path(spark, "memo-state")
    for arrival in (requests.where(even), requests.where(~even).unionByName(again)):
        arrival.write.mode("append").parquet(path)
        source = spark.readStream.schema(requests.schema).parquet(path)
        sl.remember_stream(  # goes on where the run of the arrival before has ended
            source, memo_path, out, state,
            lambda batch, memo: search.lookup(
                materialise(batch, "batch"), meta, neighbours, vectors, pages, memo,
                header_class=CLASS, message_class=CLASS,
            ),
            compact_every=1,
        ).awaitTermination()
    return _shown(spark.read.parquet(out))


_WAIT, _LAGS = 60, (0, 5, 59, 60, 61, 90, None)  # minutes


def _lag(of):
    cases = " ".join(f"WHEN {i} THEN {'NULL' if x is None else x}" for i, x in enumerate(_LAGS))
    return f"CASE {of} % {len(_LAGS)} {cases} END"


@query(
    "await_pages",
    f"""SELECT page_id AS request_id, 'page_' || page_id AS handle,
               CASE WHEN lag <= {_WAIT} THEN 'page' ELSE 'expired' END AS outcome,
               CASE WHEN lag <= {_WAIT} THEN len(html) ELSE 0 END AS size
        FROM (SELECT page_id, html, {_lag('page_id')} AS lag FROM pages)""",
)
def await_pages(spark, sf):
    """Requests whose page lands at once, later, too late or never: a join of two streams in five arrivals."""
    pages = I.table(spark, sf, "pages").select("page_id", "html", F.expr(_lag("page_id")).alias("lag"))
    minute = F.col("page_id") % 600
    at = lambda minutes: F.timestamp_seconds(1_700_000_000 + 60 * minutes)
    handle = F.concat(F.lit("page_"), "page_id")
    requests = pages.select(F.col("page_id").alias("request_id"), F.concat(F.lit("@"), handle).alias("text"), at(minute).alias("asked_at"))
    landed = pages.where("lag IS NOT NULL").select(handle.alias("handle"), "html", at(minute + F.col("lag")).alias("landed_at"))
    # a row at the end of each stream moves the watermarks past all the others
    end = spark.range(1).select(F.lit(-1).cast("long").alias("request_id"), F.lit("@the_end").alias("text"), at(F.lit(9_999)).alias("asked_at"))
    end_page = spark.range(1).select(F.lit("at_the_end").alias("handle"), F.lit("").alias("html"), at(F.lit(9_999)).alias("landed_at"))
    sources = []
    for rows, last, time, name in ((requests, end, "asked_at", "asked"), (landed, end_page, "landed_at", "landed")):
        path = scratch_path(spark, name)
        for part in range(4):  # four hours of minutes each, in the order of time
            lo, hi = (at(F.lit(200 * part + x)) for x in (0, 200))
            rows.where((F.col(time) >= lo) & (F.col(time) < hi)).repartition(4).write.mode("append").parquet(path)
        last.write.mode("append").parquet(path)
        sources.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path))
    out = scratch_path(spark, "awaited")
    waiting = sl.await_pages(*sources, wait=f"{_WAIT} minutes", late="20 hours")
    sl.run_to_table(waiting, out, scratch_path(spark, "awaited-state")).awaitTermination()
    rows = spark.read.parquet(out).where("request_id >= 0")
    return rows.select("request_id", "handle", "outcome", F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("size"))


@query(
    "random_channels",
    f"SELECT channel_id, link, title FROM ({I.CHANNELS_SQL}) ORDER BY md5('0-' || channel_id), channel_id LIMIT {C.RESULTS}",
)
def random_channels(spark, sf):
    return search.random_channels(I.channels(spark, sf))


def _route_sql() -> str:
    menu = {C.BY_CHANNEL: 1, C.BY_DESCRIPTION: 2, C.RANDOM: 0, C.HELP: 0}
    sets = " ".join(f"WHEN {Q.lit(t)} THEN {s}" for t, s in menu.items())
    return f"""
  SELECT chat_id, request_id, CAST(state AS INTEGER) AS state,
         CASE WHEN text IN ('/start', '/help', {Q.lit(C.HELP)}) THEN 'help'
              WHEN text = {Q.lit(C.BY_CHANNEL)} THEN 'ask_channel'
              WHEN text = {Q.lit(C.BY_DESCRIPTION)} THEN 'ask_description'
              WHEN text = {Q.lit(C.RANDOM)} THEN 'random'
              WHEN state = 1 THEN 'channel_lookup' WHEN state = 2 THEN 'description_lookup'
              ELSE 'not_understood' END AS action
  FROM (SELECT *, coalesce(last_value(CASE text {sets} END IGNORE NULLS) OVER (
                    PARTITION BY chat_id ORDER BY ts, request_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS state
        FROM ({I.chat_requests_sql()}))"""


@query("route_requests", _route_sql())
def route_requests(spark, sf):
    return routing.route(I.chat_requests(spark, sf))


@query("route_requests_stream", _route_sql())
def route_requests_stream(spark, sf):
    """The same requests as a stream: three arrivals of four files, one arrival per trigger."""
    requests = I.chat_requests(spark, sf)
    path = scratch_path(spark, "chat")
    day = F.dayofmonth("ts")
    for arrival in (day <= 10, (day > 10) & (day <= 20), day > 20):
        requests.where(arrival).repartition(4).write.mode("append").parquet(path)
    source = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 4).parquet(path)
    out = scratch_path(spark, "routed")
    sl.run_to_table(
        routing.route_stream(source), out, scratch_path(spark, "routed-state")
    ).awaitTermination()
    return spark.read.parquet(out)
