"""Neighbour tables, lookups by handle or description, and results joined to metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.functions.handles import normalise_handle, result_line
from affinis.operators.similarity import top_k
from affinis.plans.vectors import (
    DESCRIPTIONS, UNKNOWN_CHANNELS, Encoder, Selection, description_vectors,
)
from affinis.session import materialise
from affinis.sources.channels import handle_index
from affinis.sources.pages import page_texts, parse_pages
from affinis.streaming.routing import route


def _as_vectors(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col("embedding").alias("vec"))


def neighbour_table(vectors: DataFrame, k: int = C.NEIGHBOURS, **options) -> DataFrame:
    """``(channel_id, rank, neighbour_id, sim)``: the ``k`` most similar other channels."""
    corpus = _as_vectors(vectors, "channel_id")
    options.setdefault("exclude", "self")
    return top_k(corpus, corpus, k, **options).withColumnRenamed("query_id", "channel_id")


def neighbour_lists(neighbours: DataFrame, k: int | None = None) -> DataFrame:
    """``(channel_id, neighbours)``: one ranked array per channel, at most the stored ``k`` long."""
    rows = neighbours if k is None else neighbours.where(F.col("rank") <= k)
    ranked = F.sort_array(F.collect_list(F.struct("rank", "neighbour_id", "sim")))
    bare = F.transform(ranked, lambda x: F.struct(x["neighbour_id"], x["sim"]))
    return rows.groupBy("channel_id").agg(bare.alias("neighbours"))


def write_neighbours(neighbours: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the table so that the rows of a channel lie together and skip by channel id."""
    neighbours.repartitionByRange("channel_id", "rank").sortWithinPartitions(
        "channel_id", "rank"
    ).write.mode(mode).parquet(path)


def search_vectors(
    queries: DataFrame, vectors: DataFrame, k: int = C.NEIGHBOURS, skip: int = 0, **options
) -> DataFrame:
    """``(request_id, rank, neighbour_id, sim)`` for ``queries(request_id, embedding)``.

    ``skip=1`` drops the best hit, as a lookup that takes it for the query itself would do.
    """
    options.setdefault("exclude", "top1" if skip else "none")
    hits = top_k(_as_vectors(queries, "request_id"), _as_vectors(vectors, "channel_id"), k, **options)
    return hits.withColumnRenamed("query_id", "request_id")


def form_results(
    hits: DataFrame,
    meta: DataFrame,
    keys: list[str],
    k: int = C.RESULTS,
    own_handle: str | None = None,
    refill: bool = False,
) -> DataFrame:
    """Join hits to metadata by id; drop bots and the asked channel itself.

    The cut to ``k`` comes first, so a dropped hit leaves a gap; ``refill=True`` filters first
    and numbers what is left. It fills up from the given ``hits`` only: where more of them are dropped
    than they hold beyond ``k``, the answer stays shorter. ``own_handle`` names a column of ``hits`` that may be null.
    """
    if not refill:
        hits = hits.where(F.col("rank") <= k)
    # of several metadata rows of one channel the first by handle and title counts
    named = hits.join(
        meta.groupBy(F.col("channel_id").alias("neighbour_id"))
        .agg(F.min(F.struct("link", "title")).alias("m"))
        .select("neighbour_id", "m.link", "m.title"),
        "neighbour_id",
    )
    kept = named.where(~F.col("link").endswith("bot"))
    if own_handle is not None:
        kept = kept.where(F.col(own_handle).isNull() | (F.col("link") != F.col(own_handle)))
    if refill:
        position = F.row_number().over(W.partitionBy(*keys).orderBy("rank"))
        kept = kept.withColumn("rank", position).where(F.col("rank") <= k)
    return kept.select(*keys, "rank", "link", "title", "sim")


def split_known(requests: DataFrame, handles: DataFrame) -> DataFrame:
    """Add the normalised ``handle`` and its ``channel_id``, null when it is not in the index."""
    asked = requests.withColumn("handle", normalise_handle(F.col("text")))
    return asked.join(handles, "handle", "left")


def lookup_known(
    requests: DataFrame, meta: DataFrame, neighbours: DataFrame, k: int = C.RESULTS
) -> DataFrame:
    """Answers for ``requests(request_id, text)`` whose handle is in the index.

    Each handle is answered once, however many requests ask for it; the answers then go back to
    the requests over a join in which only the request side can be skewed (split at runtime).
    """
    known = split_known(requests, handle_index(meta)).where("channel_id is not null")
    asked = known.select("handle", "channel_id").distinct()
    hits = asked.join(neighbours.where(F.col("rank") <= k), "channel_id")
    answers = form_results(hits, meta, ["handle"], k, own_handle="handle")
    return known.select("request_id", "handle").join(answers, "handle").select(
        "request_id", "rank", "link", "title", "sim"
    )


def unknown_vectors(
    unknown: DataFrame, texts: DataFrame, encoder: Encoder | None = None
) -> DataFrame:
    """Vectors of unknown handles from their page texts: ``(handle, embedding)``.

    ``unknown(handle)`` is unique; ``texts(handle, pos, text)`` comes from the parsed pages.
    """
    rows = texts.join(unknown, "handle", "left_semi").withColumnRenamed("handle", "request_id")
    return description_vectors(rows, UNKNOWN_CHANNELS, encoder).withColumnRenamed(
        "request_id", "handle"
    )


def lookup_unknown(
    requests: DataFrame,
    meta: DataFrame,
    vectors: DataFrame,
    texts: DataFrame,
    k: int = C.RESULTS,
    skip: int = 0,
    encoder: Encoder | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers for handles outside the index, and their neighbour rows to remember.

    Returns ``(request_id, rank, link, title, sim)`` and ``(handle, rank, neighbour_id, sim)``.
    """
    asked = split_known(requests, handle_index(meta)).where(
        "channel_id is null and handle is not null"
    )
    found = unknown_vectors(asked.select("handle").distinct(), texts, encoder)
    # numeric ids for the search; the handle's hash would not be unique, a written number is
    numbered = materialise(
        found.withColumn("request_id", F.monotonically_increasing_id()), "unknown"
    )
    hits = search_vectors(numbered, vectors, C.NEIGHBOURS, skip)
    memo = materialise(
        hits.join(numbered.select("request_id", "handle"), "request_id").select(
            "handle", "rank", "neighbour_id", "sim"
        ),
        "memo",
    )
    answers = form_results(memo, meta, ["handle"], k, own_handle="handle")
    joined = asked.select("request_id", "handle").join(answers, "handle")
    return joined.select("request_id", "rank", "link", "title", "sim"), memo


def page_handle_texts(pages: DataFrame, **classes) -> DataFrame:
    """``(handle, pos, text)`` of landed ``pages(handle, html)``: messages in order, then the header."""
    return page_texts(parse_pages(pages.select("handle", "html"), "handle", **classes), "handle")


def lookup(
    requests: DataFrame,
    meta: DataFrame,
    neighbours: DataFrame,
    vectors: DataFrame,
    pages: DataFrame,
    memo: DataFrame | None = None,
    k: int = C.RESULTS,
    encoder: Encoder | None = None,
    **classes,
) -> tuple[DataFrame, DataFrame]:
    """Answers for known and unknown handles together, and the neighbour rows found anew.

    Known handles are answered from ``neighbours``, remembered ones from ``memo``, and the rest from
    the texts of their ``pages(handle, html)``.
    """
    known = lookup_known(requests, meta, neighbours, k)
    rest = requests
    if memo is not None:
        seen = memo.select(F.col("handle").alias("_handle")).distinct()
        rest = requests.join(seen, normalise_handle(F.col("text")) == F.col("_handle"), "left_anti")
        index = handle_index(meta).select("handle")
        fresh = memo.join(index, "handle", "left_anti")  # an indexed handle is known by now
        known = known.unionByName(remembered(requests, fresh, meta, k))
    answers, found = lookup_unknown(rest, meta, vectors, page_handle_texts(pages, **classes), k, encoder=encoder)
    return known.unionByName(answers), found


def answer_requests(
    requests: DataFrame,
    meta: DataFrame,
    neighbours: DataFrame,
    vectors: DataFrame,
    pages: DataFrame,
    memo: DataFrame | None = None,
    seed: str = "0",
    encoder: Encoder | None = None,
    **classes,
) -> tuple[DataFrame, DataFrame]:
    """What to say to each of ``requests(chat_id, request_id, ts, text)``, and what to remember.

    Returns ``(chat_id, request_id, action, message)`` and new memo rows. ``message`` is null for
    actions that are not answered from tables, and for lookups that find nothing. ``request_id`` is unique.
    """
    routed = materialise(
        route(requests).join(requests.select("request_id", "text"), "request_id"), "routed"
    )
    asked = lambda action: routed.where(F.col("action") == action).select("request_id", "text")
    by_handle, found = lookup(
        asked("channel_lookup"), meta, neighbours, vectors, pages, memo, encoder=encoder, **classes
    )
    by_text = search_descriptions(asked("description_lookup"), meta, vectors, encoder=encoder)
    told = format_results(by_handle.unionByName(by_text), ["request_id"])
    few = random_channels(meta, seed=seed).withColumn(
        "rank", F.row_number().over(W.orderBy(F.md5(F.concat_ws("-", F.lit(seed), "channel_id")), "channel_id"))
    )  # at most ``C.RESULTS`` rows
    drawn = format_results(few.withColumn("all", F.lit(1)), ["all"]).select(F.col("message").alias("drawn"))
    answered = routed.join(told, "request_id", "left").join(F.broadcast(drawn), F.lit(True), "left")
    message = F.when(F.col("action") == "random", F.col("drawn")).otherwise(F.col("message"))
    return answered.select("chat_id", "request_id", "action", message.alias("message")), found


def remembered(requests: DataFrame, memo: DataFrame, meta: DataFrame, k: int = C.RESULTS) -> DataFrame:
    """Answer requests from remembered neighbour rows ``(handle, rank, neighbour_id, sim)``."""
    asked = requests.withColumn("handle", normalise_handle(F.col("text")))
    hits = memo.join(asked.select("handle").distinct(), "handle", "left_semi")
    answers = form_results(hits, meta, ["handle"], k, own_handle="handle")
    return asked.select("request_id", "handle").join(answers, "handle").select(
        "request_id", "rank", "link", "title", "sim"
    )


def search_descriptions(
    requests: DataFrame,
    meta: DataFrame,
    vectors: DataFrame,
    k: int = C.RESULTS,
    skip: int = 0,
    min_sim: float | None = None,
    rule: Selection = DESCRIPTIONS,
    encoder: Encoder | None = None,
) -> DataFrame:
    """``(request_id, rank, link, title, sim)`` for free-text ``requests(request_id, text)``."""
    queries = materialise(description_vectors(requests, rule, encoder), "queries")
    hits = search_vectors(queries, vectors, k, skip, min_sim=min_sim)
    return form_results(hits, meta, ["request_id"], k)


def random_channels(meta: DataFrame, n: int = C.RESULTS, seed: str = "0") -> DataFrame:
    """``n`` channels in a seeded random order, fewer if there are not as many."""
    key = F.md5(F.concat_ws("-", F.lit(seed), "channel_id"))
    return meta.orderBy(key, "channel_id").limit(n).select("channel_id", "link", "title")


def format_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """One text per request: result lines in rank order, separated by blank lines.

    A request has at most ``k`` results, so the collected list is bounded.
    """
    sim = F.col("sim") if "sim" in results.columns else None
    line = result_line(F.col("link"), F.col("title"), sim)
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    texts = F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n")
    return results.groupBy(*keys).agg(texts.alias("message"))
