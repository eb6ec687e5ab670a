from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.plans import search
from affinis.streaming import lookups, routing


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 64))
    vec = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "channel_id bigint, embedding array<double>")
    meta = spark.createDataFrame(
        [(i, f"chan_{i}" + ("_bot" if i % 7 == 0 else ""), f"Title {i}", "about") for i in range(40)],
        "channel_id bigint, link string, title string, about string",
    )
    return vec, meta, search.neighbour_table(vec).cache()


def test_neighbour_table_invariants(corpus):
    vec, _, neighbours = corpus
    by = {}
    for r in neighbours.orderBy("channel_id", "rank").collect():
        by.setdefault(r.channel_id, []).append(r)
    assert len(by) == 40
    for channel, rows in by.items():
        assert [r.rank for r in rows] == list(range(1, 40))
        assert channel not in {r.neighbour_id for r in rows}
        assert all(a.sim >= b.sim for a, b in zip(rows, rows[1:]))


def test_neighbour_lists(corpus):
    _, _, neighbours = corpus
    rows = search.neighbour_lists(neighbours, 3).collect()
    assert len(rows) == 40 and all(len(r.neighbours) == 3 for r in rows)
    flat = {(r.channel_id, r.rank): r.neighbour_id for r in neighbours.collect()}
    assert all(n.neighbour_id == flat[(r.channel_id, i)] for r in rows for i, n in enumerate(r.neighbours, 1))


@pytest.mark.parametrize("text", ["chan_1", "https://t.me/chan_1", "t.me/chan_1", "@chan_1"])
def test_lookup_forms(spark, corpus, text):
    _, meta, neighbours = corpus
    requests = spark.createDataFrame([(9, text)], "request_id bigint, text string")
    rows = search.lookup_known(requests, meta, neighbours).collect()
    assert 0 < len(rows) <= 5 and not any(r.link.endswith("bot") or r.link == "chan_1" for r in rows)


def test_filters_come_after_the_cut(spark, corpus):
    _, meta, neighbours = corpus
    bots = meta.withColumn("link", F.concat("link", F.lit("_bot")))
    hits = neighbours.where("channel_id = 1")
    assert search.form_results(hits, bots, ["channel_id"]).count() == 0
    refilled = search.form_results(hits, meta, ["channel_id"], refill=True)
    assert [r.rank for r in refilled.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    null_link = meta.withColumn("link", F.lit(None).cast("string"))
    assert search.form_results(hits, null_link, ["channel_id"]).count() == 0


def test_skip_drops_the_best_hit(spark, corpus):
    vec, _, _ = corpus
    q = vec.where("channel_id = 7").select(F.col("channel_id").alias("request_id"), "embedding")
    plain = [r.neighbour_id for r in search.search_vectors(q, vec, 5).orderBy("rank").collect()]
    literal = [r.neighbour_id for r in search.search_vectors(q, vec, 5, skip=1).orderBy("rank").collect()]
    assert plain[0] == 7 and literal[:4] == plain[1:]


@pytest.mark.parametrize("text", ["Rhino ate the mayor", "Trading", "Why slow the water? It flows. So explain!"])
def test_description_search(spark, corpus, text):
    vec, meta, _ = corpus
    requests = spark.createDataFrame([(1, text)], "request_id bigint, text string")
    rows = search.search_descriptions(requests, meta, vec).collect()
    assert 0 < len(rows) <= 5


def test_unknown_handles_are_remembered(spark, corpus):
    vec, meta, _ = corpus
    texts = spark.createDataFrame(
        [("newcomer", 0, "we write about old trains"), ("newcomer", 1, "trains and more trains"), ("empty_one", 0, "")],
        "handle string, pos int, text string",
    )
    requests = spark.createDataFrame(
        [(1, "@newcomer"), (2, "t.me/newcomer"), (3, "@empty_one"), (4, "@chan_1"), (5, "??")],
        "request_id bigint, text string",
    )
    answers, memo = search.lookup_unknown(requests, meta, vec, texts)
    assert {r.request_id for r in answers.collect()} == {1, 2}
    assert memo.select("handle").distinct().count() == 1
    again = search.remembered(requests, memo, meta)
    key = ["request_id", "rank"]
    assert again.orderBy(*key).collect() == answers.orderBy(*key).collect()


def test_repeated_metadata_gives_one_result_per_rank(spark, corpus):
    vec, meta, _ = corpus
    requests = spark.createDataFrame([(1, "Trading")], "request_id bigint, text string")
    once = search.search_descriptions(requests, meta, vec).orderBy("rank").collect()
    twice = search.search_descriptions(requests, meta.unionByName(meta), vec).orderBy("rank").collect()
    assert once == twice


def test_requests_are_answered_end_to_end(spark, corpus):
    vec, meta, _ = corpus
    page = '<div class="%s">trains and more trains</div><div class="%s">old trains</div>' % (C.MESSAGE_CLASS, C.HEADER_CLASS)
    pages = spark.createDataFrame([("newcomer", page)], "handle string, html string")
    chat = [C.BY_CHANNEL, "@chan_1", "@newcomer", "@nobody_here", C.BY_DESCRIPTION, "Rhino ate the mayor", C.RANDOM, "x"]
    requests = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(chat)], "chat_id bigint, request_id bigint, s bigint, text string")
    requests = requests.select("chat_id", "request_id", F.timestamp_seconds("s").alias("ts"), "text")
    neighbours = search.neighbour_table(vec)
    answers, memo = search.answer_requests(requests, meta, neighbours, vec, pages)
    rows = {r.request_id: r for r in answers.collect()}
    assert [rows[i].action for i in range(8)] == [
        "ask_channel", "channel_lookup", "channel_lookup", "channel_lookup", "ask_description", "description_lookup", "random",
        "not_understood",
    ]
    assert [bool(rows[i].message) for i in range(8)] == [False, True, True, False, False, True, True, False]
    assert {r.handle for r in memo.collect()} == {"newcomer"}
    again, found = search.answer_requests(requests, meta, neighbours, vec, pages.limit(0), memo)
    assert {r.request_id: r.message for r in again.collect()} == {i: r.message for i, r in rows.items()}
    assert found.count() == 0


def test_random_and_format(spark, corpus):
    _, meta, _ = corpus
    first = [r.channel_id for r in search.random_channels(meta, 5, "s").collect()]
    assert first == [r.channel_id for r in search.random_channels(meta.repartition(3), 5, "s").collect()]
    assert first != [r.channel_id for r in search.random_channels(meta, 5, "t").collect()]
    assert search.random_channels(meta.limit(2), 5).count() == 2
    results = spark.createDataFrame(
        [(1, 2, "b", "B", 0.5), (1, 1, "a", "A", 0.91)], "request_id int, rank int, link string, title string, sim double"
    )
    assert search.format_results(results, ["request_id"]).first().message == "@a - A (91%)\n\n@b - B (50%)"


CHAT = [
    (1, 1, "hello", 0, "not_understood"), (1, 2, C.BY_CHANNEL, 0, "ask_channel"), (1, 3, "@x_name", 1, "channel_lookup"),
    (1, 4, "/start", 1, "help"), (1, 5, "t.me/other", 1, "channel_lookup"), (1, 6, C.BY_DESCRIPTION, 1, "ask_description"),
    (1, 7, "about fish", 2, "description_lookup"), (1, 8, C.RANDOM, 2, "random"), (1, 9, "more", 0, "not_understood"),
    (1, 10, C.BY_DESCRIPTION, 0, "ask_description"), (1, 11, C.HELP, 2, "help"), (1, 12, "x", 0, "not_understood"),
    (2, 13, C.BY_CHANNEL + "\n", 0, "ask_channel"), (2, 14, C.BY_CHANNEL + "!", 1, "channel_lookup"), (2, 15, "/help@me now", 1, "help"),
]


def _chat(spark):
    rows = [(chat, i, i * 60, text) for chat, i, text, _, _ in CHAT]
    return spark.createDataFrame(rows, "chat_id bigint, request_id bigint, s bigint, text string").select(
        "chat_id", "request_id", F.timestamp_seconds("s").alias("ts"), "text"
    )


def test_routing_batch_and_stream(spark, tmp_path):
    want = {i: (state, action) for _, i, _, state, action in CHAT}
    requests = _chat(spark)
    got = {r.request_id: (r.state, r.action) for r in routing.route(requests).collect()}
    assert got == want
    src = str(tmp_path / "src")
    for lo, hi in ((0, 5), (5, 9), (9, 99)):
        requests.where((F.col("request_id") > lo) & (F.col("request_id") <= hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(src)
    lookups.run_to_table(
        routing.route_stream(stream, watermark="1 hour"), str(tmp_path / "out"), str(tmp_path / "state")
    ).awaitTermination()
    got = {r.request_id: (r.state, r.action) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_late_requests_are_dropped(spark, tmp_path):
    rows = [(1, 1, 100_000, C.BY_CHANNEL), (1, 2, 100_060, "@x_name"), (1, 3, 10, "late"), (2, 4, 200_000, "hello")]
    requests = spark.createDataFrame(rows, "chat_id bigint, request_id bigint, s bigint, text string").select(
        "chat_id", "request_id", F.timestamp_seconds("s").alias("ts"), "text"
    )
    src = str(tmp_path / "src")
    for some in ([1, 2], [4], [3]):  # Spark drops by the watermark of the batch before
        requests.where(F.col("request_id").isin(some)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(src)
    lookups.run_to_table(
        routing.route_stream(stream, watermark="1 minute"), str(tmp_path / "out"), str(tmp_path / "state")
    ).awaitTermination()
    got = {r.request_id: r.action for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "ask_channel", 2: "channel_lookup", 4: "not_understood"}


def _streamed(spark, tmp_path, requests, arrivals, **options):
    src = str(tmp_path / "src")
    for some in arrivals:
        requests.where(some).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = lookups.run_to_table(routing.route_stream(stream, **options), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    return query, spark.read.parquet(str(tmp_path / "out"))


def test_chats_of_a_bucket_keep_their_own_state(spark, tmp_path):
    texts = [C.BY_CHANNEL, C.BY_DESCRIPTION, C.RANDOM, "hello", "/start"]
    rows = [(None if i % 40 == 0 else i % 40, 2**60 + i, i * 60, texts[i * i % 11 % 5]) for i in range(400)]
    requests = spark.createDataFrame(rows, "chat_id bigint, request_id bigint, s bigint, text string").select(
        "chat_id", "request_id", F.timestamp_seconds("s").alias("ts"), "text"
    )
    arrivals = [F.col("request_id") - 2**60 < 150, F.col("request_id") - 2**60 >= 150]
    query, found = _streamed(spark, tmp_path, requests, arrivals, buckets=4)
    want = sorted((tuple(r) for r in routing.route(requests).collect()), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # not one for each chat


def test_a_chat_of_a_bucket_is_forgotten_alone(spark, tmp_path):
    day = 86_400
    rows = [(1, 1, 60, C.BY_CHANNEL), (2, 2, 3 * day, C.BY_DESCRIPTION), (3, 3, 6 * day, "x"), (4, 4, 6 * day + 60, "x"),
            (1, 5, 6 * day + 120, "about"), (2, 6, 6 * day + 120, "about")]
    requests = spark.createDataFrame(rows, "chat_id bigint, request_id bigint, s bigint, text string").select(
        "chat_id", "request_id", F.timestamp_seconds("s").alias("ts"), "text"
    )
    arrivals = [F.col("request_id").isin(x) for x in ([1, 2], [3], [4], [5, 6])]
    _, found = _streamed(spark, tmp_path, requests, arrivals, watermark="1 minute", idle=timedelta(days=5), buckets=1)
    got = {r.request_id: r.action for r in found.collect()}
    assert got[5] == "not_understood" and got[6] == "description_lookup" and len(got) == 6
