import pytest
from pyspark.sql import functions as F

from affinis.operators import tokens as tk
from affinis.sources import channels as ch
from affinis.sources import messages as ms

ROWS = [
    (1, 5, 10, 1, 0, None, None, "2021-06-01 00:00:00+00:00", 'say "hi",\nnow \\ '),
    (2, 5, 11, 1, 0, 7, 8, "2021-05-31 10:00:00+00:00", "old"),
    (3, 4, 12, None, 0, None, None, "2022-01-01 10:00:00+00:00", ""),
    (4, 4, 12, 1, 0, None, None, "2022-01-01 10:00:00+00:00", None),
    (5, 4, 12, 1, 0, None, None, "2022-01-01 10:00:00+00:00", " padded "),
]


@pytest.fixture()
def messages(spark):
    return spark.createDataFrame(ROWS, ms.MESSAGES)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, messages, tmp_path, fmt):
    path = str(tmp_path / fmt)
    ms.write_messages(messages, path, fmt)
    back = ms.read_messages(spark, path, fmt)
    assert [f.dataType for f in back.schema] == [f.dataType for f in ms.MESSAGES]
    got = {tuple(r) for r in back.collect()}
    want = {tuple(r) for r in messages.collect()}
    if fmt == "csv":  # a text file has one way to write nothing
        got = {t[:-1] + (t[-1] or "",) for t in got}
        want = {t[:-1] + (t[-1] or "",) for t in want}
    assert got == want


def test_formats_are_checked(spark, messages, tmp_path):
    with pytest.raises(ValueError):
        ms.read_messages(spark, str(tmp_path), "pickle")
    with pytest.raises(ValueError):
        ms.write_messages(messages, str(tmp_path / "x"), "pickle")


def test_scan(messages):
    ids = lambda df: sorted(r.message_id for r in df.collect())
    assert ids(ms.scan_messages(messages)) == [1, 5]
    assert ids(ms.scan_messages(messages, filter_by_date=False)) == [1, 2, 5]
    assert ids(ms.scan_messages(messages, max_rows=0)) == []
    # rows 3, 4, 5 come first by channel; the cap counts them before the filters
    assert ids(ms.scan_messages(messages, max_rows=3)) == [5]


def test_metadata_leaves_the_text_unread(spark, messages, tmp_path):
    path = str(tmp_path / "m")
    ms.write_messages(messages, path)
    plan = ms.message_metadata(ms.read_messages(spark, path))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<message_id" in plan and "message:string" not in plan.split("ReadSchema")[1]


def test_timestamp_filter_reaches_the_scan(spark, messages, tmp_path):
    path = str(tmp_path / "t")
    stamped = messages.withColumn("date", F.to_timestamp(F.substring("date", 1, 19)))
    stamped.write.parquet(path)
    plan = ms.recent(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(date" in plan


def test_handles_last_one_wins(spark):
    meta = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (2, "c")], "channel_id bigint, link string")
    got = {r.handle: r.channel_id for r in ch.handle_index(meta).collect()}
    assert got == {"a": 3, "c": 2}


def test_channel_checks(spark, tmp_path):
    meta = spark.createDataFrame([(1, "a"), (2, "b")], "channel_id bigint, link string")
    vec = spark.createDataFrame([(1, [1.0]), (3, [2.0]), (3, [2.0])], "channel_id bigint, embedding array<double>")
    assert [r.channel_id for r in ch.embedded_channels(meta, vec).collect()] == [1]
    assert {r.channel_id for r in ch.missing_metadata(meta, vec).collect()} == {3}
    assert [tuple(r) for r in ch.duplicate_ids(vec).collect()] == [(3, 2)]
    ch.write_embeddings(vec, str(tmp_path / "e"))
    assert ch.read_embeddings(spark, str(tmp_path / "e")).count() == 3
    with pytest.raises(TypeError):
        ch.write_embeddings(meta.withColumn("embedding", F.lit("x")), str(tmp_path / "f"))


def test_channel_csv(spark, tmp_path):
    meta = spark.createDataFrame([(1, "a_name", 'T "x"', "two\nlines")], ch.CHANNELS)
    meta.write.options(**ms.CSV_WRITE).csv(str(tmp_path / "c"))
    assert [tuple(r) for r in ch.read_channels(spark, str(tmp_path / "c")).collect()] == [(1, "a_name", 'T "x"', "two\nlines")]


def test_clean_messages_modes(spark):
    df = spark.createDataFrame([(1, 9, "The cats, the DOGS!")], "message_id bigint, channel_id bigint, message string")
    assert tuple(tk.clean_messages(df, tokenize=False).first()) == (1, 9, "the cats the dogs")
    assert tk.clean_messages(df, cleaning=F.upper, tokenize=False).first().message == "THE CATS, THE DOGS!"
    assert tk.clean_messages(df).first().tokens == ["cats", "dogs"]
    stems = spark.createDataFrame([("cats", "cat"), ("dogs", "the")], "token string, stem string")
    rows = tk.clean_messages(df, stems=stems).orderBy("pos").collect()
    assert [(r.message_id, r.channel_id, r.pos, r.token) for r in rows] == [(1, 9, 1, "cat")]
