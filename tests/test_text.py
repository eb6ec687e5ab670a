import pytest
from pyspark.sql import functions as F

from affinis.functions import handles as hd
from affinis.functions import text as tx


def run(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


LINKS = {
    "see https://t.me/joinchat/AAAAAE_x-1 now": "see  now",
    "http://t.me/somechannel/123 x": "/123 x",
    "t.me/abc y": "t.me/abc y",
    "mail foo@bar.com": "mail foo.com",
    "<img src='x'> <b>bold</b> <a href=\"http://q.w/z\">L</a>": " image_token  bold L",
    "x <img src=1": "x  image_token ",
    "go http://a.b/c?d=e#f~g": "go #f~g",
    "a<b and c>d": "ad",
    "t.me/s/durov_channel": "t.me/s/durov_channel",
    "https://t.me/s/durov_channel": "",
    "t.me/joinchat/AB": "/AB",
    "https://пример.рф/a": "https://пример.рф/a",
    "z <": "z <",
    "<>": "<>",
    "plain text": "plain text",
    "ht<b>tp://x.y": "",
}


def test_drop_links(spark):
    assert run(spark, LINKS, tx.drop_links) == list(LINKS.values())


def test_null_text_stays_null(spark):
    for fn in (tx.drop_links, tx.clear_emoji, tx.clean_text, tx.header_text):
        assert run(spark, [None], fn) == [None]


def test_clear_emoji(spark):
    cases = {
        "a😀b": "ab",
        "👍🏽 ok": " ok",
        "family 👩‍👩‍👧‍👦!": "family !",
        "🇫🇷 flag": " flag",
        "1️⃣ one 1 #": " one 1 #",
        "❤️ love ❤": " love ",
        "© ™ plain": "  plain",
        "ё é 漢字 12*": "ё é 漢字 12*",
    }
    assert run(spark, cases, tx.clear_emoji) == list(cases.values())


def test_split_sentences(spark):
    out = run(spark, ["One. Two! Three? Four… five", "a.b c", "", "x. y.\n z"], tx.split_sentences)
    assert out == [["One.", "Two!", "Three?", "Four…", "five"], ["a.b c"], [""], ["x.", "y.", "z"]]


def test_clean_text(spark):
    cases = {
        "Hello, World-wide 42!": "hello world-wide",
        "Ёлка снег_да": "лка снегда",
        "a 　b\n\n c": "a b c",
        "  <b>x</b>  ": "x",
        "mail @name here": "mail here",
    }
    assert run(spark, cases, tx.clean_text) == list(cases.values())
    assert run(spark, ["Abc Яд"], lambda c: tx.clean_text(c, lower=False)) == ["Abc Яд"]


def test_single_space_pieces(spark):
    assert run(spark, ["a  b", "", "a b"], lambda c: F.size(tx.space_pieces(c))) == [3, 1, 2]


def test_words_use_unicode_space(spark):
    assert run(spark, ["a b c \t", "  "], tx.words) == [["a", "b", "c"], []]


def test_header(spark):
    text = "\n @shop news \r\nWe sell 😀 things\n@admin writes\n\nt.me/shop_chat here\nBye http://a.b"
    assert run(spark, [text], tx.header_text) == ["news"]
    pattern = r"@[a-z]+|t\.me/"
    assert run(spark, [text], lambda c: tx.header_text(c, pattern)) == ["news We sell  things Bye"]


HANDLES = {
    "https://t.me/name_1": "name_1",
    "http://t.me/name_1": "name_1",
    "t.me/name_1": "name_1",
    "@name_1": "name_1",
    "name_1": "name_1",
    "name_1 ": "name_1",
    "abcd": None,
    "two words": None,
    "x" * 33: None,
    "@" + "y" * 33: "y" * 32,
    "t.me/s/name_1": None,
    "someone@gmail.com": "gmail",
    "t.me/joinchat/XYZ": "joinchat",
    "Name_UPPER": "Name_UPPER",
}


def test_normalise_handle(spark):
    assert run(spark, HANDLES, hd.normalise_handle) == list(HANDLES.values())


@pytest.mark.parametrize(
    "text,expected",
    [
        ("12 345 subscribers", 12345),
        ("no subscribers", -1),
        (None, -1),
        ("", -1),
        ("\n7 \n", 7),
        ("12\u00a0345 subscribers", -1),
        ("subscribers: 5", 5),
        ("a b 5", -1),
        ("abc123", 123),
        ("99999999999999999999", -1),
    ],
)
def test_subscriber_count(spark, text, expected):
    assert run(spark, [text], hd.subscriber_count) == [expected]


def test_result_line_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", "T", 0.125), ("b", "U", 0.375)], "l string, t string, s double")
    rows = df.select(hd.result_line(F.col("l"), F.col("t"), F.col("s")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["@a - T (12%)", "@b - U (38%)"]
    assert df.select(hd.result_line(F.col("l"), F.col("t")).alias("x")).first()["x"] == "@a - T"


def test_stop_words_keep_repetitions(spark):
    df = spark.createDataFrame([(["the", "cat", "The", "cat", "и"],)], "t array<string>")
    kept = tx.remove_stop_words(df, "t", "k").first()["k"]
    assert kept == ["cat", "The", "cat"]
    assert {"the", "и"} <= set(tx.default_stop_words())


def test_recency_is_strict(spark):
    rows = [("2021-05-31 23:59:59+00:00",), ("2021-06-01 00:00:00+00:00",), ("2020-12-31 00:00:00+00:00",)]
    df = spark.createDataFrame(rows, "date string")
    assert df.where(tx.is_recent(F.col("date"), "string")).count() == 1
    ts = df.select(F.to_timestamp(F.substring("date", 1, 19)).alias("date"))
    assert ts.where(tx.is_recent(F.col("date"), "timestamp")).count() == 1


def test_computed_column_is_evaluated_once(spark):
    df = spark.range(10).withColumn("x", F.col("id").cast("string"))
    out = tx.computed(df, "n", F.length(F.regexp_replace("x", "1", "ab"))).where("n > 0")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_text_dates_reach_the_scan(spark, tmp_path):
    dates = ["2024-01-14 10:00:00+00:00", "2024-01-15", "2024-01-15 00:00:01", "2024-01-16 x", " 2024-01-16", "\t2024-01-17 1", "", " "]
    dates += ["\u00a02024-02-01", "\u30002023-02-01", "\x1c2024-03-01 5", "9", None, "\x852024-05-01"]
    df = spark.createDataFrame([(x,) for x in dates], "date string")
    df.coalesce(1).write.parquet(str(tmp_path / "dates"))
    read = spark.read.parquet(str(tmp_path / "dates"))
    kept = read.where(tx.is_recent(F.col("date"), "string", "2024-01-15"))
    plain = read.where(F.try_element_at(tx.words(F.col("date")), F.lit(1)) > "2024-01-15")
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in plain.collect()) and kept.count() >= 5
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Or(GreaterThan(date,2024-01-15),LessThan(date,!))" in plan
