import math
from collections import Counter

from pyspark.sql import functions as F

from affinis.operators import sentences as S

TEXT = [
    "Mr. Smith met Dr. Jones at noon. They spoke. It was late, e.g. after dark.",
    "Then Mr. Jones left. Dr. Smith stayed (see fig. 3). He read fig. 4, i.e. the last one. The end.",
    "A smith and a doctor, mr. and dr. they say. The end was near. No end. At the end, e.g. here.",
    "Mr. Brown, Mr. White. Dr. Green. Dr. Gray, i.e. he. Fig. 5 and fig. 6 and fig. 7, e.g. that.",
    "Call e.g. Mr. Black! Or Dr. Blue? i.e. anyone. i.e. none. e.g. all. Mr. Red stood at the end of it.",
    None,
    "",
]


def by_force(texts):
    stops, total = Counter(), Counter()
    for text in texts:
        for token in (text or "").lower().split():
            token = token.strip(S.WRAPPING)
            stop = token.endswith(".") and not token.endswith("..")
            word = token[:-1] if stop else token
            if word and word[0].isalpha() and all(c.isalpha() or c in ".-" for c in word):
                total[word] += 1
                stops[word] += stop
    p = sum(stops.values()) / sum(total.values())
    out = {}
    for word, n in stops.items():
        if n:
            rest, inner = total[word] - n, word.count(".")
            size = max(len(word) - inner, 1)
            ratio = -2 * (n * math.log(p) + rest * math.log(1 - p) - n * math.log(0.99) - rest * math.log(0.01))
            out[word] = (n, total[word], ratio * math.exp(-size) * (inner + 1) * size**-rest)
    return out


def test_statistics(spark):
    df = spark.createDataFrame([(x,) for x in TEXT], "text string").repartition(3)
    got = {r["word"]: (r["stops"], r["total"], r["score"]) for r in S.scored_words(S.word_statistics(df)).collect()}
    want = by_force(TEXT)
    assert got.keys() == want.keys()
    for word, (n, total, score) in want.items():
        assert got[word][:2] == (n, total) and math.isclose(got[word][2], score, rel_tol=1e-9)


def test_abbreviations_stay_whole(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXT)], "id int, text string")
    known = S.abbreviations(df, least_stops=3)
    assert {"mr", "dr", "e.g", "i.e", "fig"} <= set(known) and not {"end", "noon", "late"} & set(known)
    rows = df.select("id", S.split_sentences(F.col("text"), known).alias("s")).orderBy("id").collect()
    assert rows[0]["s"] == ["Mr. Smith met Dr. Jones at noon.", "They spoke.", "It was late, e.g. after dark."]
    assert rows[2]["s"][0] == "A smith and a doctor, mr. and dr. they say."
    assert rows[5]["s"] is None and rows[6]["s"] == [""]
    assert len(S.abbreviations(df, least_stops=1, most=2)) == 2
    assert S.abbreviations(df.limit(0)) == []


def test_no_abbreviations_change_nothing(spark):
    df = spark.createDataFrame([("One. Two! Three",)], "text string")
    assert df.select(S.split_sentences(F.col("text"), [])).first()[0] == ["One.", "Two!", "Three"]
    assert df.select(S.split_sentences(F.col("text"), ["x"])).first()[0] == ["One.", "Two!", "Three"]
