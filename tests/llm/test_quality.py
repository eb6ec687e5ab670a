import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from affinis.llm import quality as Q
from affinis.llm.query_quality import held_out, op3_quality


def test_word_sums_by_force(spark):
    texts = ["a b c b", "B, x y z z z", "", None, "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want, counts = np.zeros((Q.BUCKETS, Q.WIDTH), int), np.zeros(Q.BUCKETS, int)
    places, signs = Q.random_vectors()
    for text in texts:
        _, words = Q.word_codes(pa.array([text or ""], pa.large_string()))
        for i, word in enumerate(words):
            counts[word] += 1
            for j in range(max(0, i - Q.WINDOW), min(len(words), i + Q.WINDOW + 1)):
                if i != j:
                    np.add.at(want[word], places[words[j]], signs[words[j]])
    for row in Q.word_sums(df).collect():
        assert row["n"] == counts[row["bucket"]]
        assert [row[f"v{i}"] for i in range(Q.WIDTH)] == want[row["bucket"]].tolist()


def test_repeated_tokens_are_one_word():
    offsets, words = Q.word_codes(pa.array(["du du du", "du", "", "x du"], pa.large_string()))
    assert offsets.tolist() == [0, 3, 4, 4, 6]
    assert words[1] == words[2] == Q.AGAIN and words[3] == words[0] == words[5] != Q.AGAIN


def test_pooling_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(Q.BUCKETS + 1, Q.WIDTH)).astype(np.float32)
    texts = pa.array(["a b c " * 50, "", "d", "e f"], pa.large_string())
    whole = Q.pooled(texts, vectors)
    monkeypatch.setattr(Q, "SLICE", 28)
    assert np.allclose(Q.pooled(texts, vectors), whole, atol=1e-5)
    assert np.allclose(whole[1], vectors[-1])


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    truth = rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))
    held = rng.random(3000) < 0.3
    net = Q.fit_network(x, truth, held)
    scores = net.scores(rng.normal(size=(1, 5)) * 0 + x)
    for lo in (0.0, 0.25, 0.5, 0.75):
        part = held & (scores >= lo) & (scores < lo + 0.25)
        assert abs(scores[part].mean() - truth[part].mean()) < 0.12


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op3_quality(spark, sf).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.98
    clean = [r["predicted"] for r in rows if r["quality"] == 1]
    assert sum(clean) / len(clean) > 0.99


def test_edges(spark):
    docs = spark.createDataFrame(
        [(i, "good words here now" if i % 2 else "BAD!! $$$ ###", 1) for i in range(60)] + [(100, None, 1), (101, "", 1), (0, "x", 1), (None, "y", 1)],
        "doc_id long, text string, Score int",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (999, 1), (1, 0)], "doc_id long, quality int")
    model = Q.fit(docs, labels, ~held_out())
    out = Q.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"]
    rows = out.collect()
    assert len(rows) == 64 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert Q.score(docs.limit(0), model).count() == 0
    none = Q.fit(docs, labels.limit(0), ~held_out())
    assert Q.score(docs, none).select("score").distinct().collect()[0][0] == 0.5
    one = Q.fit(docs, labels.where("quality = 1"), ~held_out())
    assert Q.score(docs, one).agg(F.min("score")).first()[0] > 0.5
    assert Q.fit(docs.limit(0), labels, ~held_out()).network.constant == 0.5


def test_never_learns_from_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "BAD!!") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (
        [r["score"] for r in Q.score(docs, Q.fit(docs, x, ~held_out())).orderBy("doc_id").collect()] for x in (labels, flipped)
    )
    assert one == other


def test_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    draw = lambda most, parts: {r["doc_id"] for r in Q.labelled_sample(labels.repartition(parts), F.lit(True), "quality", "doc_id", most).collect()}
    assert len(draw(500, 3)) == 500 and draw(500, 3) == draw(500, 11)
    assert draw(500, 3) < draw(2000, 3) and len(draw(100_000, 3)) == 30_000
