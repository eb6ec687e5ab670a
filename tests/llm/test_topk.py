import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import topk as K


def by_force(rows, k):
    usable = []
    for key, vector in rows:
        if key is None or vector is None or not len(vector) or any(x is None or not np.isfinite(x) for x in vector):
            continue
        usable.append((key, tuple(int(np.floor(1024 * float(x))) for x in vector)))
    out = []
    for query in sorted({key for key, _ in usable if key % 10 == 0}):
        own = min(v for key, v in usable if key == query)
        scores = [(-sum(a * b for a, b in zip(own, v)), key) for key, v in usable if key != query and len(v) == len(own)]
        out += [(query, i + 1, key, -s) for i, (s, key) in enumerate(sorted(scores)[:k])]
    return out


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    out += [(i, out[3][1]) for i in range(300, 360)]  # many equal vectors: ties go to smaller ids
    out += [(400, None), (401, []), (402, [1.0] * 7 + [None]), (403, [float("nan")] * 8), (404, [float("inf")] + [0.0] * 7)]
    out += [(None, [1.0] * 8), (410, [0.0] * 8), (420, [1.0, 2.0, 3.0]), (421, [1.0, 0.0, 0.5]), (5, out[7][1]), (20, out[8][1])]
    return out


@pytest.mark.parametrize("k,block", [(10, 1024), (3, 4)])
def test_against_all_scores(spark, rows, k, block, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "CELLS", 100)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    assert found(K.exact_topk(df, F.col("vec_id") % 10 == 0, k)) == by_force(rows, k)


def test_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 1e5).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(K.exact_topk(df, F.col("vec_id") % 10 == 0, 5)) == by_force(rows, 5)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert K.exact_topk(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    rows = [(0, [1.0]), (1, [2.0]), (2, [-1.0])]
    assert found(K.exact_topk(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0)) == by_force(rows, 10)
    assert K.exact_topk(spark.createDataFrame(rows[:1], schema), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("large", [1e17, 1e12])
def test_what_64_bits_do_not_hold_raises(spark, large):
    df = spark.createDataFrame([(i, [large, 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        K.exact_topk(df, F.col("vec_id") % 10 == 0).collect()
