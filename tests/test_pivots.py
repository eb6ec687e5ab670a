import numpy as np
import pytest

from affinis.operators import pivots
from affinis.operators import similarity as S
from affinis.operators import streamed
from affinis.operators.pivots import PivotIndex, spread_out

SCHEMA = "id long, vec array<double>"


def clustered(seed, clusters, each, dim=24, noise=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = np.repeat(centres, each, axis=0) + noise * rng.normal(size=(clusters * each, dim)) / np.sqrt(dim)
    return [(i, v.tolist()) for i, v in enumerate(rows * rng.uniform(0.1, 9, (len(rows), 1)))]


@pytest.fixture(scope="module")
def rows():
    out = clustered(1, 30, 40)
    out += [(2000 + i, out[7][1]) for i in range(90)]  # many copies: ties go to smaller ids
    out += [(3000 + i, [0.0] * 24) for i in range(5)] + [(4000, [-x for x in out[3][1]]), (None, out[1][1]), (4001, None)]
    return out


def pairs(df):
    return sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["neighbour_id"], round(r["sim"], 9)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"pivots": 1}, {"panel_bytes": 1 << 12, "lane_rows": 16}])
def test_same_as_all_pairs(spark, rows, options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    index = PivotIndex(df, **options)
    assert index.rows == len(rows) - 2
    for threshold in (0.3, 0.85, 0.9999):
        assert pairs(index.threshold_join(df, threshold)) == pairs(S.threshold_join(df, df, threshold))
    for k, own in ((50, True), (7, False)):
        found = index.top_k(df, k, exclude_self=own)
        assert ranked(found) == ranked(S.top_k(df, df, k, exclude="self" if own else "none"))


def test_other_queries(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(-1, rows[5][1]), (-2, [0.0] * 24), (-3, [1.0] + [0.0] * 23)], SCHEMA)
    index = PivotIndex(df)
    assert ranked(index.top_k(queries, 12)) == ranked(S.top_k(queries, df, 12))
    assert pairs(index.threshold_join(queries, 0.3)) == pairs(S.threshold_join(queries, df, 0.3))


def test_less_than_half_is_compared(spark):
    rows = clustered(2, 60, 50)
    df = spark.createDataFrame(rows, SCHEMA)
    for search in (lambda x: x.threshold_join(df, 0.85), lambda x: x.top_k(df, 10, exclude_self=True)):
        index = PivotIndex(df)
        search(index).count()
        assert index.compared < 0.2 * len(rows) ** 2


def test_few_rows_and_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    assert PivotIndex(none).top_k(none, 3).count() == 0
    assert PivotIndex(none).threshold_join(one, 0.1).count() == 0
    assert PivotIndex(one).top_k(one, 3, exclude_self=True).count() == 0
    assert ranked(PivotIndex(one).top_k(one, 3)) == [(1, 1, 1, 1.0)]
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], SCHEMA)
    assert ranked(PivotIndex(zeros).top_k(zeros, 3)) == ranked(S.top_k(zeros, zeros, 3))


def test_wrong_vectors_raise(spark):
    for bad in ([1.0], [1.0, None], [1.0, float("nan")]):
        df = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], SCHEMA).coalesce(1)
        with pytest.raises(Exception, match="vector of id 2"):
            PivotIndex(df)


def test_pivots_are_far_apart():
    sample = np.eye(4)[[0, 0, 1, 2, 0, 3]]
    assert len(spread_out(sample, 9)) == 4 and len(spread_out(sample, 2)) == 2


def test_a_query_is_sent_once_a_shelf(spark, monkeypatch):
    vectors = np.random.default_rng(8).normal(size=(600, 16))  # far from each other: queries visit most groups
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    sent, plain = [], pivots.compare_in_groups
    monkeypatch.setattr(pivots, "compare_in_groups", lambda m, v, *a, **b: sent.append(v.count()) or plain(m, v, *a, **b))
    index = PivotIndex(df)
    found = ranked(index.top_k(df, 5, exclude_self=True))
    assert index.compared > 20 * 600 and max(sent) <= 600 * 10
    assert found == ranked(S.top_k(df, df, 5, exclude="self"))


def test_the_join_sends_no_query_to_a_shelf(spark, monkeypatch):
    vectors = np.random.default_rng(9).normal(size=(700, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    sent, read, plain = [], [], streamed.written_blocks
    monkeypatch.setattr(pivots, "compare_in_groups", lambda m, v, *a, **b: sent.append(v.count()))
    monkeypatch.setattr(streamed, "written_blocks", lambda rows: read.append(rows.count()) or plain(rows))
    index = PivotIndex(df, panel_bytes=1 << 11)  # 16 vectors
    assert len(index.firsts) > 20
    assert pairs(index.threshold_join(df, 0.3)) == pairs(S.threshold_join(df, df, 0.3))
    assert sent == [] and read == [700]
