import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import hyperplanes as H
from affinis.operators import prefixes as P
from affinis.operators import similarity as S
from tests.test_pivots import SCHEMA, clustered, pairs

SPARSE = "id long, idx array<int>, val array<double>"


@pytest.mark.parametrize("similarity,wanted", [(0.3, 0.95), (0.85, 0.95), (0.95, 0.99)])
def test_tables_reach_the_recall(similarity, wanted):
    bits, tables = H.choose_tables(similarity, wanted)
    side = 1 - np.arccos(similarity) / np.pi
    assert 1 - (1 - side**bits) ** tables >= wanted
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = similarity * x + np.sqrt(1 - similarity**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    planes = rng.normal(size=(32, tables * bits))
    same = ((x @ planes > 0) == (y @ planes > 0)).reshape(400, tables, bits).all(2).any(1)
    assert same.mean() > wanted - 0.05


def test_choices_that_are_refused():
    for bad in ((0.5, 1.0), (-0.95, 0.9), (0.5, 0.0)):
        with pytest.raises(ValueError):
            H.choose_tables(*bad)
    assert H.choose_tables(-0.5, 0.999)[0] == 1


@pytest.mark.parametrize("placement", [{}, {"panel_bytes": 1 << 12, "lane_rows": 16}])
def test_approximate_join(spark, placement):
    rows = clustered(3, 25, 30) + [(2000 + i, [0.0] * 24) for i in range(3)] + [(3000 + i, [1.0] + [0.0] * 23) for i in range(80)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (5000, None)], SCHEMA).repartition(5)
    bits, tables = H.choose_tables(0.85, 0.95, len(rows))
    index = H.HyperplaneIndex(df, bits, tables, **placement)
    exact, found = pairs(S.threshold_join(df, df, 0.85)), pairs(index.threshold_join(0.85))
    assert len(set(found)) == len(found) and set(found) <= set(exact)
    assert len(found) >= 0.95 * len(exact)
    assert index.sizes().agg({"compared": "sum"}).first()[0] < 0.5 * tables * len(rows) ** 2
    near = index.top_k(10)
    got = H.recall(near, S.top_k(df, df, 10, exclude="self"), ["query_id", "neighbour_id"]).first()
    assert got["recall"] >= 0.9
    ranks = {}
    for r in near.collect():
        ranks.setdefault(r["query_id"], []).append(r["rank"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in ranks.values())


def test_many_tables_send_a_vector_a_few_times(spark, monkeypatch):
    vectors = np.random.default_rng(9).normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    index = H.HyperplaneIndex(df, 4, 40)  # 40 tables of 16 buckets
    sent, plain = [], H.compare_in_groups
    monkeypatch.setattr(H, "compare_in_groups", lambda m, *a, **b: sent.append(m.count()) or plain(m, *a, **b))
    found, near = pairs(index.threshold_join(0.3)), index.top_k(10)
    top = sorted(tuple(r) for r in near.select("query_id", "rank", "neighbour_id").collect())
    assert sent == [300, 300]
    monkeypatch.setattr(H.HyperplaneIndex, "meets_all", lambda self: False)  # the same pairs as by buckets
    assert found == pairs(index.threshold_join(0.3)) and sent[2:] == [300 * 40]
    assert top == sorted(tuple(r) for r in index.top_k(10).select("query_id", "rank", "neighbour_id").collect())


def test_recall_counts_other_scores_in_one_pass(spark):
    exact = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.4), (2, 3, 0.4), (2, 4, 0.9)], "left_id long, right_id long, sim double")
    found = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.41), (2, 4, 0.9)], exact.schema)
    assert H.recall(found, exact, ["left_id", "right_id"]).first() == (4, 3, 0.75, 1)


def test_approximate_join_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.HyperplaneIndex(none, 4, 3).threshold_join(0.5).count() == 0
    zeros = spark.createDataFrame([(1, [0.0, 0.0])], SCHEMA)
    assert H.HyperplaneIndex(zeros, 4, 3).top_k(3).count() == 0


def sparse_rows(seed, n, dim=200, terms=12):
    """Rows of a few common and some rare terms, of unit length, and near copies."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, dim + 1)
    out = []
    for i in range(n):
        if i % 5 == 4:
            idx, val = out[-1][1], np.array(out[-1][2]) * rng.uniform(0.7, 1.3, len(out[-1][2]))
        else:
            idx = rng.choice(dim, terms, False, share / share.sum()).tolist()
            val = rng.uniform(0.1, 3, terms) * np.log1p(np.array(idx) + 1)
        out.append((i, list(idx), (val / np.linalg.norm(val)).tolist()))
    return out


@pytest.mark.parametrize("placement", [{}, {"panel_bytes": 1 << 12, "lane_rows": 16}])
@pytest.mark.parametrize("threshold", [0.4, 0.8, 0.99])
def test_prefix_lists(spark, threshold, placement):
    rows = sparse_rows(5, 400)
    rows += [(1000 + i, [199, 3, 0], [0.8, 0.48, 0.36]) for i in range(60)] + [(2000, [], []), (2001, [0], [0.0]), (2002, [0], [1.0])]
    df = spark.createDataFrame([*rows, (None, [1], [1.0]), (3000, None, None)], SPARSE).repartition(5)
    index = P.PrefixLists(df, threshold, 200, **placement)
    found = pairs(index.join())
    assert len(set(found)) == len(found)
    assert found == pairs(S.threshold_join(df, df, threshold, metric="dot", dim=200))
    if threshold == 0.8:
        met = sum(r["members"] ** 2 for r in index.sizes().collect())
        assert met < 0.5 * sum(r["rows"] ** 2 for r in P.term_table(df).collect())


def test_frequent_terms_have_no_lists(spark):
    rows = [(i, [0, 1, 10 + i], [0.5, 0.5, 0.7071]) for i in range(200)]
    index = P.PrefixLists(spark.createDataFrame(rows, SPARSE), 0.8, 300)
    assert {r["group"] for r in index.sizes().collect() if r["members"] > 1} == set()  # rows share only two frequent terms
    assert pairs(index.join()) == [(i, i, round(0.5 + 0.7071**2, 9)) for i in range(200)]


def test_prefix_lists_refuse(spark):
    df = spark.createDataFrame([(1, [0, 7], [1.0, 1.0])], SPARSE)
    with pytest.raises(ValueError, match="positive"):
        P.PrefixLists(df, 0.0, 8)
    with pytest.raises(Exception, match="outside"):
        P.PrefixLists(df, 0.5, 7)
    with pytest.raises(ValueError, match="bytes"):
        P.prefix_rows(df, 0.5, 1 << 30)
    assert P.PrefixLists(df.limit(0), 0.5, 8).join().count() == 0


def test_rows_of_many_lists_meet_panel_by_panel(spark, monkeypatch):
    """A row with 40 listed terms was sent 40 times."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        idx = np.sort(rng.choice(60, 50, False))
        val = rng.uniform(0.1, 1, 50) if i % 6 else np.ones(50)
        rows.append((i, idx.tolist(), (val / np.linalg.norm(val)).tolist()))
    df = spark.createDataFrame(rows, SPARSE).repartition(5)
    index = P.PrefixLists(df, 0.9, 60)
    sizes = index.sizes().cache()
    panels, lanes = index.shape(sizes)
    assert panels + lanes < sum(r["members"] for r in sizes.collect()) / 240
    found = pairs(index.join())
    assert found == pairs(S.threshold_join(df, df, 0.9, metric="dot", dim=60))
    assert len(found) == len(set(found)) > 240
    monkeypatch.setattr(P.PrefixLists, "shape", lambda self, sizes: None)  # the same pairs as by lists
    assert found == pairs(index.join())


def _wide(spark):
    vectors = np.random.default_rng(9).normal(size=(300, 16))
    vectors[1] = vectors[2] = vectors[4]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [0.0] * 16), (901, None), (None, [1.0] * 16)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_vectors_of_several_panels_are_streamed(spark, monkeypatch):
    """A vector was sent to every panel and to every lane (F7)."""
    df = _wide(spark)
    small, large = H.HyperplaneIndex(df, 4, 40), H.HyperplaneIndex(df, 4, 40, panel_bytes=1 << 12)
    monkeypatch.setattr(H.HyperplaneIndex, "meets_all", lambda self: True)
    tops = [sorted(tuple(r)[:3] for r in x.top_k(10).collect()) for x in (small, large)]
    found = [pairs(x.threshold_join(0.3)) for x in (small, large)]
    sent, plain = [], H.streamed.written_blocks
    monkeypatch.setattr(H.streamed, "written_blocks", lambda rows: sent.append(rows.count()) or plain(rows))
    monkeypatch.setattr(H, "compare_in_groups", None)
    again = H.HyperplaneIndex(df, 4, 40, panel_bytes=1 << 12)
    assert [pairs(again.threshold_join(0.3))] * 2 == found
    assert [sorted(tuple(r)[:3] for r in again.top_k(10).collect())] * 2 == tops and sent == [300]


@pytest.mark.parametrize("tables", [3, 40])
def test_recall_of_a_join_in_slices(spark, tables):
    """All pairs of both joins were on disk at once (F7)."""
    df, steps = _wide(spark), []
    index = H.HyperplaneIndex(df, 4, tables)

    def search(some):
        found, exact = index.threshold_join(0.2, some), S.threshold_join(df if some is None else df.where(some), df, 0.2)
        steps.append(exact.count())
        return found.withColumn("sim", F.col("sim") + F.when(F.col("left_id") % 7 == 0, 0.1).otherwise(0.0)), exact

    keys = ["left_id", "right_id"]
    whole = H.recall(*search(None), keys).first()
    del steps[:]
    setting = spark.conf.get(H._CLEAN, None)
    assert H.recall_by_slices(search, keys, df, 301, 1 << 20).first() == whole and len(steps) == 1
    assert H.recall_by_slices(search, keys, df, 301, 2000).first() == whole
    assert len(steps) > 5 and max(steps[1:]) < 4000 < sum(steps[1:]) == steps[0] == whole["exact"]
    assert 0 < whole["not_exact"] < whole["found"] <= whole["exact"] and spark.conf.get(H._CLEAN, None) == setting


def test_shuffles_of_a_slice_go_with_it(spark):
    a = spark.createDataFrame([(i, i, 0.5) for i in range(1000)], "left_id long, right_id long, sim double")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    count = lambda: sum("shuffle_" in f for d in local for _, _, names in os.walk(d) for f in names)
    spark.sparkContext._jvm.System.gc()
    before = count()
    H.recall_by_slices(lambda some: (a, a), ["left_id", "right_id"], a.withColumnRenamed("left_id", "id"), 1000, 10_000)
    assert count() <= before


def test_rows_that_meet_panel_by_panel_are_sent_once(spark, monkeypatch):
    """A row was sent to every panel and to every lane, which grows with the square of the rows (F1)."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        val = rng.uniform(0.1, 1, 50) if i % 6 else np.ones(50)
        rows.append((i, np.sort(rng.choice(60, 50, False)).tolist(), (val / np.linalg.norm(val)).tolist()))
    df = spark.createDataFrame([*rows, (500, [], [])], SPARSE).repartition(5)
    sent, panels, blocks = [], P.streamed.panel_blocks, P.streamed.written_blocks
    monkeypatch.setattr(P.streamed, "panel_blocks", lambda d, *a: sent.append(d.count()) or panels(d, *a))
    monkeypatch.setattr(P.streamed, "written_blocks", lambda d: sent.append(d.count()) or blocks(d))
    monkeypatch.setattr(P, "compare_in_groups", None)
    found = pairs(P.PrefixLists(df, 0.9, 60).join())
    assert sent == [241, 241] and found == pairs(S.threshold_join(df, df, 0.9, metric="dot", dim=60))
