import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import similarity as sim
from affinis.operators import streamed


def _dense(spark, rows, seed):
    m = np.random.default_rng(seed).normal(size=(rows, 6))
    m[1] = m[2] = m[4]  # ties
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>").repartition(5)


def _sparse(spark, rows, seed):
    rng = np.random.default_rng(seed)
    lists = [(i, sorted(rng.choice(40, rng.integers(0, 12), replace=False).tolist())) for i in range(rows)]
    return spark.createDataFrame(
        [(i, idx, [float(x) for x in rng.random(len(idx))]) for i, idx in lists], "id long, idx array<int>, val array<double>"
    ).repartition(3)


def found(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"lanes": 3}, {"panel_bytes": 500}])
def test_stream_equals_the_other_placements(spark, options):
    df, other = _dense(spark, 300, 1), _dense(spark, 170, 2)
    weighted = other.withColumn("weight", F.col("id") % 4).withColumn("leader", F.col("id"))
    for search in (
        lambda **o: sim.top_k(df, df, 7, exclude="self", **o),
        lambda **o: sim.top_k(df, other, 5, metric="euclidean", **o),
        lambda **o: sim.threshold_join(df, other, 0.5, **o),
        lambda **o: sim.threshold_counts(df, other, 0.5, **o),
        lambda **o: sim.leaders(df, weighted, 0.5, **o),
    ):
        assert found(search(method="stream", **options)) == found(search())
    rows = _sparse(spark, 200, 3)
    given = {"metric": "dot", "dim": 40, "exclude": "self"}
    assert found(sim.top_k(rows, rows, 5, method="stream", **given, **options)) == found(sim.top_k(rows, rows, 5, **given))


def test_no_side_is_copied_by_panels(spark, monkeypatch):
    """Tables beyond the broadcast bound: both sides are sent once, whatever the number of panels."""
    df, sent, plain = _dense(spark, 900, 4), [], streamed.panel_blocks
    read, written = [], streamed.written_blocks
    monkeypatch.setattr(sim, "_grid_task", None)
    monkeypatch.setattr(streamed, "panel_blocks", lambda rows, most: sent.append((rows.count(), rows.rdd.getNumPartitions())) or plain(rows, most))
    monkeypatch.setattr(streamed, "written_blocks", lambda rows: read.append(rows.count()) or written(rows))
    bound = {"broadcast_bytes": 1 << 12, "panel_bytes": 1 << 10}
    want = found(sim.top_k(df, df, 4, exclude="self"))
    assert found(sim.top_k(df, df, 4, exclude="self", **bound)) == want
    assert sent[0][0] == 900 and sent[0][1] > 40 and read == [900]


def test_a_task_compares_a_bounded_number_of_pairs(spark, monkeypatch):
    df = _dense(spark, 900, 5).coalesce(1)
    want = found(sim.top_k(df, df, 4, exclude="self"))
    monkeypatch.setattr(streamed, "TASK_PAIRS", 9000)
    hits = sim.top_k(df, df, 4, exclude="self", broadcast_bytes=1 << 18)
    assert hits.rdd.getNumPartitions() >= 90 and found(hits) == want


def test_empty_sides(spark):
    df = _dense(spark, 20, 6)
    none = df.where("id < 0")
    for left, right in ((df, none), (none, df)):
        assert sim.top_k(left, right, 3, method="stream", dim=6).count() == 0
        assert sim.threshold_counts(left, right, 0.5, method="stream", dim=6).count() == 0


def test_terms_of_many_rows_are_columns():
    rng = np.random.default_rng(7)

    def rows(n):
        dense = rng.random((n, 30)) * (rng.random((n, 30)) < np.linspace(1, 0.01, 30))
        at, idx = np.nonzero(dense)
        return dense, sim.Sparse(np.searchsorted(at, np.arange(n + 1)), idx, dense[at, idx], 30)

    (a, left), (b, right) = rows(200), rows(90)
    assert np.allclose(left.dots(right), a @ b.T, atol=1e-12) and np.allclose(right.dots(left), b @ a.T, atol=1e-12)
    assert left._postings[4].shape[1] > 15 and 0 < len(left._postings[1]) < len(left.idx) / 4  # few entries are left to meet
    empty = sim._no_rows(30, True)
    assert left.dots(empty).shape == (200, 0) and empty.dots(left).shape == (0, 200)
