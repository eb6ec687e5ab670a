import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import vectors as V
from affinis.operators import similarity as sim


def _vectors(n=90, d=7, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    m[n // 9 : n // 9 + n // 3] = m[n // 9]  # a third are copies
    m[n // 2] = 0.0
    return m


def _frame(spark, m, start=0):
    rows = [(i + start, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(5)


def _cos(a, b):
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    s = a @ b.T / np.where(na == 0, 1, na)[:, None] / np.where(nb == 0, 1, nb)[None, :]
    return np.round(s, 9)


def _brute(s, k, skip=0, own=False):
    out = {}
    for i in range(len(s)):
        order = sorted((j for j in range(s.shape[1]) if not (own and i == j)), key=lambda j: (-s[i, j], j))
        out[i] = order[skip : skip + k]
    return out


PLANS = [
    {"method": "broadcast_right"},
    {"method": "broadcast_left"},
    {"method": "grid", "panel_bytes": 700, "lanes": 3},
    {"method": "grid", "panel_bytes": 1 << 20, "lanes": 1},
]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("exclude,skip", [("self", 0), ("none", 0), ("top1", 1)])
def test_top_k_matches_brute_force(spark, plan, exclude, skip):
    m = _vectors()
    df = _frame(spark, m)
    got = {}
    for r in sim.top_k(df, df, 6, exclude=exclude, **plan).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbour_id)
        assert r.rank == len(got[r.query_id])
    assert got == _brute(_cos(m, m), 6, skip, exclude == "self")


@pytest.mark.parametrize("plan", PLANS)
def test_threshold_operators_agree(spark, plan):
    m = _vectors(seed=5)
    df = _frame(spark, m)
    s = _cos(m, m)
    pairs = {(r.left_id, r.right_id) for r in sim.threshold_join(df, df, 0.6, **plan).collect()}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(s >= 0.6))}  # no score is that near
    counts = {r.id: r.members for r in sim.threshold_counts(df, df, 0.6, **plan).collect()}
    assert counts == {i: int((s[i] >= 0.6).sum()) for i in range(len(m))}
    weighted = df.withColumn("weight", F.col("id") % 4).withColumn("leader", F.col("id"))
    best = {r.id: (r.weight, r.leader) for r in sim.leaders(df, weighted, 0.6, **plan).collect()}
    want = {}
    for i in range(len(m)):
        near = [j for j in range(len(m)) if s[i, j] >= 0.6]
        if near:
            j = min(near, key=lambda j: (-(j % 4), j))
            want[i] = (j % 4, j)
    assert best == want


def test_grid_sends_a_row_once_a_shelf(spark, monkeypatch):
    vectors = np.random.default_rng(3).normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<double>")
    for panels, lanes, want in ((401, None, 6), (5, 3, 1), (2000, None, 6)):
        assert sim._shape(panels, 1 << 17, lanes, 36) == (want, lanes or 6)
    assert sim._shape(30, 64 << 20, None, 36) == (30, 2)  # panels as large as a shelf
    sent = spark.sparkContext.accumulator(0)
    task = sim._grid_task

    def counted(batches, **options):
        def seen():
            for batch in batches:
                sent.add(batch.num_rows)
                yield batch

        yield from task(seen(), **options)

    monkeypatch.setattr(sim, "_grid_task", counted)
    found = sim.top_k(df, df, 4, exclude="self", method="grid", panel_bytes=1024)  # 57 panels
    rows = sorted(tuple(r)[:3] for r in found.collect())
    cells = 3 * spark.sparkContext.defaultParallelism
    assert sent.value <= 900 * 3 * (cells**0.5 + 1)
    monkeypatch.undo()
    assert rows == sorted(tuple(r)[:3] for r in sim.top_k(df, df, 4, exclude="self").collect())


def test_metrics_and_cutoff(spark):
    m = _vectors(30, seed=9)
    df = _frame(spark, m)
    for metric, s in (
        ("dot", np.round(m @ m.T, 9)),
        ("euclidean", np.round(-np.linalg.norm(m[:, None] - m[None], axis=2), 9)),
    ):
        rows = sim.top_k(df, df, 3, exclude="self", metric=metric).collect()
        for r in rows:
            assert abs(r.sim - s[r.query_id, r.neighbour_id]) < 1e-9
    assert sim.top_k(df, df, 30, min_sim=0.5).where("sim < 0.5").count() == 0


def test_bipartite_search_and_fewer_rows_than_k(spark):
    m = _vectors(12, seed=3)
    q = _frame(spark, m[:4], start=1000)
    got = sim.top_k(q, _frame(spark, m), 50).collect()
    assert len(got) == 4 * 12


def test_sparse_vectors_equal_dense_ones(spark):
    m = np.where(np.abs(_vectors(40, 9, 2)) > 0.8, _vectors(40, 9, 2), 0.0)
    rows = [(i, [int(x) for x in np.nonzero(v)[0]], [float(x) for x in v[np.nonzero(v)[0]]]) for i, v in enumerate(m)]
    sparse = spark.createDataFrame(rows, "id bigint, idx array<int>, val array<double>").repartition(3)
    dense = _frame(spark, m)
    key = ["query_id", "rank"]
    for plan in PLANS:
        for metric in sim.METRICS:
            a = sim.top_k(sparse, sparse, 4, exclude="self", dim=9, metric=metric, **plan).orderBy(*key).collect()
            b = sim.top_k(dense, dense, 4, exclude="self", metric=metric, **plan).orderBy(*key).collect()
            assert [(x.query_id, x.rank, x.neighbour_id) for x in a] == [(x.query_id, x.rank, x.neighbour_id) for x in b]
            assert np.allclose([x.sim for x in a], [x.sim for x in b], atol=1e-12)


def test_wrong_arguments(spark):
    df = _frame(spark, _vectors(5))
    with pytest.raises(ValueError):
        sim.top_k(df, df, exclude="x")
    with pytest.raises(ValueError):
        sim.top_k(df, df, method="x")
    with pytest.raises(ValueError):
        sim.top_k(df, df, method="broadcast_right", broadcast_bytes=10)
    with pytest.raises(ValueError):
        sim.top_k(df, df, method="broadcast_left", broadcast_bytes=10)
    assert sim.top_k(df, df, 2, broadcast_bytes=10).count() == 10  # auto falls back to the grid


@pytest.mark.parametrize("plan", PLANS)
def test_distances_of_copies_are_zero(spark, plan):
    m = _vectors(40, 9, 4) + 100.0
    df = _frame(spark, m)
    got = {}
    for r in sim.top_k(df, df, 5, exclude="self", metric="euclidean", **plan).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbour_id)
        assert r.sim == pytest.approx(-np.linalg.norm(m[r.query_id] - m[r.neighbour_id]), abs=1e-12)
    assert got == _brute(np.round(-np.linalg.norm(m[:, None] - m[None], axis=2), 9), 5, own=True)
    near = {(r.left_id, r.right_id) for r in sim.threshold_join(df, df, 0.0, metric="euclidean", **plan).collect()}
    assert near == {(i, j) for i in range(40) for j in range(40) if (m[i] == m[j]).all()}


def test_thresholds_use_raw_scores(spark):
    angles = [(i, [c, (1 - c * c) ** 0.5]) for i, c in enumerate([0.85 - 3e-10, 0.85 + 3e-10])]
    right = spark.createDataFrame(angles, "id bigint, vec array<double>")
    left = spark.createDataFrame([(9, [1.0, 0.0])], "id bigint, vec array<double>")
    assert [r.right_id for r in sim.threshold_join(left, right, 0.85).collect()] == [1]
    hits = sim.top_k(left, right, 2, min_sim=0.85).collect()
    assert [(r.neighbour_id, r.sim) for r in hits] == [] or hits[0].neighbour_id == 1


@pytest.mark.parametrize("vec", [[1.0], [1.0, 0.0, 0.0], [1.0, None], [1.0, float("nan")]])
def test_broken_vectors_raise(spark, vec):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, vec)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    with pytest.raises(Exception, match="vector of id 3"):
        sim.top_k(df, df, 2, dim=2).collect()


def test_null_vectors_take_no_part(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [1.0, 1.0])], "id bigint, vec array<double>")
    for plan in PLANS[:3]:
        assert {r.query_id for r in sim.top_k(df, df, 3, **plan).collect()} == {1, 3}
    with pytest.raises(ValueError, match="cosin"):
        sim.top_k(df, df, 3, metric="cosin")


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    cos = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert cos == [pytest.approx(0.96), 0.0]
    unit = df.withColumn("n", V.norm(F.col("a"))).select(V.l2_normalise(F.col("a"), F.col("n")).alias("u"))
    assert [r["u"] for r in unit.collect()] == [[0.6, 0.8], [0.0, 0.0]]
    mean = df.agg(V.as_array(V.mean_vector(F.col("a"))).alias("m")).first()["m"]
    assert mean == [1.5, 2.0]


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],)], "t array<string>")
    rows = V.hashed_vectors(df, "t", "v").select(V.as_array(F.col("v")).alias("v")).collect()
    nonzero = sorted(x for x in rows[0]["v"] if x)
    assert nonzero == [pytest.approx(1 / 5**0.5), pytest.approx(2 / 5**0.5)]
    assert not any(rows[1]["v"])
