import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import communities as cm


def greedy(m, threshold, min_size):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold - 1e-12
    order = sorted((i for i in range(len(m)) if near[i].sum() >= min_size), key=lambda i: (-near[i].sum(), i))
    taken, out = set(), []
    for i in order:
        members = set(np.nonzero(near[i])[0].tolist())
        if not members & taken:
            taken |= members
            out.append((i, members))
    return out


def frame(spark, m):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(4)


@pytest.mark.parametrize(
    "seed,options",
    [
        (0, {}), (1, {}), (3, {}), (4, {}), (5, {}),
        (2, {"method": "grid", "panel_bytes": 900, "lanes": 2}),
    ],
)
def test_equal_to_the_sequential_rule(spark, seed, options):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(120, 3))
    m[:40] = m[0] + rng.normal(scale=0.01 * seed, size=(40, 3))  # a third in one clump
    got = {}
    for r in cm.communities(frame(spark, m), 0.9, 6, **options).collect():
        got.setdefault((r.community_id, r.centre_id), set()).add(r.channel_id)
    want = {(n, c): members for n, (c, members) in enumerate(greedy(m, 0.9, 6))}
    assert got == want and len(want) > 2


@pytest.mark.parametrize("block,options", [(8, {}), (32, {"panel_bytes": 200, "lane_rows": 7})])
def test_blocks_of_bits(spark, block, options):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(150, 3))
    m[:50] = m[0] + rng.normal(scale=0.02, size=(50, 3))
    got = {}
    ids = np.arange(150) * 7 - 300  # ids are no numbers of rows
    rows = [(int(i), v.tolist()) for i, v in zip(ids, m)] + [(None, [1.0] * 3), (5000, None)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(5)
    for r in cm.communities(df, 0.9, 5, block, **options).collect():
        got.setdefault((r.community_id, r.centre_id, r.size), set()).add(r.channel_id)
    found = greedy(m, 0.9, 5)
    assert got == {(n, ids[c], len(x)): set(ids[sorted(x)].tolist()) for n, (c, x) in enumerate(found)} and len(found) > 2


def test_vectors_are_compared_once(spark, monkeypatch):
    calls = []
    plain = cm.compare_in_groups
    monkeypatch.setattr(cm, "compare_in_groups", lambda *a, **b: calls.append(1) or plain(*a, **b))
    rng = np.random.default_rng(7)
    assert cm.communities(frame(spark, rng.normal(size=(120, 3))), 0.9, 4).count() and calls == [1]


def test_a_vector_is_sent_once_a_shelf(spark, monkeypatch):
    sent, plain = [], cm.compare_in_groups
    monkeypatch.setattr(cm, "compare_in_groups", lambda m, v, *a, **b: sent.append(v.count()) or plain(m, v, *a, **b))
    m = np.random.default_rng(10).normal(size=(400, 3))
    numbered = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "num long, vec array<double>")
    near = cm.near_bits(numbered, 400, 0.9, 8)  # 50 blocks
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert near.agg({"members": "sum"}).first()[0] == (unit @ unit.T >= 0.9).sum()
    assert sent[0] <= 400 * 8


def test_few_members_take_two_bytes_each():
    near = np.random.default_rng(11).random((40, 64)) < np.linspace(0, 0.9, 40)[:, None]
    near[0], near[1] = False, True
    column = cm._packed(near)
    assert (cm._near(column, 64) == near).all()
    assert [len(x.as_py()) for x in column] == [min(8, 2 * n) for n in near.sum(axis=1)]


def test_nothing_found(spark):
    out = cm.communities(frame(spark, np.eye(5)), 0.9, 2)
    assert out.count() == 0 and out.columns == ["community_id", "centre_id", "size", "channel_id"]


def test_labels(spark):
    channels = spark.createDataFrame([(1,), (2,), (3,)], "channel_id bigint")
    members = spark.createDataFrame([(0, 1, 2, 1), (9, 2, 2, 2)], "community_id bigint, centre_id bigint, size bigint, channel_id bigint")
    plain = {r.channel_id: (r.label, r.label_name) for r in cm.labels(channels, members).collect()}
    assert plain[1][0] == plain[3][0] == 0 and plain[2] == (9, "unlabelled")
    apart = {r.channel_id: r.label for r in cm.labels(channels, members, distinct_noise=True).collect()}
    assert apart == {1: 0, 2: 9, 3: -1}
    names = spark.createDataFrame([(9, "nine")], "label bigint, label_name string")
    named = {r.channel_id: r.label_name for r in cm.labels(channels, members, names).collect()}
    assert named[2] == "nine" and named[1] == "unlabelled"


def test_projection_and_export(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = frame(spark, rng.normal(size=(50, 6)))
    pos = cm.project_2d(v)
    spread = pos.agg(F.variance("pos_x").alias("x"), F.variance("pos_y").alias("y")).first()
    assert spread.x >= spread.y > 0
    m = np.array([r.vec for r in v.orderBy("id").collect()])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    _, _, axes = np.linalg.svd(unit - unit.mean(axis=0))
    for axis, name in zip(axes[:2], ("pos_x", "pos_y")):
        want = unit @ (axis * np.sign(axis[np.abs(axis).argmax()]))
        assert np.allclose([r[name] for r in pos.orderBy("channel_id").collect()], want, atol=1e-6)
    again = {r.channel_id: (r.pos_x, r.pos_y) for r in cm.project_2d(v.repartition(7)).collect()}
    assert all(np.allclose((r.pos_x, r.pos_y), again[r.channel_id], atol=1e-6) for r in pos.collect())
    labelled = cm.labels(v.select(F.col("id").alias("channel_id")), cm.communities(v, 0.99, 2))
    cm.write_export(cm.export_rows(labelled, pos), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["channel_id", "labels", "pos_x", "pos_y"] and back.count() == 50


def test_ranks_meet_tiles_and_not_pairs(spark):
    m = np.random.default_rng(12).normal(size=(600, 3))
    numbered = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "num long, vec array<double>")
    near = cm.near_bits(numbered, 600, 0.8, 64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want, got = unit @ unit.T >= 0.8, np.zeros((600, 600), int)
    rows = near.collect()
    for r in rows:
        row, place = cm.Tile(r.places, r.sizes, r.bits, 64).pairs()
        np.add.at(got, (r.own * 64 + row, r.block * 64 + place), 1)
    assert (got == want).all() and len(rows) < 600 * 10 / 4
