import random

from pyspark.sql import functions as F

from affinis.operators import ordered as od


def _rows(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rng.random() < 0.4 else rng.randrange(1, 30)
        out.append((key, i, rng.choice([None, None, "a", "b", "c"])))
    rng.shuffle(out)
    return out


def test_row_numbers_with_a_hot_key(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, i int, v string").repartition(7)
    parts = od.ordered_parts(df, ["k"], ["i"], partitions=8)
    assert parts.select(od.PART).where("k = 0").distinct().count() > 1  # the hot key is spread
    got = {(r.k, r.i): r.n for r in od.row_numbers(parts, ["k"], ["i"], "n").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, i in enumerate(sorted(r[1] for r in rows if r[0] == k), 1):
            want[(k, i)] = n
    assert got == want


def test_previous_value(spark):
    rows = _rows(seed=2)
    df = spark.createDataFrame(rows, "k int, i int, v string").repartition(5)
    parts = od.ordered_parts(df, ["k"], ["i"], partitions=8)
    got = {r.i: r.p for r in od.previous_value(parts, ["k"], ["i"], F.col("v"), "p").collect()}
    want, last = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = last.get(k)
        if v is not None:
            last[k] = v
    assert got == want


def test_run_ids(spark):
    rng = random.Random(3)
    keys = [rng.choice("aab") for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k string").repartition(6)
    got = {r.i: r.run for r in od.run_ids(od.ordered_parts(df, [], ["i"], partitions=8), ["i"], "k", "run").collect()}
    run, want = 0, {}
    for i, k in enumerate(keys):
        run += i == 0 or k != keys[i - 1]
        want[i] = run
    assert got == want


def test_top_per_group(spark):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 9), rng.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, s int, i int").repartition(12)
    for k, salts in ((5, 4), (5, 1), (1200, 3)):
        got = sorted((r.k, r.rank, r.i) for r in od.top_per_group(df, ["k"], [F.desc("s"), F.col("i")], k, salts=salts).collect())
        want = []
        for key in {r[0] for r in rows}:
            best = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:k]
            want += [(key, n, r[2]) for n, r in enumerate(best, 1)]
        assert got == sorted(want)
