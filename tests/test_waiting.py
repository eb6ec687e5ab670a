from pyspark.sql import functions as F

from affinis.streaming import lookups as L


def arrivals(spark, path, schema, batches):
    """One file per arrival, read one per trigger."""
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        cols = [F.timestamp_seconds(c).alias(c) if c.endswith("_at") else F.col(c) for c in df.columns]
        df.select(*cols).coalesce(1).write.mode("append").parquet(path)
    typed = schema.replace("_at long", "_at timestamp")
    return spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_pages_answer_and_others_expire(spark, tmp_path):
    asked = [
        [(1, "@early_bird", 1000), (2, "@never_lands", 1000), (3, "not a handle!", 1000), (4, "@too_late", 1000), (5, "@lands_twice", 1000)],
        [(6, "@early_bird", 2000)],
        [(7, "@the_end", 900_000)],
        [(8, "@the_end", 900_001)],
    ]
    landed = [
        [("early_bird", "<p>", 1500), ("lands_twice", "a", 1000), ("nobody", "x", 1100), (None, "y", 1100)],
        [("lands_twice", "b", 1600), ("too_late", "z", 4601)],
        [("the_last", "", 900_000)],
        [("the_last", "", 900_001)],
    ]
    requests = arrivals(spark, f"{tmp_path}/asked", "request_id long, text string, asked_at long", asked)
    pages = arrivals(spark, f"{tmp_path}/landed", "handle string, html string, landed_at long", landed)
    waiting = L.await_pages(requests, pages, "3600 seconds", "1 hour")
    L.run_to_table(waiting, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r["request_id"], r["outcome"], r["html"]) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["request_id"] < 7)
    # the page of request 6 had landed before it was asked for
    assert got == [(1, "page", "<p>"), (2, "expired", None), (4, "expired", None), (5, "page", "a"), (5, "page", "b"), (6, "expired", None)]


def test_a_handle_is_resolved_once(spark, tmp_path):
    asked = [[(1, "@some_one", 1000), (2, "t.me/some_one", 1010)], [(3, "@some_one", 1020), (4, "@other_one", 1030)], [(5, "x", 1040)]]
    requests = arrivals(spark, f"{tmp_path}/asked", "request_id long, text string, asked_at long", asked)
    L.run_to_table(L.first_asked(requests), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["handle"] for r in rows) == ["other_one", "some_one"]


def memo_rows(spark, path):
    return sorted(tuple(r) for r in L.read_memo(spark, path).collect())


def test_memo_is_compacted(spark, tmp_path):
    path = f"{tmp_path}/memo"
    for batch in range(-1, 5):
        rows = [(f"h{batch}", i, batch * 10 + i, 0.5) for i in range(3)] if batch >= 0 else []
        spark.createDataFrame(rows, L.MEMO).write.parquet(f"{path}/batch={batch}")
    before = memo_rows(spark, path)
    folders = lambda: sorted(x.name for x in (tmp_path / "memo").iterdir() if x.is_dir())
    L.compact_memo(spark, path, 2)
    assert memo_rows(spark, path) == before and folders() == ["batch=-4", "batch=3", "batch=4"]
    L.compact_memo(spark, path, 4, partitions=1)
    assert memo_rows(spark, path) == before and folders() == ["batch=-6"]
    L.read_memo(spark, path).write.parquet(f"{path}/batch=1")  # a merge that was stopped before it deleted
    assert memo_rows(spark, path) == before
    assert L.read_memo(spark, path, 0).count() == 15


def test_stream_with_compaction_remembers_once(spark, tmp_path):
    asked = [[(1, "a"), (2, "b")], [(3, "a")], [(4, "c"), (5, "a")]]
    for rows in asked:
        spark.createDataFrame(rows, "request_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("request_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def resolve(batch, memo):
        new = batch.select(F.col("text").alias("handle")).distinct().join(memo.select("handle").distinct(), "handle", "left_anti")
        found = new.select("handle", F.lit(1).alias("rank"), F.lit(7).cast("long").alias("neighbour_id"), F.lit(0.5).alias("sim"))
        return batch, found

    L.remember_stream(source, f"{tmp_path}/memo", f"{tmp_path}/out", f"{tmp_path}/state", resolve, compact_every=1).awaitTermination()
    assert [r[0] for r in memo_rows(spark, f"{tmp_path}/memo")] == ["a", "b", "c"]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    assert len([x for x in (tmp_path / "memo").iterdir() if x.is_dir()]) == 2  # the merged one and the last
