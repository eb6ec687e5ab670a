"""Every query of the package that has SQL against it, and the pipeline against its own operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affinis.llm.queries import all_oracles, all_queries
from affinis.llm.query_quality import ACCEPTED, op3_quality
from affinis.llm.secret_scan import scan
from tests.llm.test_decontaminate import by_force as leaks_by_force
from tests.llm.test_jaccard import by_force as classes_by_force

TABLES = "documents embeddings pages benchmark labels conversations".split()


def same(x):
    return None if x is None or x != x else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_oracle(spark, sf, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = all_queries()[name](spark, sf)
    want = duck.sql(all_oracles()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted(map(repr, ([same(x) for x in r] for r in found)))
    assert rows(tuple(r) for r in got.select(columns).collect()) == rows(want.select(*columns).fetchall())


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in all_queries()) == list(range(1, 14))


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding",
    ]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
        kept[i] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(kept[i]) == docs.count(), name
    accepted = {r["doc_id"] for r in op3_quality(spark, sf).where(F.col("score") >= ACCEPTED).collect()}
    assert kept[0] == {k: before[k] for k in accepted}
    assert set(kept[1]) == {cls for _, cls, _ in classes_by_force(list(kept[0].items()))}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    short = {k: v for k, v in kept[1].items() if len(v) < 1500}
    leaking = {doc for doc, _ in leaks_by_force(short.items(), items)}
    assert set(kept[2]) & set(short) == set(short) - leaking
    assert set(kept[3]) == set(kept[2]) == set(kept[4])
    for key, text in kept[3].items():
        had = scan(kept[2][key].encode())
        assert ("[SECRET]" in text) == bool(had) and not any(not added for *_, added in scan(text.encode()))
    run = corpus_pipeline.run(spark, sf)
    assert run.columns == [*columns, "ids", "begins", "ends"]
    assert {r["doc_id"]: r["ids"] for r in run.collect()} == {r["doc_id"]: r["ids"] for r in docs.collect()}


def test_stages_on_empty_tables(spark, sf, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", None, None, 1)], docs.schema)
        assert stage(spark, odd, str(tmp_path)).count() == 3, name
