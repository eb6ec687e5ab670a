"""Every named query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from affinis.queries import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind in "iu":
            frame[c] = frame[c].astype("int64")
        elif frame[c].dtype.kind == "f":
            frame[c] = frame[c].astype("float64")
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    got = all_queries()[name](spark, SF).toPandas()
    if name in all_oracles():
        want = duck.execute(all_oracles()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["channel_id", "rank", "link", "title", "sim"]
