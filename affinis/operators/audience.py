"""Audience overlap: users in common for each pair of channels.

Users with few channels go into buckets; a task counts the pairs of its bucket and hands on one
row per channel pair, so the shuffle carries counts. A user with many channels would pair them all
in one place; such users are split by channel panels instead, and a task multiplies the 0/1 matrices
of two panels over a bucket of users. A channel with very many users is spread over the buckets in
both cases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.session import materialise_counted

FEW_CHANNELS = 128
ROWS_PER_BUCKET = 100_000
USERS_PER_CELL = 4096
CHANNELS_PER_PANEL = 1024
PAIRS_PER_TASK = 1 << 20  # counted pairs that a task adds up
_SCHEMA = "channel_a bigint, channel_b bigint, common bigint"
_CHUNK = 4_000_000


def _pairs_frame(low: np.ndarray, high: np.ndarray, common: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "channel_a": np.minimum(low, high),
            "channel_b": np.maximum(low, high),
            "common": common.astype(np.int64),
        }
    )


def _of_few(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pair counts of a bucket of users with few channels each."""
    pdf = pdf.sort_values(["user", "channel"])
    channels, code = np.unique(pdf["channel"].to_numpy(), return_inverse=True)
    user = pdf["user"].to_numpy()
    n = len(user)
    end = np.searchsorted(user, user, side="right")
    partners = end - np.arange(n) - 1  # later rows of the same user
    totals = pd.Series(dtype="int64")
    for rows in _row_chunks(partners):
        count = partners[rows]
        first = np.repeat(np.arange(rows.start, rows.stop), count)
        offset = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        key = code[first].astype(np.int64) * len(channels) + code[first + 1 + offset]
        found, times = np.unique(key, return_counts=True)
        totals = totals.add(pd.Series(times, index=found), fill_value=0)
    key = totals.index.to_numpy().astype(np.int64)
    return _pairs_frame(channels[key // len(channels)], channels[key % len(channels)], totals.to_numpy())


def _row_chunks(partners: np.ndarray) -> Iterator[slice]:
    edges = np.searchsorted(np.cumsum(partners), np.arange(_CHUNK, partners.sum(), _CHUNK))
    bounds = np.unique([0, *(edges + 1), len(partners)])
    for lo, hi in zip(bounds, bounds[1:]):
        yield slice(lo, hi)


def _of_many(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pair counts of two channel panels over a bucket of users with many channels each."""
    channels, code = np.unique(pdf["channel"].to_numpy(), return_inverse=True)
    users, user = np.unique(pdf["user"].to_numpy(), return_inverse=True)
    panel = np.zeros(len(channels), dtype=np.int64)
    panel[code] = pdf["panel"].to_numpy()
    seen = np.zeros((len(channels), len(users)), dtype=np.float32)
    seen[code, user] = 1.0
    panel_a, panel_b = pdf["panel_a"].iat[0], pdf["panel_b"].iat[0]
    a, b = np.nonzero(panel == panel_a)[0], np.nonzero(panel == panel_b)[0]
    both = seen[a] @ seen[b].T
    if panel_a == panel_b:
        both = np.triu(both, 1)
    i, j = np.nonzero(both)
    return _pairs_frame(channels[a[i]], channels[b[j]], both[i, j])


def audience_overlap(
    visits: DataFrame,
    min_common: int = 1,
    few_channels: int = FEW_CHANNELS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    users_per_cell: int = USERS_PER_CELL,
    channels_per_panel: int = CHANNELS_PER_PANEL,
) -> DataFrame:
    """``(channel_a, channel_b, common)``, ``channel_a < channel_b``, from ``visits(channel, user)``."""
    pairs = visits.select("channel", "user").where("channel is not null and user is not null")
    distinct, rows = materialise_counted(pairs.distinct(), "visits")
    degrees = distinct.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    many = degrees.where(F.col("n") > few_channels).select("user")
    buckets = max(1, math.ceil(rows / rows_per_bucket))
    bucket = F.pmod(F.xxhash64("user"), F.lit(buckets)).alias("bucket")
    few = degrees.where(F.col("n") <= few_channels).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    pairs_of_few = int(few.first()["pairs"] or 0)  # rows that the buckets hand on, at most
    counted = (
        distinct.join(many, "user", "left_anti")
        .select("channel", "user", bucket)
        .groupBy("bucket")
        .applyInPandas(_of_few, _SCHEMA)
    )
    heavy, n_heavy = materialise_counted(distinct.join(many, "user", "left_semi"), "heavy-visits")
    if n_heavy:
        size = heavy.agg(
            F.approx_count_distinct("channel").alias("c"), F.approx_count_distinct("user").alias("u")
        ).first()
        panels = max(1, math.ceil(size["c"] / channels_per_panel))
        cells = max(1, math.ceil(size["u"] / users_per_cell))
        placed = heavy.select(
            "channel",
            "user",
            F.pmod(F.xxhash64("channel"), F.lit(panels)).alias("panel"),
            F.pmod(F.xxhash64("user"), F.lit(cells)).alias("cell"),
        )
        # a visit meets only the panels in which its user has a channel: at most ``panels`` of them
        reach = placed.groupBy("user").agg(F.collect_set("panel").alias("reach"))
        placed = placed.join(reach, "user").withColumn("other", F.explode("reach"))
        placed = placed.select(
            "channel", "user", "panel", "cell",
            F.least("panel", "other").alias("panel_a"), F.greatest("panel", "other").alias("panel_b"),
        )
        counted = counted.unionByName(
            placed.groupBy("cell", "panel_a", "panel_b").applyInPandas(_of_many, _SCHEMA)
        )
    # the pairs of a bucket are counted already: they go to tasks as they are, as many as keep a task small
    shuffled = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    tasks = max(shuffled, math.ceil(pairs_of_few / PAIRS_PER_TASK))
    return (
        counted.repartition(tasks, "channel_a", "channel_b")
        .groupBy("channel_a", "channel_b")
        .agg(F.sum("common").alias("common"))
        .where(F.col("common") >= min_common)
    )
