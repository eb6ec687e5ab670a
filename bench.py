"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and is then timed; results go to Spark's ``noop`` sink, so every
column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from affinis.queries import all_queries  # noqa: E402
from affinis.session import clean_up, configure  # noqa: E402

HEADLINE = [
    "similar_channels",
    "topk_neighbours",
    "topk_neighbours_grid",
    "topk_neighbours_pivots",
    "similarity_threshold_join",
    "similarity_threshold_join_approx",
    "build_channel_embeddings",
    "search_by_description",
    "lookup_by_handle",
    "clean_messages",
    "learned_sentences",
    "hashed_vectors",
    "tfidf_vectors",
    "tfidf_similar_docs",
    "tfidf_similar_channels",
    "lookup_unknown",
    "wordvec_channel_mean",
    "communities",
    "audience_overlap",
    "page_texts",
    "route_requests",
    "channel_groups",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("affinis-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    named = all_queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            named[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    clean_up(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
