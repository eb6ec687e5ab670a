"""Answering a stream of requests from stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from affinis.functions.handles import normalise_handle
from affinis.session import materialise


def answer_stream(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Join streamed ``requests(request_id, text)`` to stored ``answers(handle, rank, ...)``."""
    asked = requests.withColumn("handle", normalise_handle(F.col("text")))
    return asked.select("request_id", "handle").join(answers, "handle")


def unanswered_stream(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Streamed requests whose handle has no stored answer, to be resolved and remembered."""
    asked = requests.withColumn("handle", normalise_handle(F.col("text"))).where(
        "handle is not null"
    )
    return asked.join(answers.select("handle").distinct(), "handle", "left_anti")


def await_pages(requests: DataFrame, pages: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streamed ``requests(request_id, text, asked_at)`` with the page of their handle, once it lands.

    ``pages(handle, html, landed_at)`` is a stream too. A request waits for pages that land from ``asked_at`` on until
    ``wait`` later, and comes out as ``(request_id, text, handle, html, landed_at, outcome)``: ``page`` for each of
    them, or ``expired`` without one, as soon as the watermarks (``late`` behind the newest rows of both streams)
    show that none can come. Both sides are state only for that time. Rows later than ``late`` are dropped.
    """
    asked = requests.select("request_id", "text", "asked_at", normalise_handle(F.col("text")).alias("handle"))
    asked = asked.where("handle IS NOT NULL").withWatermark("asked_at", late)
    landed = pages.where("handle IS NOT NULL").select(F.col("handle").alias("page_of"), "html", "landed_at")
    landed = landed.withWatermark("landed_at", late)
    meets = (F.col("handle") == F.col("page_of")) & F.expr(
        f"landed_at >= asked_at AND landed_at <= asked_at + interval {wait}"
    )
    outcome = F.when(F.col("page_of").isNull(), "expired").otherwise("page")
    return asked.join(landed, meets, "left_outer").select(
        "request_id", "text", "handle", "html", "landed_at", outcome.alias("outcome")
    )


def first_asked(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streamed ``requests(request_id, text, asked_at)`` reduced to one of each handle, as long as the watermark
    remembers it: what has to be resolved, when many ask for the same."""
    asked = requests.withColumn("handle", normalise_handle(F.col("text"))).where("handle IS NOT NULL")
    return asked.withWatermark("asked_at", late).dropDuplicatesWithinWatermark(["handle"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, appending to a parquet table exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


MEMO = "handle string, rank int, neighbour_id bigint, sim double"


def read_memo(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Remembered neighbour rows, a rank of a handle once; with ``before``, only those of earlier batches."""
    rows = spark.read.schema(f"{MEMO}, batch bigint").option("basePath", path).parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.drop("batch").dropDuplicates(["handle", "rank"])


def compact_memo(spark: SparkSession, path: str, through: int, partitions: int | None = None) -> None:
    """Merge the folders of all batches up to ``through``, which must be complete, into one.

    The merged folder is written before the others go, under a number below 0 that earlier merges do not
    have; stopped in between, the memo has rows twice, which ``read_memo`` reads once, and the next run goes on.
    """
    merged = materialise(read_memo(spark, path, through + 1), "memo")
    rows = merged if partitions is None else merged.repartition(partitions, "handle")
    name = f"batch={-2 - through}"
    rows.sortWithinPartitions("handle", "rank").write.mode("overwrite").parquet(f"{path}/{name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        found = status.getPath().getName()
        if found.startswith("batch=") and found != name and int(found.removeprefix("batch=")) <= through:
            files.delete(status.getPath(), True)


def remember_stream(
    requests: DataFrame,
    memo_path: str,
    answers_path: str,
    checkpoint: str,
    resolve: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
    compact_every: int = 100,
) -> StreamingQuery:
    """Answer a stream and remember what it had to find out.

    ``resolve(requests, memo)`` returns answers and new memo rows, as ``plans.search.lookup`` does. Each
    batch sees what earlier ones have remembered, and writes folders of its own number, so a batch
    that runs twice leaves one copy and a handle is remembered once. Every ``compact_every`` batches the folders
    of the batches before are merged.
    """

    def handle_batch(batch: DataFrame, number: int) -> None:
        if number and number % compact_every == 0:
            compact_memo(batch.sparkSession, memo_path, number - 1)
        memo = read_memo(batch.sparkSession, memo_path, number)
        answers, found = resolve(batch, memo)
        found.write.mode("overwrite").parquet(f"{memo_path}/batch={number}")
        answers.write.mode("overwrite").parquet(f"{answers_path}/batch={number}")

    spark = requests.sparkSession
    spark.createDataFrame([], MEMO).write.mode("ignore").parquet(f"{memo_path}/batch=-1")
    return (
        requests.writeStream.foreachBatch(handle_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
