"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what a Python worker is handed at a time, however long the texts are
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan here relies on and ship this package to executors."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="affinis-package-")) / package.name
        archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a cluster a
    machine-local folder would lose the data together with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="affinis-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application for later clean-up."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark)}/affinis/{app}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from that table.

    Later steps then survive executor loss without recomputing the lineage, see exact sizes,
    and read only the columns they need.
    """
    return materialise_counted(df, label)[0]


def materialise_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``materialise`` and the number of rows written, taken while writing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


def clean_up(spark: SparkSession) -> bool:
    """Delete the scratch tables of this application; only when none of its results is still needed."""
    folder = f"{checkpoint_root(spark)}/affinis/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
