"""The corpus pipeline: stages that each take the documents their predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.decontaminate import with_leaks
from affinis.llm.jaccard import one_per_class
from affinis.llm.pieces import encode
from affinis.llm.query_pieces import public_model
from affinis.llm.query_quality import ACCEPTED, held_out
from affinis.llm.quality import fit, score
from affinis.llm.secret_scan import find_secrets, redact
from affinis.session import configure, materialise

# The stages are a classifier, signatures, alignments and tokenisation, which SQL does not express.
ORACLE_SQL = None
_SCORE, _LEAKS, _SECRETS = "_quality_score", "_benchmark_leaks", "_secret_spans"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels outside the held-out fold, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, fit(docs, labels, ~held_out()), out=_SCORE)
    return found.where(F.col(_SCORE) >= ACCEPTED).select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies."""
    return one_per_class(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_leaks(docs, items, out=_LEAKS).where(F.size(_LEAKS) == 0).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret; ``n_chars`` follows the text."""
    masked = redact(find_secrets(docs, out=_SECRETS), spans=_SECRETS)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids and the source bytes of each piece."""
    return encode(docs, public_model())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece encoding", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages, each written as a table and read again by the next."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
