"""Operator 12 over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affinis.llm.crosstoken import Vocabularies, alignment_counts
from affinis.llm.registry import query, table


def public_vocabularies() -> Vocabularies:
    import public_tokenizers

    return Vocabularies.read(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


@query("op12_crosstoken")
def op12_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment_counts(docs, public_vocabularies())
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"
    )
