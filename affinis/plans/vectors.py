"""From texts to one vector per group: sentences, eligibility, sampling, encoding, mean."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions import constants as C
from affinis.functions import text as tx
from affinis.functions.vectors import HASH_WIDTH, as_array, hashed_vectors
from affinis.operators.ordered import top_per_group
from affinis.session import materialise


@dataclass(frozen=True)
class Selection:
    """Which groups get a vector, and from which of their sentences."""

    min_words: int = C.MIN_SENTENCE_WORDS
    min_messages: int = C.MIN_MESSAGES
    min_sentences: int = C.MIN_SENTENCES
    max_sentences: int = C.MAX_SENTENCES
    min_items: int = C.MIN_MESSAGES  # of the sampled sentences
    drop_single_blank: bool = False
    seed: str = "0"


CHANNELS = Selection()
DESCRIPTIONS = Selection(
    min_words=1, min_messages=1, min_sentences=1, max_sentences=C.MAX_DESCRIPTION_SENTENCES,
    min_items=1, drop_single_blank=True,
)
UNKNOWN_CHANNELS = Selection(
    min_words=C.MIN_PAGE_WORDS, min_messages=1, min_sentences=1,
    max_sentences=C.MAX_DESCRIPTION_SENTENCES, min_items=1, drop_single_blank=True,
)

Encoder = Callable[[DataFrame], DataFrame]


def hashed_encoder(width: int = HASH_WIDTH) -> Encoder:
    """``sentence`` -> ``vec`` (ML vector): unit-length hashed bag of lower-cased words."""

    def encode(sentences: DataFrame) -> DataFrame:
        tokens = sentences.withColumn("_tokens", tx.words(F.lower("sentence")))
        return hashed_vectors(tokens, "_tokens", "vec", width).drop("_tokens")

    return encode


def model_encoder(make_predict: Callable, batch_size: int = C.ENCODER_BATCH) -> Encoder:
    """Encoder from a model: ``make_predict()`` loads it once per Python worker and returns a
    function from an array of texts to a matrix. Texts are cut to the model's token limit."""
    predict = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )

    def encode(sentences: DataFrame) -> DataFrame:
        cut = F.array_join(tx.truncate(tx.words(F.col("sentence"))), " ")
        return sentences.withColumn("vec", array_to_vector(predict(cut).cast("array<double>")))

    return encode


def valid_sentences(rows: DataFrame, min_words: int) -> DataFrame:
    """Add ``valid``: the sentences of ``text`` with at least ``min_words`` space-separated pieces."""
    valid = F.filter(
        tx.split_sentences(F.col("text")), lambda s: F.size(tx.space_pieces(s)) >= min_words
    )
    return tx.computed(rows.select("group_id", "item_id", "text"), "valid", valid).drop("text")


def group_statistics(valid: DataFrame) -> DataFrame:
    """``(group_id, n_messages, n_sentences)``; each message row is counted on the map side."""
    return valid.groupBy("group_id").agg(
        F.count_if(F.size("valid") > 0).alias("n_messages"),
        F.sum(F.size("valid")).cast("bigint").alias("n_sentences"),
    )


def is_eligible(rule: Selection):
    return (
        (F.col("n_messages") >= rule.min_messages)
        & (F.col("n_sentences") >= rule.min_sentences)
        & (F.least("n_sentences", F.lit(rule.max_sentences)) >= rule.min_items)
    )


def sample_sentences(valid: DataFrame, rule: Selection) -> DataFrame:
    """At most ``max_sentences`` sentences per group, uniform and repeatable (md5 order)."""
    rows = valid.select("group_id", "item_id", F.posexplode("valid").alias("pos", "sentence"))
    key = F.md5(F.concat_ws("-", F.lit(rule.seed), "item_id", "pos"))
    order = [F.col("_key"), F.col("item_id"), F.col("pos")]
    return top_per_group(
        rows.withColumn("_key", key), ["group_id"], order, rule.max_sentences
    ).drop("_key", "rank")


def group_vectors(
    rows: DataFrame, rule: Selection = CHANNELS, encoder: Encoder | None = None
) -> DataFrame:
    """``(group_id, embedding)`` from ``rows(group_id, item_id, text)``."""
    # written once: texts are read and split once, and both steps below read sentences only
    valid = materialise(valid_sentences(rows, rule.min_words), "sentences")
    eligible = group_statistics(valid).where(is_eligible(rule)).select("group_id")
    sampled = sample_sentences(valid, rule).join(eligible, "group_id", "left_semi")
    clean = sampled.withColumn("sentence", tx.clear_emoji(tx.drop_links(F.col("sentence"))))
    encoded = (encoder or hashed_encoder())(clean)
    means = encoded.groupBy("group_id").agg(
        as_array(Summarizer.mean(F.col("vec"))).alias("embedding"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.length(tx.strip(F.col("sentence")))).alias("longest"),
    )
    if rule.drop_single_blank:
        means = means.where("n > 1 or longest > 0")
    return means.select("group_id", "embedding")


Selector = Callable[[DataFrame], DataFrame]


def long_messages(rows: DataFrame, min_words: int = C.LONG_MESSAGE_WORDS) -> DataFrame:
    """Selector: whole messages with more than ``min_words`` words after link removal."""
    kept = tx.computed(rows, "sentence", tx.drop_links(F.col("text")))
    return kept.where(F.size(tx.words(F.col("sentence"))) > min_words).select(
        "group_id", "item_id", F.lit(0).alias("pos"), "sentence"
    )


def selected_vectors(
    rows: DataFrame,
    selector: Selector = long_messages,
    encoder: Encoder | None = None,
    min_items: int = C.MIN_MESSAGES,
) -> DataFrame:
    """``(group_id, embedding)`` from any selector and encoder: the mean over what was selected,
    for groups with at least ``min_items`` of it. One pass, one partial aggregate."""
    encoded = (encoder or hashed_encoder())(selector(rows))
    means = encoded.groupBy("group_id").agg(
        as_array(Summarizer.mean(F.col("vec"))).alias("embedding"), F.count(F.lit(1)).alias("n")
    )
    return means.where(F.col("n") >= min_items).select("group_id", "embedding")


def first_channels(messages: DataFrame, n: int) -> DataFrame:
    """Messages of the first ``n`` channels by id, counted before any eligibility; -1 means all."""
    if n == -1:
        return messages
    first = messages.select("channel_id").distinct().orderBy("channel_id").limit(n)
    return messages.join(first, "channel_id", "left_semi")


def channel_embeddings(
    messages: DataFrame,
    rule: Selection = CHANNELS,
    encoder: Encoder | None = None,
    num_channels: int = -1,
) -> DataFrame:
    """``(channel_id, embedding)`` from ``(channel_id, message_id, message)``."""
    rows = first_channels(messages, num_channels).select(
        F.col("channel_id").alias("group_id"), F.col("message_id").alias("item_id"),
        F.col("message").alias("text"),
    )
    return group_vectors(rows, rule, encoder).withColumnRenamed("group_id", "channel_id")


def rejected(messages: DataFrame, rule: Selection = CHANNELS) -> DataFrame:
    """How many channels have too little text."""
    rows = messages.select(
        F.col("channel_id").alias("group_id"), F.col("message_id").alias("item_id"),
        F.col("message").alias("text"),
    )
    stats = group_statistics(valid_sentences(rows, rule.min_words))
    return stats.agg(
        F.count_if(~is_eligible(rule)).alias("rejected"), F.count(F.lit(1)).alias("channels")
    )


def description_vectors(
    requests: DataFrame, rule: Selection = DESCRIPTIONS, encoder: Encoder | None = None
) -> DataFrame:
    """``(request_id, embedding)`` from ``requests(request_id, text)``, or with a ``pos`` column
    from several texts per request. Requests without usable text have no row."""
    item = F.col("pos") if "pos" in requests.columns else F.lit(0)
    rows = requests.select(
        F.col("request_id").alias("group_id"), item.cast("bigint").alias("item_id"), "text"
    )
    return group_vectors(rows, rule, encoder).withColumnRenamed("group_id", "request_id")
