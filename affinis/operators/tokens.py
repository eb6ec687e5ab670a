"""Token tables: explode, stem by dictionary, drop stop words."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.text import clean_text, computed, default_stop_words, remove_stop_words, words


def message_words(messages: DataFrame) -> DataFrame:
    """``(message_id, tokens)``."""
    return messages.select("message_id", words(F.col("message")).alias("tokens"))


def tokens_without_stop_words(
    tokens: DataFrame, stop_words: Iterable[str] | None = None
) -> DataFrame:
    """``(message_id, pos, token)`` of the remaining tokens, repetitions kept."""
    kept = remove_stop_words(tokens, "tokens", "kept", stop_words)
    return kept.select("message_id", F.posexplode("kept").alias("pos", "token"))


def stem_tokens(tokens: DataFrame, stems: DataFrame) -> DataFrame:
    """``(message_id, pos, token)`` with tokens replaced through ``stems(token, stem)``.

    The dictionary is joined as Spark sees fit: broadcast when its size allows, else shuffled,
    with hot tokens split at runtime.
    """
    rows = tokens.select("message_id", F.posexplode("tokens").alias("pos", "token"))
    joined = rows.join(stems.select("token", "stem"), "token", "left")
    return joined.select("message_id", "pos", F.coalesce("stem", "token").alias("token"))


def normalise_tokens(
    tokens: DataFrame, stems: DataFrame, stop_words: Iterable[str] | None = None
) -> DataFrame:
    """Stem first, then drop stop words and empties, so a stemmed stop word can stay."""
    listed = list(stop_words) if stop_words is not None else default_stop_words()
    stemmed = stem_tokens(tokens, stems)
    return stemmed.where((F.col("token") != "") & ~F.col("token").isin(listed))


def clean_messages(
    messages: DataFrame,
    cleaning: Callable[[Column], Column] = clean_text,
    tokenize: bool = True,
    stems: DataFrame | None = None,
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """Cleaned ``(message_id, channel_id, message)``, or its tokens without stop words.

    ``cleaning`` is any Column function. Tokens come as an array column ``tokens``; with a stem
    dictionary they come one per row, ``(message_id, channel_id, pos, token)``.
    """
    cleaned = messages.select("message_id", "channel_id", cleaning(F.col("message")).alias("message"))
    if not tokenize:
        return cleaned
    # later steps read the words several times: the cleaning must not be copied into each of them
    split = computed(cleaned, "raw", words(F.col("message"))).select("message_id", "channel_id", "raw")
    if stems is None:
        return remove_stop_words(split, "raw", "tokens", stop_words).drop("raw")
    keyed = split.select(F.struct("message_id", "channel_id").alias("message_id"), F.col("raw").alias("tokens"))
    return normalise_tokens(keyed, stems, stop_words).select("message_id.*", "pos", "token")
