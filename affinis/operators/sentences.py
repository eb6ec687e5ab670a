"""Sentence ends that know the abbreviations of the corpus.

A word that stands before a full stop much more often than chance allows is an abbreviation. The measure is
the published one for unsupervised sentence splitting: the log-likelihood ratio of "a stop follows as often as
after any word" against "a stop follows nearly always", less for long words, more for stops inside the word,
and less for each time that the word stands without a stop. Counts are one aggregation over the corpus; the table of
abbreviations is bounded by ``most``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions import text as tx

# fixed values of the published method
NEARLY_ALWAYS = 0.99
LEAST_SCORE = 0.3
# end of fixed values
LEAST_STOPS = 5  # times a word stands before a stop
MOST = 5_000  # abbreviations in the table

WRAPPING = "\"'()[]{}«»„“”‚‘’,;:!?…"
_WORD = r"^\p{L}[\p{L}.-]*$"
_LAST = r"(?:^|[^\p{L}\p{N}.-])(\p{L}[\p{L}.-]*)\.$"
_CUT = "\x01"


def word_statistics(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(word, stops, total)``: how often each word, in lower case and without its stop, stands in ``texts``, and
    before a stop. Words begin with a letter and have letters, stops and hyphens only."""
    tokens = texts.select(F.explode(tx.words(F.lower(F.coalesce(text, F.lit(""))))).alias("token"))
    bare = F.btrim("token", F.lit(WRAPPING))
    stop = bare.endswith(".") & ~bare.endswith("..")
    tokens = tokens.select(F.when(stop, bare.substr(F.lit(1), F.length(bare) - 1)).otherwise(bare).alias("word"), stop.alias("stop"))
    return (
        tokens.where(F.col("word").rlike(_WORD))
        .groupBy("word")
        .agg(F.count_if("stop").alias("stops"), F.count(F.lit(1)).alias("total"))
    )


def scored_words(statistics: DataFrame) -> DataFrame:
    """``statistics`` with the ``score`` of every word that stands before a stop."""
    whole = statistics.agg(F.sum("stops").alias("all_stops"), F.sum("total").alias("all_words"))
    chance = F.col("all_stops") / F.col("all_words")
    without = F.col("total") - F.col("stops")
    likely = lambda p: F.col("stops") * F.log(p) + without * F.log(1 - p)
    # a corpus in which every word has a stop says nothing
    ratio = F.when(chance < 1, -2 * (likely(chance) - likely(F.lit(NEARLY_ALWAYS)))).otherwise(0.0)
    inner = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    letters = F.greatest(F.length("word") - inner, F.lit(1)).cast("double")
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -without.cast("double"))
    joined = statistics.where("stops > 0").join(F.broadcast(whole))  # one row
    return joined.select("word", "stops", "total", score.alias("score"))


def abbreviations(texts: DataFrame, text: str = "text", least_stops: int = LEAST_STOPS, most: int = MOST) -> list[str]:
    """The words with the highest scores; at most ``most`` come to the driver."""
    scored = scored_words(word_statistics(texts, text)).where((F.col("score") >= LEAST_SCORE) & (F.col("stops") >= least_stops))
    return [r["word"] for r in scored.orderBy(F.desc("score"), "word").limit(most).collect()]


def split_sentences(text: Column, known: list[str]) -> Column:
    """Sentences as ``functions.text.split_sentences`` cuts them, but not after one of the ``known`` abbreviations."""
    pieces = tx.split_sentences(text)
    if not known:
        return pieces
    last = F.element_at(pieces, -1)

    def marked(piece: Column) -> Column:
        short = piece.endswith(".") & F.regexp_extract(F.lower(piece), _LAST, 1).isin(known)
        return F.concat(piece, F.when(short, " ").otherwise(_CUT))

    joined = F.concat(F.array_join(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), marked), ""), last)
    return F.split(joined, _CUT)
