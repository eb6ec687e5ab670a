"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions import constants as C


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that filters and later columns read without computing it again.

    A plain column would be copied into every expression that uses it, and into filters that
    the optimizer moves below it; the one-element explode keeps it in place.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(C.WS_CHARS))


def words(text: Column) -> Column:
    """Split on runs of Unicode white space, without empty pieces."""
    return F.filter(F.split(text, f"{C.WS}+"), lambda w: w != "")


def drop_links(text: Column) -> Column:
    """Remove links, mentions and tags; an image tag leaves a marker word.

    Without any of the four literals below no pattern can match, not even after an earlier one
    has removed something, so most texts skip the patterns.
    """
    candidate = F.lit(False)
    for literal in ("@", "<", "t.me/", "http"):
        candidate = candidate | text.contains(literal)
    cleaned = text
    for pattern, replacement in C.LINK_PATTERNS:
        cleaned = F.regexp_replace(cleaned, pattern, replacement)
    return F.when(candidate, cleaned).otherwise(text)


def clear_emoji(text: Column) -> Column:
    """Remove emoji sequences. The look-ahead keeps ordinary characters off the long class."""
    return F.regexp_replace(text, f"(?={C.EMOJI_START})(?:{C.EMOJI_SEQUENCE})", "")


def split_sentences(text: Column) -> Column:
    """Sentences end in one of ``.!?…`` followed by white space."""
    return F.split(text, f"(?<=[{C.SENTENCE_END}]){C.WS}+")


def clean_text(text: Column, lower: bool = True) -> Column:
    """Links out, letters, white space and hyphens kept, white space collapsed, ends trimmed."""
    if lower:
        text = F.lower(text)
    # joining the kept runs is faster in Java than deleting matches of a negated class
    keep = f"[a-z{C.WS[1:-1]}{C.LETTERS}-]+"
    text = F.array_join(F.regexp_extract_all(drop_links(text), F.lit(keep), F.lit(0)), "")
    # a lone plain space is already what a run collapses to
    text = F.regexp_replace(text, rf"[{C.WS_RARE}]{C.WS}*|\x20{C.WS}+", " ")
    return F.btrim(text)


def clean_words(cleaned: Column) -> Column:
    """Words of a text that ``clean_text`` has returned: plain single spaces only."""
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def space_pieces(sentence: Column) -> Column:
    """Pieces between single spaces, empty ones included: the word count of a sentence."""
    return F.split(sentence, " ")


def header_text(text: Column, entity_pattern: str | None = None) -> Column:
    """The prose of a page header.

    Lines that start with ``entity_pattern`` go, except that the first line always stays. Without
    a pattern every further line counts as an entity, so only the first line is left.
    """
    lines = F.filter(F.transform(F.split(text, C.LINE_BREAK), strip), lambda line: line != "")
    if entity_pattern is None:
        kept = F.slice(lines, 1, 1)
    else:
        kept = F.filter(
            lines, lambda line, i: (i == 0) | ~line.rlike(f"^(?:{entity_pattern})")
        )
    return strip(clear_emoji(drop_links(F.array_join(kept, " "))))


def truncate(tokens: Column, limit: int = C.MAX_TOKENS) -> Column:
    return F.slice(tokens, 1, limit)


def terms(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(C.TOKEN), F.lit(0))


def with_ngrams(df: DataFrame, tokens: str, out: str, max_n: int = 2) -> DataFrame:
    """Add ``out``: the tokens followed by their n-grams up to ``max_n``."""
    parts = [F.col(tokens)]
    for n in range(2, max_n + 1):
        name = f"_{n}gram"
        df = NGram(n=n, inputCol=tokens, outputCol=name).transform(df)
        parts.append(F.col(name))
    return df.withColumn(out, F.concat(*parts)).drop(*[f"_{n}gram" for n in range(2, max_n + 1)])


def default_stop_words() -> list[str]:
    """Spark's English and Russian lists together."""
    load = StopWordsRemover.loadDefaultStopWords
    return sorted(set(load("english")) | set(load("russian")))


def remove_stop_words(
    df: DataFrame, tokens: str, out: str, stop_words: Iterable[str] | None = None
) -> DataFrame:
    """Drop stop words from a token array; repeated other tokens and their order stay."""
    listed = list(stop_words) if stop_words is not None else default_stop_words()
    remover = StopWordsRemover(
        inputCol=tokens, outputCol=out, stopWords=listed, caseSensitive=True
    )
    return remover.transform(df)


def is_recent(date: Column, column_type: str, cutoff: str = C.RECENT_AFTER) -> Column:
    """Strictly after the day ``cutoff``.

    For timestamps this is a plain lower bound on the column, which reaches the parquet scan.
    Text dates compare by their first word; a blank date is not recent. A text whose first word is later is
    later itself, unless white space stands before it, and all of that is smaller than ``!`` or larger than any
    digit. So plain bounds on the column, which reach the scan, leave out nothing.
    """
    if column_type == "string":
        later = F.try_element_at(words(date), F.lit(1)) > F.lit(cutoff)
        return ((date > F.lit(cutoff)) | (date < F.lit("!"))) & later if cutoff[:1].isdigit() else later
    return date >= F.date_add(F.lit(cutoff).cast("date"), 1).cast(column_type)
