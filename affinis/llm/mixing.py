"""Mixing sources to target weights: every source gives an exact number of words.

1. The total that the mix takes is shared by weight. A source stops at ``most`` times its own words; what
   is over is shared among the others by weight again, until none is above: a water level, found on
   sources in the order of the level at which they stop, by prefix sums of their limits and weights.
2. Every document gets a hash-random key. Rows ``(source, key, size)`` without texts are range-sorted, so
   the documents of a source of any share lie in many partitions, each a *run* of the source.
3. Prefix sums of words over the runs tell in which run a source's budget ends, those over the rows of
   that one run in which document. Whole epochs come off the budget first.
4. A source is then described by its epochs and the document where it is cut, and each document decides
   by comparing itself to that: texts are not shuffled.

Defined cases: null and empty texts have no words, take part and give none; a null source is a source of
its own; rows that are equal in id, text and source cannot be told apart, so where the cut falls among
such rows they share alike, rounded down; an empty table gives an empty result; a column of the input
that has the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinis.llm.batches import making_room
from affinis.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SHARE = Fraction(3, 2)
MOST = 2
SEED = "mix"
RESULTS = ("size", "source_size", "target", "taken")
_EXACT = "decimal(38,0)"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, count: Column) -> Column:
    """``text`` up to the end of its ``count``-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), count.cast("int")), "")


# -- prefix sums over range-sorted rows --------------------------------------------------------------


def in_runs(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """``df`` range-sorted by ``order``, with the number of its partition as ``_run``, as a table: later
    steps must all see the same runs, and bounds come from a sample."""
    sorted_rows = df.repartitionByRange(*order).withColumn("_run", F.spark_partition_id())
    return materialise(sorted_rows, label)


def _summed_before(values: Sequence[str], window) -> dict[str, Column]:
    earlier = window.rowsBetween(W.unboundedPreceding, -1)
    return {f"before_{v}": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values}


def run_offsets(runs: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``(_run, *keys, *values, before_*)``: sums of each run of a key, and those of its earlier runs. A key
    has at most as many rows here as there are partitions."""
    sums = runs.groupBy("_run", *keys).agg(*(F.sum(v).alias(v) for v in values))
    return sums.withColumns(_summed_before(values, W.partitionBy(*keys).orderBy("_run")))


def prefix_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str], label: str) -> DataFrame:
    """``df`` with the sums of ``values`` over all rows earlier in ``order`` as ``before_*``."""
    runs = in_runs(df, order, label)
    offsets = run_offsets(runs, values)
    inside = runs.withColumns(_summed_before(values, W.partitionBy("_run").orderBy(*order)))
    offsets = offsets.select("_run", *(F.col(f"before_{v}").alias(f"_{v}") for v in values))
    joined = inside.join(offsets, "_run")
    return joined.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"_{v}") for v in values}).drop(
        "_run", *(f"_{v}" for v in values)
    )


# -- targets -----------------------------------------------------------------------------------------


def by_rank(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``sources (source, source_size)`` with ``weight``: the given ones in turn, by code point, null last."""
    order = [F.col("source").asc_nulls_last()]
    ranked = prefix_sums(sources.withColumn("one", F.lit(1)), order, ["one"], "mix-ranks")
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    return ranked.select(
        "source", "source_size", F.get(cycle, F.col("before_one") % len(weights)).alias("weight")
    )


def budgets(sources: DataFrame, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """``sources (source, source_size, weight)`` with ``target`` (double) and ``budget`` (its whole words).

    All in whole numbers of ``1 / share.denominator`` words, so that rounding cannot move a limit.
    """
    p, q = share.numerator, share.denominator
    rows = sources.select(
        "source",
        "source_size",
        F.col("weight").cast(_EXACT).alias("weight"),
        (F.col("source_size") * (most * q)).cast(_EXACT).alias("limit"),
    )
    stops_at = F.col("limit").cast("double") / F.col("weight").cast("double")
    filled = prefix_sums(
        rows.withColumn("stops_at", stops_at),
        [F.col("stops_at"), F.col("source")],
        ["limit", "weight"],
        "mix-levels",
    )
    whole = rows.agg(
        (F.sum("source_size") * p).cast(_EXACT).alias("all_words"), F.sum("weight").cast(_EXACT).alias("all_weights")
    )
    left = F.col("all_words") - F.col("before_limit").cast(_EXACT)
    over = F.col("all_weights") - F.col("before_weight").cast(_EXACT)
    stopped = filled.join(F.broadcast(whole)).withColumn(
        "stops", (F.col("limit") * over).cast(_EXACT) <= (F.col("weight") * left).cast(_EXACT)
    )
    stopped = materialise(stopped.select("source", "source_size", "weight", "limit", "all_words", "stops"), "mix-stops")
    open_ones = stopped.agg(
        F.coalesce(F.sum(F.when(F.col("stops"), F.col("limit"))), F.lit(0)).cast(_EXACT).alias("used"),
        F.sum(F.when(~F.col("stops"), F.col("weight"))).cast(_EXACT).alias("open_weight"),
    )
    above = F.when(F.col("stops"), F.col("limit")).otherwise(
        ((F.col("all_words") - F.col("used")) * F.col("weight")).cast(_EXACT)
    )
    below = F.when(F.col("stops"), F.lit(q)).otherwise(F.col("open_weight") * q).cast(_EXACT)
    return (
        stopped.join(F.broadcast(open_ones))
        .select("source", "source_size", above.cast(_EXACT).alias("above"), below.alias("below"))
        .select(
            "source",
            "source_size",
            (F.col("above").cast("double") / F.col("below").cast("double")).alias("target"),
            F.expr("above div below").alias("budget"),
        )
    )


# -- the cut -----------------------------------------------------------------------------------------


def _place(key: str, text: str, seed: str) -> Column:
    """Where a document stands in its source: a hash-random key of its id, then id and text for ties."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    return F.struct(drawn.alias("draw"), F.col(key).alias("id"), F.xxhash64(text).alias("said"))


def cuts(runs: DataFrame, planned: DataFrame) -> DataFrame:
    """``planned (source, source_size, target, budget)`` with ``epochs``, the ``place`` of the document where
    the source is cut (null: at no document), and the ``words`` which that one still gives."""
    size = F.greatest(F.col("source_size"), F.lit(1))
    planned = planned.withColumns({"epochs": F.expr("budget div greatest(source_size, 1)"), "rest": F.col("budget") % size})
    inside = lambda: (F.col("before_words") <= F.col("rest")) & (F.col("rest") < F.col("before_words") + F.col("words"))
    open_ones = planned.where("rest > 0").select(F.col("source").alias("of"), "rest")
    cut_runs = run_offsets(runs, ["words"], ["source"]).join(open_ones, F.col("source").eqNullSafe(F.col("of"))).where(inside())
    cut_runs = cut_runs.select(
        F.col("_run").alias("run"), "of", (F.col("rest") - F.col("before_words")).alias("rest")
    )
    rows = runs.join(cut_runs, (F.col("_run") == F.col("run")) & F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumns(_summed_before(["words"], W.partitionBy("_run", "source").orderBy("place"))).where(inside())
    found = rows.select(
        "of", "place", F.expr("(rest - before_words) div copies").alias("words")
    )
    return planned.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "rest", "budget")


def mix(
    docs: DataFrame,
    weights: Sequence[int] | DataFrame,
    share: Fraction = SHARE,
    most: int = MOST,
    seed: str = SEED,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` with ``size`` (words of the text), ``source_size``, ``target`` (of the source) and ``taken``
    (words that the mix takes of the document, repeats counted).

    ``share`` of all words is taken, no document more than ``most`` times. ``weights`` are given to the
    sources in turn, or by a table ``(source, weight)`` of positive numbers with every source.
    """
    docs = making_room(docs, RESULTS, [key, text, source])
    rows = docs.select(F.col(source).alias("source"), _place(key, text, seed).alias("place"), words_in(F.col(text)).alias("size"))
    rows = rows.groupBy("source", "place", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("words", F.col("size") * F.col("copies"))
    runs = in_runs(rows, [F.col("source"), F.col("place")], "mix-runs")
    sources = runs.groupBy("source").agg(F.sum("words").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("of"), "weight")
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    else:
        sources = by_rank(sources, weights)
    planned = materialise(budgets(sources, share, most), "mix-budgets")
    found = materialise(cuts(runs, planned), "mix-cuts").select(
        F.col("source").alias("_of"), "source_size", "target", "epochs", F.col("place").alias("_cut"), F.col("words").alias("_words")
    )
    sized = docs.withColumns({"size": words_in(F.col(text)), "_place": _place(key, text, seed)})
    joined = sized.join(found, F.col(source).eqNullSafe(F.col("_of")))
    last = (
        F.when(F.col("_cut").isNull(), 0)
        .when(F.col("_place") < F.col("_cut"), F.col("size"))
        .when(F.col("_place") == F.col("_cut"), F.col("_words"))
        .otherwise(0)
    )
    taken = F.col("epochs") * F.col("size") + last
    return joined.withColumn("taken", taken.cast("long")).drop("_place", "_of", "_cut", "_words", "epochs")


def epochs_of(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of the mix: each document once per epoch, numbered by ``epoch`` from 1; in its last one it may
    be cut after the last word taken. Documents that give nothing are left out."""
    mixed = making_room(mixed, ["epoch"], ["taken", "size", text])
    rows = mixed.where("taken > 0").withColumn("epoch", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")))
    left = F.col("taken") - (F.col("epoch") - 1) * F.col("size")
    return rows.withColumn(text, F.when(left < F.col("size"), first_words(F.col(text), left)).otherwise(F.col(text)))
