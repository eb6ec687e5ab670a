"""Not-modified revisits of web captures: each gets the response that it stands for.

Captures are WARC records with their HTTP header block. A revisit is joined, as of its date, to the
latest earlier full response of the same canonical URL. The join holds if the validators agree:
the ETag if both have one (weakly compared), else Last-Modified if both have one. The headers of a
resolved revisit are those of the response, updated by the ones a 304 may change.

The records are range-partitioned by URL and date, and each partition hands the next one its last
full response, so one URL with a third of all captures is spread over many tasks.

Defined cases: header lines without a colon are left out, of repeated names the last counts, names
are compared in lower case; null blocks have no headers; records with a null URL meet each other only; records
with a null date come first; a response of the same instant is not earlier; a revisit without an earlier response is
``no-response``, one without common validators ``unchecked``, one whose validators differ ``mismatch``,
and none of the three is resolved; repeated records each count; columns that are not named
to the operator play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinis.session import materialise

# fixed values: fields that a 304 response may update, and URL parameters that only track
UPDATABLE = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = "utm_[a-z]+|fbclid|gclid|ref"
# end of fixed values


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` or ``m.``, no scheme, default port, fragment, tracking
    parameters, ``.html`` or closing slash; other parameters stay in their order."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^(www\.|m\.)", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"\.html?$", "")
    params = F.regexp_extract(bare, r"\?(.*)$", 1)
    params = F.regexp_replace(params, f"(^|&)({TRACKING})=[^&]*", "")
    params = F.regexp_replace(params, "^&+", "")
    return F.concat(host, path, F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)))


def headers(block: Column) -> Column:
    """The fields of an HTTP header block as a map of lower-case names; the last of a name counts."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda line: F.rlike(line, F.lit("^[^:\\s]+:")))
    fields = F.transform(
        lines,
        lambda line: F.struct(
            F.lower(F.substring_index(line, ":", 1)).alias("key"),
            F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value"),
        ),
    )
    last = F.filter(
        fields,
        lambda field, i: ~F.exists(
            F.slice(fields, i + 2, F.greatest(F.size(fields) - i - 1, F.lit(0))), lambda later: later["key"] == field["key"]
        ),
    )
    return F.map_from_entries(last)


def _field(fields: Column, name: str) -> Column:
    return F.nullif(F.try_element_at(fields, F.lit(name)), F.lit(""))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored fields, with those of ``update`` that may change put over them."""
    allowed = F.map_filter(update, lambda name, _: name.isin(*UPDATABLE))
    kept = F.map_filter(stored, lambda name, _: ~F.map_contains_key(allowed, name))
    return F.map_concat(kept, allowed)


def with_latest_response(captures: DataFrame) -> DataFrame:
    """``captures`` with ``stored``: the latest earlier full response of the same canonical URL.

    Rows are range-sorted by URL and date, so that a URL of any share lies in many partitions. A window finds the
    response inside the partition; the last response of a URL in each partition is carried to the later ones, as
    one row per partition and URL.
    """
    order = ["date", "full", "record_id"]  # at the same instant revisits come first
    runs = captures.repartitionByRange("url_key", *order).withColumn("run", F.spark_partition_id())
    runs = materialise(runs, "captures-in-order")
    response = F.when(F.col("full"), F.struct("record_id", "fields", "carried"))
    inside = W.partitionBy("run", "url_key").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    latest = runs.where("full").groupBy("run", "url_key").agg(
        F.max_by(F.struct("record_id", "fields", "carried"), F.struct(*order)).alias("final")
    )
    # runs that have rows of the URL but no response only pass on what came before
    present = runs.select("run", "url_key").distinct().join(latest, ["run", "url_key"], "left")
    earlier = W.partitionBy("url_key").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    carried = present.select("run", "url_key", F.last("final", ignorenulls=True).over(earlier).alias("brought"))
    found = runs.withColumn("near", F.last(response, ignorenulls=True).over(inside))
    return found.join(carried, ["run", "url_key"], "left").withColumn("stored", F.coalesce("near", "brought")).drop("near", "brought", "run")


def resolve(
    records: DataFrame,
    url: str = "url",
    date: str = "date",
    record_id: str = "record_id",
    kind: str = "type",
    block: str = "http_headers",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per revisit: its ``record_id``, ``url_key``, ``date``, ``outcome``, ``refers_to`` (the id of
    the latest earlier full response, also where it does not agree), the ``merged`` headers of resolved
    ones, and the response's ``carry`` columns. ``type`` tells ``response`` from ``revisit``; other
    records take no part."""
    work = records.where(F.col(kind).isin("response", "revisit")).select(
        F.coalesce(canonical_url(F.col(url)), F.lit("")).alias("url_key"),
        F.col(date).alias("date"),
        (F.col(kind) == "response").alias("full"),
        F.col(record_id).alias("record_id"),
        headers(F.col(block)).alias("fields"),
        F.struct(F.lit(1).alias("_one"), *carry).alias("carried"),
    )
    # written before it is sorted: bounds are drawn from a sample, which would read and hash every page once more
    found = with_latest_response(materialise(work, "captures")).where(~F.col("full"))
    tag = lambda fields: F.regexp_replace(_field(fields, "etag"), "^W/", "")
    here, there = F.col("fields"), F.col("stored.fields")
    agrees = F.coalesce(tag(here) == tag(there), _field(here, "last-modified") == _field(there, "last-modified"))
    outcome = (
        F.when(F.col("stored").isNull(), "no-response")
        .when(agrees.isNull(), "unchecked")
        .when(agrees, "resolved")
        .otherwise("mismatch")
    )
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "url_key",
        "date",
        "outcome",
        F.col("stored.record_id").alias("refers_to"),
        F.when(F.col("outcome") == "resolved", merged_headers(there, here)).alias("merged"),
        *(F.col("stored.carried")[name].alias(name) for name in carry),
    )
