"""Operator 7 over ``pages``: each page is captured in full and looked at again several times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.registry import query, table
from affinis.llm.revisits import TRACKING, resolve

# (number, seconds after the page's own time, kind) of the captures of a page
CAPTURES = ((0, 0, "response"), (1, 3600, "revisit"), (2, 7200, "revisit"), (3, -1800, "revisit"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of the pages, without their bodies: ``record_id, url, date, type, http_headers,
    page_id, payload_chars``. Some revisits send an ETag, some a date, some neither, and some ones that do not agree."""
    page, number = F.col("page_id"), F.col("c.number")
    made = pages.withColumn(
        "c",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(n).alias("number"), F.lit(s).alias("later"), F.lit(kind).alias("type"))
                    for n, s, kind in CAPTURES
                )
            )
        ),
    )
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    sent = F.when(number == 0, tag).when((page + number) % 4 == 0, F.concat(F.lit("W/"), tag)).when((page + number) % 4 == 1, F.lit('"other"'))
    changed = F.when((number == 0) | ((page + number) % 4 < 3), F.concat(F.lit("day "), (page % 28).cast("string")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    block = F.concat_ws(
        "\r\n",
        F.when(number == 0, "HTTP/1.1 200 OK").otherwise("HTTP/1.1 304 Not Modified"),
        line("ETag", sent),
        line("Last-Modified", changed),
        line("Cache-Control", F.concat(F.lit("max-age="), number.cast("string"))),
        line("Content-Length", F.when(number == 0, F.length("html").cast("string")).otherwise("0")),
        line("Content-Type", F.when(number == 0, "text/html").otherwise("text/plain")),
    )
    return made.select(
        (page * len(CAPTURES) + number).alias("record_id"),
        "url",
        (page * 60 + F.col("c.later")).alias("date"),
        F.col("c.type").alias("type"),
        block.alias("http_headers"),
        "page_id",
        F.length("html").cast("long").alias("payload_chars"),
    )


_PLAIN = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_CUT = f"(^|&)({TRACKING})=[^&]*"
SQL = f"""
  WITH u AS (
    SELECT page_id, html, {_PLAIN} AS bare FROM pages),
  k AS (
    SELECT page_id, html,
      regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www\\.|m\\.)', '')
      || regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', ''), '\\.html?$', '') AS place,
      regexp_replace(regexp_replace(regexp_extract(bare, '\\?(.*)$', 1), '{_CUT}', '', 'g'), '^&+', '') AS params
    FROM u),
  c AS (
    SELECT page_id * 4 + n AS record_id, coalesce(place || CASE WHEN params = '' THEN '' ELSE '?' || params END, '') AS url_key,
      page_id * 60 + later AS date, n, page_id, length(html) AS chars,
      '"' || md5(coalesce(html, '')) || '"' AS tag
    FROM k, (VALUES (0, 0), (1, 3600), (2, 7200), (3, -1800)) AS x(n, later)),
  h AS (
    SELECT *, CASE WHEN n = 0 THEN tag WHEN (page_id + n) % 4 = 0 THEN 'W/' || tag
                   WHEN (page_id + n) % 4 = 1 THEN '"other"' END AS etag,
      CASE WHEN n = 0 OR (page_id + n) % 4 < 3 THEN 'day ' || (page_id % 28) END AS modified,
      'max-age=' || n AS control
    FROM c),
  j AS (
    SELECT r.*, f.record_id AS refers_to, f.etag AS f_etag, f.modified AS f_modified, f.control AS f_control,
      f.chars AS f_chars, f.page_id AS f_page,
      row_number() OVER (PARTITION BY r.record_id ORDER BY f.date DESC, f.record_id DESC) AS place
    FROM h r LEFT JOIN h f ON f.n = 0 AND r.url_key = f.url_key AND f.date < r.date
    WHERE r.n > 0),
  o AS (
    SELECT *, CASE WHEN refers_to IS NULL THEN 'no-response'
        WHEN coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(f_etag, '^W/', ''), modified = f_modified) IS NULL THEN 'unchecked'
        WHEN coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(f_etag, '^W/', ''), modified = f_modified) THEN 'resolved'
        ELSE 'mismatch' END AS outcome
    FROM j WHERE place = 1)
  SELECT record_id, url_key, date, outcome, refers_to, f_page AS page_id, CAST(f_chars AS BIGINT) AS payload_chars,
    CASE WHEN outcome = 'resolved' THEN
      'cache-control=' || control || ';content-length=' || f_chars || ';content-type=text/html;etag='
      || coalesce(etag, f_etag) || ';last-modified=' || coalesce(modified, f_modified) END AS merged
  FROM o"""


@query("op7_warc_revisits", SQL)
def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(table(spark, sf_dir, "pages")), carry=["page_id", "payload_chars"])
    fields = F.array_sort(F.map_entries("merged"))
    text = F.array_join(F.transform(fields, lambda f: F.concat(f["key"], F.lit("="), f["value"])), ";")
    return found.withColumn("merged", text)
