"""Web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.queries import inputs as I
from affinis.queries import sql as Q
from affinis.queries.registry import query
from affinis.sources import pages as pg

CLASS = "ad"  # the one class of the fixture's pages

_BODY = f"regexp_replace(html, {Q.lit('(?s)<(script|style)[^>]*>.*?</(script|style)>')}, '', 'g')"


def _pages(spark, sf):
    return I.spread(I.table(spark, sf, "pages")).select("page_id", "html")


PAGE_TEXTS = f"""
  SELECT page_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS text FROM (
    SELECT page_id, list_append(m, coalesce(m[1], '')) AS t FROM (
      SELECT page_id, regexp_extract_all(html, '<div class="{CLASS}">([^<>]*)</div>', 1) AS m FROM pages))"""


@query("page_texts", PAGE_TEXTS)
def page_texts(spark, sf):
    parsed = pg.parse_pages(_pages(spark, sf), "page_id", header_class=CLASS, message_class=CLASS)
    texts = pg.page_texts(parsed, "page_id")
    return texts.select("page_id", F.col("pos").cast("bigint").alias("pos"), "text")


@query(
    "page_paragraphs",
    f"""SELECT page_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS text FROM (
          SELECT page_id, regexp_extract_all({_BODY}, '<p(?: [^<>]*)?>([^<>]*)</p>', 1) AS p FROM pages)""",
)
def page_paragraphs(spark, sf):
    rows = _pages(spark, sf).select(
        "page_id", F.posexplode(pg.flat_elements(F.col("html"), "p")).alias("pos", "text")
    )
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "text")


@query(
    "subscriber_count",
    """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN -1
                            ELSE CAST(page_id || '' || length(url) AS BIGINT) END AS subscribers
       FROM pages""",
)
def subscriber_count(spark, sf):
    """Pages with a subscriber line put in front: a spaced number, or none on every seventh page."""
    line = F.when(F.col("page_id") % 7 == 0, F.lit("no subscribers")).otherwise(
        F.concat("page_id", F.lit(" "), F.length("url"), F.lit(" subscribers"))
    )
    pages = I.spread(I.table(spark, sf, "pages")).select(
        "page_id",
        F.concat(F.lit(f'<div class="{C.EXTRA_CLASS}">'), line, F.lit("</div>"), "html").alias("html"),
    )
    return pg.subscribers(pg.parse_pages(pages, "page_id"), "page_id")
