"""SQL fragments for the comparison queries."""

from __future__ import annotations

from affinis.functions import constants as C
from affinis.functions.vectors import HASH_WIDTH


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(expression: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({expression}, {lit(pattern)}, {lit(replacement)}, 'g')"


def drop_links(expression: str) -> str:
    for pattern, replacement in C.LINK_PATTERNS:
        expression = replace_all(expression, pattern, replacement)
    return expression


def clear_emoji(expression: str) -> str:
    return replace_all(expression, C.EMOJI_SEQUENCE)


def strip(expression: str) -> str:
    return replace_all(expression, f"^{C.WS}+|{C.WS}+$")


def words(expression: str) -> str:
    pieces = f"string_split_regex({expression}, {lit(C.WS + '+')})"
    return f"list_filter({pieces}, lambda w: w <> '')"


def clean_text(expression: str) -> str:
    kept = replace_all(drop_links(f"lower({expression})"), f"[^{C.LETTERS}{C.WS[1:-1]}-]")
    return strip(replace_all(kept, C.WS + "+", " "))


def sentences(expression: str) -> str:
    marked = f"regexp_replace({expression}, {lit('([' + C.SENTENCE_END + '])' + C.WS + '+')}, '\\1' || chr(1), 'g')"
    return f"string_split({marked}, chr(1))"


def bucket(token: str, width: int = HASH_WIDTH) -> str:
    return f"(('0x' || substr(md5({token}), 1, 8))::BIGINT % {width})"


def cosine(a: str, b: str) -> str:
    a, b = f"{a}::DOUBLE[]", f"{b}::DOUBLE[]"
    return (
        f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * "
        f"sqrt(list_dot_product({b}, {b})), 0), 0)"
    )


def valid_sentences(rows_sql: str, min_words: int) -> str:
    """``(group_id, item_id, pos, sentence)`` from ``(group_id, item_id, text)``."""
    return f"""
    SELECT group_id, item_id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS sentence
    FROM (SELECT group_id, item_id,
                 list_filter({sentences('text')}, lambda s: len(string_split(s, ' ')) >= {min_words}) AS v
          FROM ({rows_sql}))"""


def group_vectors(rows_sql: str, rule) -> str:
    """Hashed mean vectors in long form ``(group_id, dim, value)``, all dimensions present."""
    blank = "AND NOT (n = 1 AND longest = 0)" if rule.drop_single_blank else ""
    return f"""
  WITH valid AS MATERIALIZED ({valid_sentences(rows_sql, rule.min_words)}),
  eligible AS (
    SELECT group_id FROM valid GROUP BY group_id
    HAVING count(DISTINCT item_id) >= {rule.min_messages} AND count(*) >= {rule.min_sentences}
       AND least(count(*), {rule.max_sentences}) >= {rule.min_items}),
  sampled AS MATERIALIZED (
    SELECT group_id, item_id, pos, {clear_emoji(drop_links('sentence'))} AS sentence
    FROM (SELECT *, row_number() OVER (PARTITION BY group_id
                 ORDER BY md5('{rule.seed}-' || item_id || '-' || pos), item_id, pos) AS r FROM valid)
    WHERE r <= {rule.max_sentences} AND group_id IN (SELECT group_id FROM eligible)),
  sizes AS (
    SELECT * FROM (SELECT group_id, count(*) AS n, max(length({strip('sentence')})) AS longest
                   FROM sampled GROUP BY group_id) WHERE true {blank}),
  hits AS (
    SELECT group_id, item_id, pos, {bucket('t')} AS dim, count(*) AS c
    FROM (SELECT group_id, item_id, pos, unnest({words('lower(sentence)')}) AS t FROM sampled)
    GROUP BY ALL),
  units AS (
    SELECT group_id, dim, c / sqrt(sum(c * c) OVER (PARTITION BY group_id, item_id, pos)) AS w FROM hits),
  sums AS (SELECT group_id, dim, sum(w) AS w FROM units GROUP BY group_id, dim)
  SELECT s.group_id, CAST(d.dim AS INTEGER) AS dim, coalesce(w, 0) / s.n AS value
  FROM sizes s CROSS JOIN (SELECT unnest(range({HASH_WIDTH})) AS dim) d
  LEFT JOIN sums u ON u.group_id = s.group_id AND u.dim = d.dim"""


def vector_lists(long_sql: str) -> str:
    """``(id, vec)`` from the long form."""
    return f"SELECT group_id AS id, list(value ORDER BY dim) AS vec FROM ({long_sql}) GROUP BY group_id"
