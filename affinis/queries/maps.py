"""Communities, labels, exports, audience overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.operators import audience
from affinis.operators import communities as cm
from affinis.queries import inputs as I
from affinis.queries import sql as Q
from affinis.queries.registry import query
from affinis.queries.similarity import _ALL
from affinis.session import scratch_path

# The fixture's vectors are far apart; these values make communities of 5 and more.
THRESHOLD, MIN_SIZE = 0.3, 5

_CANDIDATES = f"""
  SELECT channel_id AS centre_id, count(*) AS size FROM ({_ALL}) WHERE sim >= {THRESHOLD}
  GROUP BY channel_id HAVING count(*) >= {MIN_SIZE}"""
_WON = f"""
  WITH RECURSIVE sims AS MATERIALIZED (SELECT * FROM ({_ALL}) WHERE sim >= {THRESHOLD}),
  cand AS MATERIALIZED (
    SELECT channel_id AS centre_id, count(*) AS size, list(neighbour_id) AS members,
           row_number() OVER (ORDER BY count(*) DESC, channel_id) AS r
    FROM sims GROUP BY channel_id HAVING count(*) >= {MIN_SIZE}),
  walk(r, taken, ok) AS (
    SELECT 0::BIGINT, []::BIGINT[], false
    UNION ALL
    SELECT c.r, CASE WHEN list_has_any(w.taken, c.members) THEN w.taken
                     ELSE list_concat(w.taken, c.members) END,
           NOT list_has_any(w.taken, c.members)
    FROM walk w JOIN cand c ON c.r = w.r + 1),
  won AS (SELECT c.centre_id, c.size, c.members, row_number() OVER (ORDER BY c.r) - 1 AS community_id
          FROM walk w JOIN cand c ON c.r = w.r WHERE w.ok),
  members AS (SELECT community_id, centre_id, size, unnest(members) AS channel_id FROM won)"""


@query("community_candidates", _CANDIDATES)
def community_candidates(spark, sf):
    return cm.candidates(I.id_vectors(spark, sf), THRESHOLD, MIN_SIZE)


def _members(spark, sf):
    return cm.communities(I.id_vectors(spark, sf), THRESHOLD, MIN_SIZE)


@query("communities", f"{_WON} SELECT community_id, centre_id, size, channel_id FROM members")
def communities(spark, sf):
    return _members(spark, sf)


@query("community_sizes", f"{_WON} SELECT community_id, count(*) AS size FROM members GROUP BY community_id")
def community_sizes(spark, sf):
    return cm.sizes(_members(spark, sf))


_NAMES = ", ".join(f"({i}, {Q.lit(name)})" for i, name in C.COMMUNITY_NAMES.items())


def _labels_sql(noise: int) -> str:
    return f"""{_WON}
  SELECT l.channel_id, l.label, coalesce(n.name, 'unlabelled') AS label_name
  FROM (SELECT v.vec_id AS channel_id, coalesce(m.community_id, {noise}) AS label
        FROM embeddings v LEFT JOIN members m ON v.vec_id = m.channel_id) l
  LEFT JOIN (SELECT * FROM (VALUES {_NAMES}) t(label, name)) n ON n.label = l.label"""


@query("community_labels", _labels_sql(0))
def community_labels(spark, sf):
    return cm.labels(I.vectors(spark, sf), _members(spark, sf))


@query("community_labels_distinct", _labels_sql(-1))
def community_labels_distinct(spark, sf):
    return cm.labels(I.vectors(spark, sf), _members(spark, sf), distinct_noise=True)


@query(
    "community_sample",
    f"""{_WON}
  SELECT title, about, link FROM ({I.CHANNELS_SQL}) c
  WHERE channel_id IN (SELECT channel_id FROM members WHERE community_id = 1)
  ORDER BY md5('0-' || channel_id), channel_id LIMIT 30""",
)
def community_sample(spark, sf):
    return cm.community_sample(_members(spark, sf), I.channels(spark, sf), 1)


def _squared(name: str, times: int) -> str:
    """CTEs that square a symmetric matrix ``{name}0 (i, j, v)`` again and again, scaled by its trace: what is left in
    ``{name}`` is the product of its main axis with itself."""
    steps = [
        f"""{name}{n + 1} AS MATERIALIZED (
    SELECT i, j, v / sum(CASE WHEN i = j THEN v ELSE 0 END) OVER () AS v FROM (
      SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}{n} a JOIN {name}{n} b ON a.j = b.i GROUP BY a.i, b.j))"""
        for n in range(times)
    ]
    # the column of the largest diagonal entry, at unit length, its largest loading positive
    axis = f"""{name} AS MATERIALIZED (
    SELECT i, v / sqrt(sum(v * v) OVER ()) * sign(arg_max(v, abs(v)) OVER ()) AS v FROM {name}{times}
    WHERE j = (SELECT arg_max(i, v) FROM {name}{times} WHERE i = j))"""
    return ",\n  ".join([*steps, axis])


_SQUARINGS = 18  # axes whose variances differ by a thousandth of a percent are told apart
_POSITIONS = f"""
  WITH lengths AS (
    SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
  unit AS MATERIALIZED (SELECT vec_id, generate_subscripts(e, 1) AS i, CASE WHEN n = 0 THEN 0 ELSE unnest(e) / n END AS v FROM lengths),
  means AS (SELECT i, avg(v) AS m FROM unit GROUP BY i),
  centred AS MATERIALIZED (SELECT vec_id, unit.i, v - m AS v FROM unit JOIN means ON means.i = unit.i),
  x0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM centred a JOIN centred b USING (vec_id) GROUP BY a.i, b.i),
  {_squared("x", _SQUARINGS)},
  part AS (SELECT sum(a.v * x0.v * b.v) AS variance FROM x a JOIN x0 ON x0.i = a.i JOIN x b ON b.i = x0.j),
  y0 AS MATERIALIZED (
    SELECT x0.i, x0.j, x0.v - variance * a.v * b.v AS v FROM x0 JOIN x a ON a.i = x0.i JOIN x b ON b.i = x0.j, part),
  {_squared("y", _SQUARINGS)},
  positions AS (
    SELECT vec_id AS channel_id, sum(u.v * x.v) AS pos_x, sum(u.v * y.v) AS pos_y
    FROM unit u JOIN x ON x.i = u.i JOIN y ON y.i = u.i GROUP BY vec_id)"""


@query("project_2d", f"{_POSITIONS} SELECT channel_id, {I.r6('pos_x')} AS pos_x, {I.r6('pos_y')} AS pos_y FROM positions")
def project_2d(spark, sf):
    """Positions on the two main axes, which the SQL finds by squaring the covariances."""
    rows = cm.project_2d(I.id_vectors(spark, sf))
    return rows.select("channel_id", *(I.round6(F.col(x)).alias(x) for x in ("pos_x", "pos_y")))


@query(
    "community_export",
    f"""{_POSITIONS}
  SELECT channel_id, label_name AS labels, round(pos_x, 3) + 0.0::DOUBLE AS pos_x, round(pos_y, 3) + 0.0::DOUBLE AS pos_y
  FROM ({_labels_sql(0)}) l JOIN positions USING (channel_id)""",
)
def community_export(spark, sf):
    """The rows of the export file read back."""
    path = scratch_path(I.configure(spark), "community-export")
    labelled = cm.labels(I.vectors(spark, sf), _members(spark, sf))
    cm.write_export(cm.export_rows(labelled, cm.project_2d(I.id_vectors(spark, sf))), path)
    schema = "channel_id bigint, labels string, pos_x float, pos_y float"
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select("channel_id", "labels", *((F.round(F.col(x).cast("double"), 3) + F.lit(0.0)).alias(x) for x in ("pos_x", "pos_y")))


@query(
    "audience_overlap",
    """WITH v AS (SELECT DISTINCT l_suppkey AS channel, l_orderkey AS u FROM lineitem)
       SELECT a.channel AS channel_a, b.channel AS channel_b, count(*) AS common
       FROM v a JOIN v b ON a.u = b.u AND a.channel < b.channel GROUP BY ALL""",
)
def audience_overlap(spark, sf):
    """Suppliers as channels, orders as users."""
    visits = I.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("bigint").alias("channel"), F.col("l_orderkey").cast("bigint").alias("user")
    )
    return audience.audience_overlap(visits)


@query(
    "audience_overlap_events",
    """WITH v AS (SELECT DISTINCT event_type, user_id FROM events),
       c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS channel
             FROM (SELECT DISTINCT event_type FROM events)),
       n AS (SELECT channel, user_id FROM v JOIN c USING (event_type))
       SELECT a.channel AS channel_a, b.channel AS channel_b, count(*) AS common
       FROM n a JOIN n b ON a.user_id = b.user_id AND a.channel < b.channel GROUP BY ALL""",
)
def audience_overlap_events(spark, sf):
    """Event types as channels: few channels, each with most of the users."""
    events = I.table(spark, sf, "events").select("event_type", "user_id")
    names = events.select("event_type").distinct()
    numbered = cm.row_numbers(cm.ordered_parts(names, [], ["event_type"]), [], ["event_type"], "channel")
    visits = events.join(numbered, "event_type").select("channel", F.col("user_id").alias("user"))
    return audience.audience_overlap(visits)
