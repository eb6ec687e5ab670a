"""Vector similarity: neighbour tables, searches, threshold joins, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.functions import vectors as V
from affinis.operators import hyperplanes as hp
from affinis.operators import similarity as sim
from affinis.operators.pivots import PivotIndex
from affinis.plans import search
from affinis.queries import inputs as I
from affinis.queries import sql as Q
from affinis.queries.registry import query

_ALL = f"""
  SELECT a.vec_id AS channel_id, b.vec_id AS neighbour_id,
         {Q.cosine('a.embedding', 'b.embedding')} AS sim
  FROM embeddings a, embeddings b"""
_ORDER = "ORDER BY round(sim, 9) DESC, neighbour_id"
_RANKED = f"""
  SELECT channel_id, row_number() OVER (PARTITION BY channel_id {_ORDER}) AS rank,
         neighbour_id, sim FROM ({_ALL}) WHERE channel_id <> neighbour_id"""


def _neighbours(spark, sf, k=C.NEIGHBOURS, **options):
    return search.neighbour_table(I.vectors(spark, sf), k, **options)


def _shown(df, *keys):
    return df.select(*keys, F.col("rank").cast("bigint").alias("rank"), "neighbour_id",
                     I.round6(F.col("sim")).alias("sim"))


@query(
    "topk_neighbours",
    f"SELECT channel_id, rank, neighbour_id, {I.r6('sim')} AS sim FROM ({_RANKED}) WHERE rank <= {C.NEIGHBOURS}",
)
def topk_neighbours(spark, sf):
    return _shown(_neighbours(spark, sf), "channel_id")


@query(
    "topk_neighbours_grid",
    f"SELECT channel_id, rank, neighbour_id, {I.r6('sim')} AS sim FROM ({_RANKED}) WHERE rank <= {C.NEIGHBOURS}",
)
def topk_neighbours_grid(spark, sf):
    """The plan for tables beyond the broadcast bound, with panels small enough to need several."""
    return _shown(_neighbours(spark, sf, method="grid", panel_bytes=1 << 17), "channel_id")


@query(
    "neighbour_lists",
    f"""SELECT channel_id, string_agg(neighbour_id, ',' ORDER BY rank) AS neighbours
        FROM ({_RANKED}) WHERE rank <= 10 GROUP BY channel_id""",
)
def neighbour_lists(spark, sf):
    lists = search.neighbour_lists(_neighbours(spark, sf), 10)
    return lists.select("channel_id", F.array_join("neighbours.neighbour_id", ",").alias("neighbours"))


@query(
    "topk_with_cutoff",
    f"""SELECT channel_id, rank, neighbour_id, {I.r6('sim')} AS sim FROM ({_RANKED})
        WHERE rank <= {C.NEIGHBOURS} AND sim >= 0.3""",
)
def topk_with_cutoff(spark, sf):
    return _shown(_neighbours(spark, sf, min_sim=0.3), "channel_id")


@query(
    "topk_exclude_top1",
    f"""SELECT channel_id, r - 1 AS rank, neighbour_id, {I.r6('sim')} AS sim FROM (
          SELECT *, row_number() OVER (PARTITION BY channel_id {_ORDER}) AS r
          FROM ({_ALL})) WHERE r BETWEEN 2 AND {C.NEIGHBOURS + 1}""",
)
def topk_exclude_top1(spark, sf):
    """The literal slice: skip whatever ranks first."""
    return _shown(_neighbours(spark, sf, exclude="top1"), "channel_id")


@query(
    "topk_euclidean",
    f"""SELECT channel_id, rank, neighbour_id, {I.r6('sim')} AS sim FROM (
          SELECT channel_id, neighbour_id, sim,
                 row_number() OVER (PARTITION BY channel_id {_ORDER}) AS rank
          FROM (SELECT a.vec_id AS channel_id, b.vec_id AS neighbour_id,
                       -list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
                FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 10""",
)
def topk_euclidean(spark, sf):
    return _shown(_neighbours(spark, sf, 10, metric="euclidean"), "channel_id")


_RESULTS = f"""
  SELECT n.channel_id, n.rank, m.link, m.title, {I.r6('n.sim')} AS sim
  FROM ({_RANKED}) n JOIN ({I.CHANNELS_SQL}) m ON m.channel_id = n.neighbour_id
  JOIN ({I.CHANNELS_SQL}) q ON q.channel_id = n.channel_id
  WHERE n.rank <= {C.RESULTS} AND NOT suffix(m.link, 'bot') AND m.link <> q.link"""


def _results(spark, sf, **options):
    meta = I.channels(spark, sf)
    own = meta.select("channel_id", F.col("link").alias("own"))
    hits = _neighbours(spark, sf).join(own, "channel_id")
    return search.form_results(hits, meta, ["channel_id"], own_handle="own", **options)


@query("similar_channels", _RESULTS)
def similar_channels(spark, sf):
    rows = _results(spark, sf)
    return rows.select("channel_id", F.col("rank").cast("bigint").alias("rank"), "link", "title",
                       I.round6(F.col("sim")).alias("sim"))


@query(
    "result_filters",
    f"""SELECT channel_id, rank, link, sim FROM (
          SELECT n.channel_id, row_number() OVER (PARTITION BY n.channel_id ORDER BY n.rank) AS rank,
                 m.link, {I.r6('n.sim')} AS sim
          FROM ({_RANKED}) n JOIN ({I.CHANNELS_SQL}) m ON m.channel_id = n.neighbour_id
          WHERE n.rank <= {C.NEIGHBOURS} AND NOT suffix(m.link, 'bot')) WHERE rank <= {C.RESULTS}""",
)
def result_filters(spark, sf):
    """Filters before the cut, so that dropped hits are refilled."""
    rows = _results(spark, sf, refill=True)
    return rows.select("channel_id", F.col("rank").cast("bigint").alias("rank"), "link",
                       I.round6(F.col("sim")).alias("sim"))


@query(
    "format_results",
    f"""SELECT channel_id, string_agg('@' || link || ' - ' || title || ' (' ||
               CAST(round_even(sim * 100, 0) AS BIGINT) || '%)', chr(10) || chr(10) ORDER BY rank) AS message
        FROM ({_RESULTS}) GROUP BY channel_id""",
)
def format_results(spark, sf):
    rounded = _results(spark, sf).withColumn("sim", I.round6(F.col("sim")))
    return search.format_results(rounded, ["channel_id"])


def _search_sql(skip: int) -> str:
    return f"""
  SELECT request_id, r - {skip} AS rank, neighbour_id, {I.r6('sim')} AS sim FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id {_ORDER}) AS r FROM (
      SELECT q.label AS request_id, b.vec_id AS neighbour_id,
             {Q.cosine('q.vec', 'b.embedding')} AS sim
      FROM ({_LABEL_MEANS}) q, embeddings b))
  WHERE r > {skip} AND r <= {C.NEIGHBOURS + skip}"""


_LABEL_MEANS = """
  SELECT label, list(m ORDER BY pos) AS vec FROM (
    SELECT label, pos, avg(v) AS m FROM (
      SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
    GROUP BY label, pos) GROUP BY label"""


def _label_means(spark, sf):
    rows = I.table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return rows.groupBy("label").agg(V.as_array(V.mean_vector(F.col("v"))).alias("embedding"))


@query(
    "mean_pool",
    f"""SELECT label, generate_subscripts(vec, 1) - 1 AS pos, {I.r6('unnest(vec)')} AS value
        FROM ({_LABEL_MEANS})""",
)
def mean_pool(spark, sf):
    rows = _label_means(spark, sf).select("label", F.posexplode("embedding").alias("pos", "value"))
    return rows.select("label", F.col("pos").cast("bigint").alias("pos"), I.round6(F.col("value")).alias("value"))


def _search(spark, sf, skip):
    queries = _label_means(spark, sf).select(F.col("label").cast("bigint").alias("request_id"), "embedding")
    return _shown(search.search_vectors(queries, I.vectors(spark, sf), skip=skip), "request_id")


@query("search_by_vector", _search_sql(0))
def search_by_vector(spark, sf):
    return _search(spark, sf, 0)


@query("search_by_vector_skip1", _search_sql(1))
def search_by_vector_skip1(spark, sf):
    return _search(spark, sf, 1)


@query(
    "similarity_threshold_join",
    f"SELECT channel_id AS left_id, neighbour_id AS right_id, {I.r6('sim')} AS sim FROM ({_ALL}) WHERE sim >= 0.3",
)
def similarity_threshold_join(spark, sf):
    v = I.id_vectors(spark, sf)
    return sim.threshold_join(v, v, 0.3).select("left_id", "right_id", I.round6(F.col("sim")).alias("sim"))


@query(
    "topk_neighbours_pivots",
    f"SELECT channel_id, rank, neighbour_id, {I.r6('sim')} AS sim FROM ({_RANKED}) WHERE rank <= {C.NEIGHBOURS}",
)
def topk_neighbours_pivots(spark, sf):
    """The same neighbours from groups by nearest pivot, far groups skipped."""
    v = I.id_vectors(spark, sf)
    found = PivotIndex(v).top_k(v, C.NEIGHBOURS, exclude_self=True)
    return _shown(found.withColumnRenamed("query_id", "channel_id"), "channel_id")


@query(
    "similarity_threshold_join_pivots",
    f"SELECT channel_id AS left_id, neighbour_id AS right_id, {I.r6('sim')} AS sim FROM ({_ALL}) WHERE sim >= 0.3",
)
def similarity_threshold_join_pivots(spark, sf):
    v = I.id_vectors(spark, sf)
    found = PivotIndex(v).threshold_join(v, 0.3)
    return found.select("left_id", "right_id", I.round6(F.col("sim")).alias("sim"))


def _planes(spark, sf, threshold):
    v = I.id_vectors(spark, sf)
    return hp.HyperplaneIndex(v, *hp.choose_tables(threshold, hp.RECALL, v.count()))


@query("similarity_threshold_join_approx")
def similarity_threshold_join_approx(spark, sf):
    """Pairs that share a bucket of hyperplanes; ``approximate_recall`` holds them against all pairs."""
    found = _planes(spark, sf, 0.3).threshold_join(0.3)
    return found.select("left_id", "right_id", I.round6(F.col("sim")).alias("sim"))


@query("topk_neighbours_approx")
def topk_neighbours_approx(spark, sf):
    found = _planes(spark, sf, 0.3).top_k(10)
    return _shown(found.withColumnRenamed("query_id", "channel_id"), "channel_id")


@query(
    "approximate_recall",
    """SELECT unnest(['join', 'top']) AS search, true AS reached, 0 AS not_exact""",
)
def approximate_recall(spark, sf):
    """Whether the approximate searches find 0.9 of what the exact ones do, and how many scores differ."""
    v, planes = I.id_vectors(spark, sf), _planes(spark, sf, 0.3)

    def joined(some):
        return planes.threshold_join(0.3, some), sim.threshold_join(v if some is None else v.where(some), v, 0.3)

    searches = {
        "join": hp.recall_by_slices(joined, ["left_id", "right_id"], v, planes.count),
        "top": hp.recall(planes.top_k(10), sim.top_k(v, v, 10, exclude="self"), ["query_id", "neighbour_id"]),
    }
    out = None
    for name, found in searches.items():
        row = found.select(
            F.lit(name).alias("search"), (F.col("recall") >= 0.9).alias("reached"), F.col("not_exact").cast("int").alias("not_exact")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "threshold_join_near",
    """WITH r AS (SELECT vec_id, label, 0.85 + (vec_id % 6 - 2.5) * 1e-10 AS c FROM embeddings)
       SELECT a.label AS left_id, r.vec_id AS right_id
       FROM (SELECT DISTINCT label FROM embeddings) a, r WHERE r.c >= 0.85""",
)
def threshold_join_near(spark, sf):
    """Scores closer to the threshold than any rounding of results: each label against unit vectors
    that stand at 0.85, give or take a few 1e-10."""
    rows = I.table(spark, sf, "embeddings").select("vec_id", "label")
    axis = rows.select(F.col("label").cast("bigint").alias("id")).distinct()
    left = axis.withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)))
    at = F.lit(0.85) + (F.col("vec_id") % 6 - F.lit(2.5)) * F.lit(1e-10)
    right = rows.select(F.col("vec_id").alias("id"), F.array(at, F.sqrt(1 - at * at)).alias("vec"))
    return sim.threshold_join(left, right, 0.85).select("left_id", "right_id")


@query(
    "cosine_pairs",
    f"""SELECT v.vec_id, v.label, {I.r6(Q.cosine('v.embedding', 'm.vec'))} AS sim
        FROM embeddings v JOIN ({_LABEL_MEANS}) m ON v.label = m.label""",
)
def cosine_pairs(spark, sf):
    """Cosine as an expression: each vector against the mean of its label."""
    means = _label_means(spark, sf).withColumnRenamed("embedding", "mean")
    rows = I.table(spark, sf, "embeddings").join(means, "label")
    return rows.select("vec_id", "label", I.round6(V.cosine(F.col("embedding"), F.col("mean"))).alias("sim"))


@query(
    "l2_normalise",
    f"""SELECT vec_id, pos, {I.r6('v / n')} AS value FROM (
          SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE * 3 AS v,
                 3 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
)
def l2_normalise(spark, sf):
    scaled = I.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v")
    )
    sized = scaled.withColumn("length", V.norm(F.col("v")))
    rows = sized.select("vec_id", F.posexplode(V.l2_normalise(F.col("v"), F.col("length"))).alias("pos", "value"))
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), I.round6(F.col("value")).alias("value"))
