"""From text to vectors: hashed, model, word-vector and TF-IDF encoders."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.functions import text as tx
from affinis.functions import vectors as V
from affinis.operators import similarity as sim
from affinis.operators import tfidf, wordvec
from affinis.operators.prefixes import PrefixLists
from affinis.plans import vectors as pv
from affinis.queries import inputs as I
from affinis.queries import sql as Q
from affinis.queries.registry import query
from affinis.session import materialise, scratch_path
from affinis.sources import channels as ch

SIMILAR_TEXTS = 0.9  # score of texts that count as similar

_GROUP_ROWS = f"SELECT channel_id AS group_id, message_id AS item_id, message AS text FROM ({I.DOCUMENT_MESSAGES_SQL})"


def _group_rows(spark, sf):
    return I.document_messages(spark, sf).select(
        F.col("channel_id").alias("group_id"), F.col("message_id").alias("item_id"), F.col("message").alias("text")
    )


@query(
    "valid_sentences",
    f"""SELECT group_id AS channel_id, item_id AS message_id, pos, sentence
        FROM ({Q.valid_sentences(_GROUP_ROWS, C.MIN_SENTENCE_WORDS)})""",
)
def valid_sentences(spark, sf):
    rows = pv.valid_sentences(_group_rows(spark, sf), C.MIN_SENTENCE_WORDS).select(
        F.col("group_id").alias("channel_id"), F.col("item_id").alias("message_id"),
        F.posexplode("valid").alias("pos", "sentence"),
    )
    return rows.select("channel_id", "message_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


_STRICT = replace(pv.CHANNELS, min_messages=48)
_STATS = f"""
  SELECT channel_id, coalesce(n_messages, 0) AS n_messages, coalesce(n_sentences, 0) AS n_sentences
  FROM (SELECT DISTINCT channel_id FROM ({I.DOCUMENT_MESSAGES_SQL}))
  LEFT JOIN (SELECT group_id AS channel_id, count(DISTINCT item_id) AS n_messages, count(*) AS n_sentences
             FROM ({Q.valid_sentences(_GROUP_ROWS, C.MIN_SENTENCE_WORDS)}) GROUP BY group_id)
  USING (channel_id)"""
_IS_ELIGIBLE = f"n_messages >= 48 AND n_sentences >= {C.MIN_SENTENCES}"


@query(
    "channel_eligibility",
    f"SELECT channel_id, n_messages, n_sentences, CAST({_IS_ELIGIBLE} AS INTEGER) AS eligible FROM ({_STATS})",
)
def channel_eligibility(spark, sf):
    stats = pv.group_statistics(pv.valid_sentences(_group_rows(spark, sf), C.MIN_SENTENCE_WORDS))
    return stats.select(
        F.col("group_id").alias("channel_id"), "n_messages", "n_sentences",
        pv.is_eligible(_STRICT).cast("int").alias("eligible"),
    )


@query(
    "rejected_channels",
    f"SELECT count(*) FILTER (NOT ({_IS_ELIGIBLE})) AS rejected, count(*) AS channels FROM ({_STATS})",
)
def rejected_channels(spark, sf):
    return pv.rejected(I.document_messages(spark, sf), _STRICT)


@query(
    "sample_sentences",
    f"""SELECT group_id AS channel_id, item_id AS message_id, pos, sentence FROM (
          SELECT *, row_number() OVER (PARTITION BY group_id
                    ORDER BY md5('0-' || item_id || '-' || pos), item_id, pos) AS r
          FROM ({Q.valid_sentences(_GROUP_ROWS, C.MIN_SENTENCE_WORDS)})) WHERE r <= {C.MAX_SENTENCES}""",
)
def sample_sentences(spark, sf):
    rows = pv.sample_sentences(pv.valid_sentences(_group_rows(spark, sf), C.MIN_SENTENCE_WORDS), pv.CHANNELS)
    return rows.select(F.col("group_id").alias("channel_id"), F.col("item_id").alias("message_id"),
                       F.col("pos").cast("bigint").alias("pos"), "sentence")


def _long(vectors, key):
    rows = vectors.select(key, F.posexplode("embedding").alias("dim", "value"))
    return rows.select(key, "dim", I.round6(F.col("value")).alias("value"))


def _build_sql() -> str:
    recent = f"""SELECT channel_id AS group_id, message_id AS item_id, message AS text FROM ({I.MESSAGES_SQL})
                 WHERE date >= TIMESTAMP '{I.MESSAGE_CUTOFF}' + INTERVAL 1 DAY"""
    return f"""SELECT group_id AS channel_id, dim, {I.r6('value')} AS value
               FROM ({Q.group_vectors(recent, _BUILD)})"""


_BUILD = replace(pv.CHANNELS, min_messages=10)


@query("build_channel_embeddings", _build_sql())
def build_channel_embeddings(spark, sf):
    """Recent messages to stored channel vectors, end to end."""
    from affinis.sources.messages import scan_messages

    rows = scan_messages(I.messages(spark, sf), cutoff=I.MESSAGE_CUTOFF)
    path = scratch_path(spark, "channel-embeddings")
    ch.write_embeddings(pv.channel_embeddings(rows, _BUILD), path)
    return _long(ch.read_embeddings(spark, path), "channel_id")


_REQUESTS = "SELECT item_id AS group_id, 0 AS item_id, text FROM benchmark"


@query(
    "description_vectors",
    f"SELECT group_id AS request_id, dim, {I.r6('value')} AS value FROM ({Q.group_vectors(_REQUESTS, pv.DESCRIPTIONS)})",
)
def description_vectors(spark, sf):
    requests = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    return _long(pv.description_vectors(requests), "request_id")


_HASHED = f"""
  WITH hits AS (
    SELECT doc_id, {Q.bucket('t')} AS dim, count(*) AS c
    FROM (SELECT doc_id, unnest({Q.words('lower(text)')}) AS t FROM documents) GROUP BY ALL)
  SELECT doc_id, CAST(dim AS INTEGER) AS dim,
         {I.r6('c / sqrt(sum(c * c) OVER (PARTITION BY doc_id))')} AS value FROM hits"""


def _sparse(df, key):
    parts = df.select(key, V.sparse_parts(F.col("v")).alias("p"))
    rows = parts.select(key, F.explode(F.arrays_zip("p.idx", "p.val")).alias("e"))
    return rows.select(key, F.col("e.idx").alias("dim"), I.round6(F.col("e.val")).alias("value"))


@query("hashed_vectors", _HASHED)
def hashed_vectors(spark, sf):
    docs = I.documents(spark, sf).select("doc_id", tx.words(F.lower("text")).alias("tokens"))
    return _sparse(V.hashed_vectors(docs, "tokens", "v"), "doc_id")


def _demo_model():
    """Stands in for a pretrained model: the hashed encoder as a batch function."""
    import hashlib

    import numpy as np

    def predict(texts):
        out = np.zeros((len(texts), V.HASH_WIDTH), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                digest = hashlib.md5(word.encode()).hexdigest()
                out[row, int(digest[:8], 16) % V.HASH_WIDTH] += 1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return predict


_EMBED = f"""
  WITH s AS ({Q.valid_sentences("SELECT item_id AS group_id, 0 AS item_id, text FROM benchmark", 1)}),
  hits AS (SELECT group_id, pos, {Q.bucket('t')} AS dim, count(*) AS c
           FROM (SELECT group_id, pos, unnest({Q.words('lower(sentence)')}[1:{C.MAX_TOKENS}]) AS t FROM s)
           GROUP BY ALL)
  SELECT group_id AS item_id, pos, CAST(dim AS BIGINT) AS dim,
         (round(c / sqrt(sum(c * c) OVER (PARTITION BY group_id, pos)), 4) + 0.0::DOUBLE) AS value FROM hits"""


@query("embed_text", _EMBED)
def embed_text(spark, sf):
    """The model hook on every sentence of the benchmark texts."""
    texts = I.table(spark, sf, "benchmark").select(
        "item_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "sentence")
    )
    encoded = pv.model_encoder(_demo_model)(texts)
    rows = encoded.select("item_id", "pos", F.posexplode(V.as_array(F.col("vec"))).alias("dim", "value"))
    return rows.where("value <> 0").select(
        "item_id", F.col("pos").cast("bigint").alias("pos"), F.col("dim").cast("bigint").alias("dim"),
        (F.round("value", 4) + F.lit(0.0)).alias("value"),
    )


# word vectors: each word longer than three letters owns the vector its md5 points to
_WORDS = f"""
  SELECT t AS token, e.embedding::DOUBLE[] AS vector
  FROM (SELECT DISTINCT t FROM (SELECT unnest({Q.words(Q.clean_text('message'))}) AS t
        FROM ({I.DOCUMENT_MESSAGES_SQL})) WHERE length(t) > 3) w
  JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS slot FROM embeddings) e
    ON e.slot = ('0x' || substr(md5(w.t), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)"""


def word_vectors(spark, sf, tokens):
    """``(token, vector)`` for the fixture's words; shorter words stay out of vocabulary."""
    slots = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("vector"))
    n = slots.count()  # the ids of this table are 0 .. n-1
    words = tokens.select(F.explode("tokens").alias("token")).where(F.length("token") > 3).distinct()
    return words.withColumn("slot", V.hash_bucket(F.col("token"), n)).join(slots, "slot").select("token", "vector")


@query(
    "wordvec_channel_mean",
    f"""WITH words AS MATERIALIZED ({_WORDS}),
        rows AS (SELECT channel_id, message_id, unnest(t) AS token FROM (
                   SELECT channel_id, row_number() OVER () AS message_id, {Q.words(Q.clean_text('message'))} AS t
                   FROM ({I.DOCUMENT_MESSAGES_SQL})) WHERE len(t) > {C.WORD_VECTOR_TOKENS}),
        counts AS (SELECT channel_id, message_id, token, count(*) AS n FROM rows
                   WHERE token IN (SELECT token FROM words) GROUP BY ALL),
        weights AS (SELECT channel_id, token, sum(w) AS w FROM (
                      SELECT channel_id, token, n / sum(n) OVER (PARTITION BY channel_id, message_id) AS w
                      FROM counts) GROUP BY ALL),
        parts AS (SELECT channel_id, generate_subscripts(vector, 1) - 1 AS dim, unnest(vector) * w AS v, w
                  FROM weights JOIN words USING (token))
        SELECT channel_id, CAST(dim AS INTEGER) AS dim, {I.r6('sum(v) / sum(w)')} AS value
        FROM parts GROUP BY channel_id, dim""",
)
def wordvec_channel_mean(spark, sf):
    tokens = wordvec.message_tokens(I.document_messages(spark, sf))
    blocks = wordvec.word_blocks(tokens)
    words = materialise(word_vectors(spark, sf, wordvec.block_tokens(blocks)), "words")
    return _long(wordvec.channel_means(tokens, words, blocks), "channel_id")


_TFIDF = f"""
  WITH t AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(lower(text), {Q.lit(C.TOKEN)}) AS w FROM documents),
  tf AS MATERIALIZED (
    SELECT doc_id, term, count(*) AS n FROM (
      SELECT doc_id, unnest(w) AS term FROM t
      UNION ALL
      SELECT doc_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2]))
      FROM t WHERE len(w) > 1) GROUP BY ALL),
  vocab AS (
    SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1 AS idf FROM (
      SELECT term, sum(n) AS total, count(*) AS df FROM tf GROUP BY term)
    WHERE df >= {C.TFIDF_MIN_DF} ORDER BY total DESC, term LIMIT {C.TFIDF_MAX_FEATURES}),
  raw AS (SELECT doc_id, term, n * idf AS w FROM tf JOIN vocab USING (term)),
  unit AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def _fitted(spark, sf):
    words = materialise(tfidf.document_words(I.documents(spark, sf).select("doc_id", "text")), "words")
    model = tfidf.fit(words)
    return model, model.fitted_vectors()


@query("tfidf_vectors", f"{_TFIDF} SELECT doc_id, term, {I.r6('weight')} AS weight FROM unit")
def tfidf_vectors(spark, sf):
    model, vectors = _fitted(spark, sf)
    return model.long_form(vectors).select("doc_id", "term", I.round6(F.col("weight")).alias("weight"))


@query("roundtrip_sparse", f"{_TFIDF} SELECT doc_id, term, {I.r6('weight')} AS weight FROM unit")
def roundtrip_sparse(spark, sf):
    model, vectors = _fitted(spark, sf)
    path = scratch_path(spark, "sparse")
    ch.write_sparse(model.long_form(vectors), path)
    return ch.read_sparse(spark, path).select("doc_id", "term", I.round6(F.col("weight")).alias("weight"))


@query(
    "tfidf_similar_docs",
    f"""{_TFIDF},
  hits AS (SELECT a.doc_id AS doc_id, b.doc_id AS similar_id, sum(a.weight * b.weight) AS sim
           FROM unit a JOIN unit b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL)
  SELECT doc_id, rank, similar_id, {I.r6('sim')} AS sim FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, similar_id) AS rank FROM hits)
  WHERE rank <= {C.RESULTS}""",
)
def tfidf_similar_docs(spark, sf):
    model, vectors = _fitted(spark, sf)
    table = vectors.withColumnRenamed("doc_id", "id")  # formed from the written counts when it is read
    hits = sim.top_k(table, table, C.RESULTS, exclude="self", metric="dot", dim=max(1, len(model.terms)))
    return hits.where("sim > 0").select(
        F.col("query_id").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"),
        F.col("neighbour_id").alias("similar_id"), I.round6(F.col("sim")).alias("sim"),
    )


@query(
    "tfidf_similar_pairs",
    f"""{_TFIDF},
  hits AS (SELECT a.doc_id AS doc_id, b.doc_id AS similar_id, sum(a.weight * b.weight) AS sim
           FROM unit a JOIN unit b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL)
  SELECT doc_id, similar_id, {I.r6('sim')} AS sim FROM hits WHERE sim >= {SIMILAR_TEXTS}""",
)
def tfidf_similar_pairs(spark, sf):
    """Pairs at or above a threshold by the lists of their rare terms."""
    model, vectors = _fitted(spark, sf)
    lists = PrefixLists(vectors.withColumnRenamed("doc_id", "id"), SIMILAR_TEXTS, len(model.terms))
    pairs = lists.join().where("left_id <> right_id")
    return pairs.select(
        F.col("left_id").alias("doc_id"), F.col("right_id").alias("similar_id"), I.round6(F.col("sim")).alias("sim")
    )


@query(
    "tfidf_channel_vectors",
    f"""{_TFIDF},
  sizes AS (SELECT {I.SOURCE_ID_SQL} AS channel_id, count(*) AS n FROM documents GROUP BY ALL)
  SELECT channel_id, term, {I.r6('sum(weight) / any_value(n)')} AS weight
  FROM unit JOIN (SELECT doc_id, {I.SOURCE_ID_SQL} AS channel_id FROM documents) USING (doc_id)
  JOIN sizes USING (channel_id) GROUP BY channel_id, term""",
)
def tfidf_channel_vectors(spark, sf):
    model, vectors = _fitted(spark, sf)
    means = _channel_means(spark, sf, vectors).withColumnRenamed("id", "doc_id")
    rows = model.long_form(means)
    return rows.select(
        F.col("doc_id").alias("channel_id"), "term", I.round6(F.col("weight")).alias("weight")
    )


def _channel_means(spark, sf, vectors):
    groups = I.table(spark, sf, "documents").select("doc_id", I.source_id().alias("group"))
    return tfidf.average_by(vectors, groups)


@query(
    "tfidf_similar_channels",
    f"""{_TFIDF},
  sizes AS (SELECT {I.SOURCE_ID_SQL} AS channel_id, count(*) AS n FROM documents GROUP BY ALL),
  means AS (
    SELECT channel_id, term, sum(weight) / any_value(n) AS w
    FROM unit JOIN (SELECT doc_id, {I.SOURCE_ID_SQL} AS channel_id FROM documents) USING (doc_id)
    JOIN sizes USING (channel_id) GROUP BY channel_id, term),
  norms AS (SELECT channel_id, sqrt(sum(w * w)) AS norm FROM means GROUP BY channel_id),
  hits AS (
    SELECT a.channel_id, b.channel_id AS neighbour_id, sum(a.w * b.w) / any_value(x.norm * y.norm) AS sim
    FROM means a JOIN means b ON a.term = b.term AND a.channel_id <> b.channel_id
    JOIN norms x ON x.channel_id = a.channel_id JOIN norms y ON y.channel_id = b.channel_id GROUP BY ALL)
  SELECT channel_id, rank, neighbour_id, {I.r6('sim')} AS sim FROM (
    SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY round(sim, 9) DESC, neighbour_id) AS rank FROM hits)
  WHERE rank <= {C.RESULTS}""",
)
def tfidf_similar_channels(spark, sf):
    model, vectors = _fitted(spark, sf)
    means = materialise(_channel_means(spark, sf, vectors), "tfidf-channels")
    hits = sim.top_k(means, means, C.RESULTS, exclude="self", dim=max(1, len(model.terms)))
    return hits.select(
        F.col("query_id").alias("channel_id"), F.col("rank").cast("bigint").alias("rank"),
        "neighbour_id", I.round6(F.col("sim")).alias("sim"),
    )


@query(
    "selected_channel_embeddings",
    f"""WITH picked AS MATERIALIZED (
          SELECT channel_id, message_id, {Q.words('lower(clean)')} AS t
          FROM (SELECT channel_id, message_id, {Q.drop_links('message')} AS clean FROM ({I.DOCUMENT_MESSAGES_SQL}))
          WHERE len({Q.words('clean')}) > {C.LONG_MESSAGE_WORDS}),
        sizes AS (SELECT channel_id, count(*) AS n FROM picked GROUP BY channel_id HAVING count(*) >= {C.MIN_MESSAGES}),
        hits AS (SELECT channel_id, message_id, {Q.bucket('t')} AS dim, count(*) AS c
                 FROM (SELECT channel_id, message_id, unnest(t) AS t FROM picked) GROUP BY ALL),
        units AS (SELECT channel_id, dim, c / sqrt(sum(c * c) OVER (PARTITION BY channel_id, message_id)) AS w FROM hits)
        SELECT channel_id, CAST(dim AS INTEGER) AS dim, {I.r6('sum(w) / any_value(n)')} AS value
        FROM units JOIN sizes USING (channel_id) GROUP BY channel_id, dim""",
)
def selected_channel_embeddings(spark, sf):
    """Whole long messages as the items of a channel, instead of sampled sentences."""
    vectors = pv.selected_vectors(_group_rows(spark, sf)).withColumnRenamed("group_id", "channel_id")
    return _long(vectors, "channel_id").where("value <> 0")
