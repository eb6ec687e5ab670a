"""Text functions and token tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.functions import handles as hd
from affinis.functions import text as tx
from affinis.operators import sentences as sn
from affinis.operators import tokens as tk
from affinis.queries import inputs as I
from affinis.queries import sql as Q
from affinis.queries.registry import query
from affinis.queries.scans import linked_text

_LINKED = "text || ' https://t.me/' || source || '_chan/' || doc_id || ' @' || source || ' <b>x</b>'"


# A small stop list in the languages of the fixture.
STOP_WORDS = "the of and a to in is on at by for le la de un une der die und el los".split()
_STOP_SQL = ", ".join(Q.lit(w) for w in STOP_WORDS)


@query("drop_links", f"SELECT doc_id, {Q.drop_links(_LINKED)} AS clean FROM documents")
def drop_links(spark, sf):
    return I.documents(spark, sf).select("doc_id", tx.drop_links(linked_text()).alias("clean"))


_EMOJI_TAIL = " 😀 👍🏽❤️ 👩‍👩‍👧 🇫🇷 1️⃣ © ok"


@query(
    "clear_emoji",
    f"SELECT doc_id, {Q.clear_emoji('text || ' + Q.lit(_EMOJI_TAIL) + ' || source')} AS clean FROM documents",
)
def clear_emoji(spark, sf):
    text = F.concat("text", F.lit(_EMOJI_TAIL), "source")
    return I.documents(spark, sf).select("doc_id", tx.clear_emoji(text).alias("clean"))


_SENTENCES = f"""
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence
  FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents)"""


@query(
    "split_sentences",
    _SENTENCES,
)
def split_sentences(spark, sf):
    rows = I.documents(spark, sf).select(
        "doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "sentence")
    )
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


_WORD_SCORES = rf"""
  WITH bare AS (
    SELECT trim(t, {Q.lit(sn.WRAPPING)}) AS b FROM (SELECT unnest({Q.words("lower(coalesce(text, ''))")}) AS t FROM documents)),
  cut AS (SELECT suffix(b, '.') AND NOT suffix(b, '..') AS stop, CASE WHEN stop THEN b[:len(b) - 1] ELSE b END AS word FROM bare),
  counts AS (
    SELECT word, count(*) FILTER (stop) AS stops, count(*) AS total FROM cut
    WHERE regexp_matches(word, '^\p{{L}}[\p{{L}}.-]*$') GROUP BY word),
  every AS (SELECT sum(stops) / sum(total) AS p FROM counts),
  measured AS (
    SELECT word, stops, total, total - stops AS rest, len(word) - len(replace(word, '.', '')) AS inner_stops,
           CAST(greatest(len(replace(word, '.', '')), 1) AS DOUBLE) AS size, p FROM counts, every WHERE stops > 0),
  scored AS (
    SELECT word, stops, total, CASE WHEN p < 1 THEN -2 * ((stops * ln(p) + rest * ln(1 - p))
             - (stops * ln({sn.NEARLY_ALWAYS}) + rest * ln(1 - {sn.NEARLY_ALWAYS}))) ELSE 0 END
             * exp(-size) * (inner_stops + 1) * pow(size, -rest) AS score FROM measured)"""


@query("word_stop_scores", f"{_WORD_SCORES} SELECT word, stops, total, {I.r6('score')} AS score FROM scored")
def word_stop_scores(spark, sf):
    """How far each word that stands before a stop is an abbreviation."""
    scored = sn.scored_words(sn.word_statistics(I.documents(spark, sf)))
    return scored.select("word", "stops", "total", I.round6(F.col("score")).alias("score"))


@query(
    "learned_sentences",
    rf"""{_WORD_SCORES},
  known AS (SELECT word FROM scored WHERE score >= {sn.LEAST_SCORE} AND stops >= {sn.LEAST_STOPS} ORDER BY score DESC, word LIMIT {sn.MOST}),
  pieces AS (
    SELECT doc_id, pos, sentence, suffix(sentence, '.') AND coalesce(k.word IS NOT NULL, false) AS short
    FROM ({_SENTENCES}) LEFT JOIN known k
      ON k.word = regexp_extract(lower(sentence), '(?:^|[^\p{{L}}\p{{N}}.-])(\p{{L}}[\p{{L}}.-]*)\.$', 1)),
  starts AS (SELECT *, CASE WHEN lag(short, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS first FROM pieces),
  numbered AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM starts)
  SELECT doc_id, CAST(n AS BIGINT) AS pos, string_agg(sentence, ' ' ORDER BY numbered.pos) AS sentence FROM numbered GROUP BY doc_id, n""",
)
def learned_sentences(spark, sf):
    """Sentences that do not end behind the abbreviations of the corpus."""
    docs = I.documents(spark, sf).select("doc_id", "text")
    split = tx.computed(docs, "sentences", sn.split_sentences(F.col("text"), sn.abbreviations(docs)))
    rows = split.select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


@query("clean_text", f"SELECT doc_id, {Q.clean_text(_LINKED)} AS clean FROM documents")
def clean_text(spark, sf):
    return I.documents(spark, sf).select("doc_id", tx.clean_text(linked_text()).alias("clean"))


@query(
    "clean_messages",
    f"""SELECT message_id, channel_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
        FROM (SELECT message_id, channel_id,
                     list_filter({Q.words(Q.clean_text('message'))}, lambda w: w NOT IN ({_STOP_SQL})) AS t
              FROM ({I.DOCUMENT_MESSAGES_SQL}))""",
)
def clean_messages(spark, sf):
    """The default cleaning job: cleaned tokens without stop words."""
    cleaned = tk.clean_messages(I.document_messages(spark, sf), stop_words=STOP_WORDS)
    rows = cleaned.select("message_id", "channel_id", F.posexplode("tokens").alias("pos", "token"))
    return rows.select("message_id", "channel_id", F.col("pos").cast("bigint").alias("pos"), "token")


@query(
    "clean_message_words",
    f"""SELECT message_id, channel_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
        FROM (SELECT message_id, channel_id, {Q.words(Q.clean_text('message'))} AS t
              FROM ({I.DOCUMENT_MESSAGES_SQL}))""",
)
def clean_message_words(spark, sf):
    tokens = tx.clean_words(tx.clean_text(F.col("message")))
    rows = I.document_messages(spark, sf).select(
        "message_id", "channel_id", F.posexplode(tokens).alias("pos", "token")
    )
    return rows.select("message_id", "channel_id", F.col("pos").cast("bigint").alias("pos"), "token")


_HEADER = "'@' || source || ' channel' || chr(10) || text || chr(10) || '@admin_' || lang || ' writes' || chr(10) || 't.me/' || source || '_chan'"


def _header_text():
    return F.concat(
        F.lit("@"), "source", F.lit(" channel\n"), "text", F.lit("\n@admin_"), "lang",
        F.lit(" writes\nt.me/"), "source", F.lit("_chan"),
    )


_LINES = f"""list_filter(list_transform(string_split_regex({_HEADER}, {Q.lit(C.LINE_BREAK)}),
             lambda l: {Q.strip('l')}), lambda l: l <> '')"""


def _header_sql(kept: str) -> str:
    joined = f"array_to_string({kept}, ' ')"
    return f"""SELECT doc_id, {Q.strip(Q.clear_emoji(Q.drop_links('joined')))} AS header
               FROM (SELECT doc_id, {joined} AS joined FROM (SELECT doc_id, {_LINES} AS lines FROM documents))"""


@query("header_first_line", _header_sql("lines[1:1]"))
def header_first_line(spark, sf):
    return I.documents(spark, sf).select("doc_id", tx.header_text(_header_text()).alias("header"))


_MENTION = Q.lit(f"^(?:{C.MENTION_LINE})")


@query(
    "header_text",
    _header_sql(f"list_filter(lines, lambda l, i: i = 1 OR NOT regexp_matches(l, {_MENTION}))"),
)
def header_text(spark, sf):
    header = tx.header_text(_header_text(), C.MENTION_LINE)
    return I.documents(spark, sf).select("doc_id", header.alias("header"))


_HANDLE = f"""coalesce(nullif(regexp_extract(text, {Q.lit(C.HANDLE_IN_TEXT)}, 2), ''),
                       nullif(regexp_extract(text, {Q.lit(C.HANDLE_ALONE)}, 1), ''))"""


@query(
    "normalise_handle",
    f"SELECT request_id, coalesce({_HANDLE}, '') AS handle FROM ({I.HANDLE_REQUESTS_SQL})",
)
def normalise_handle(spark, sf):
    handle = F.coalesce(hd.normalise_handle(F.col("text")), F.lit(""))
    return I.handle_requests(spark, sf).select("request_id", handle.alias("handle"))


@query(
    "truncate_tokens",
    f"""SELECT doc_id, pos, len(k) AS n_tokens, array_to_string(k, ' ') AS kept
        FROM (SELECT doc_id, pos, {Q.words('sentence')}[1:{C.MAX_TOKENS}] AS k FROM ({_SENTENCES}))""",
)
def truncate_tokens(spark, sf):
    """Every sentence of the whole text, cut to the encoder's token limit."""
    rows = I.documents(spark, sf).select(
        "doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "sentence")
    )
    kept = rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), tx.truncate(tx.words(F.col("sentence"))).alias("k"))
    return kept.select("doc_id", "pos", F.size("k").cast("bigint").alias("n_tokens"), F.array_join("k", " ").alias("kept"))


# A small stem dictionary in the languages of the fixture.
STEMS = {
    "ores": "or", "enes": "en", "anes": "an", "hered": "here", "reed": "re", "thing": "th",
    "ering": "er", "aning": "an", "ouen": "ou", "tion": "ti", "reaux": "reau", "leaux": "leau",
    "des": "de", "les": "le", "las": "la", "unes": "un", "ands": "and", "ofs": "of",
}
_STEM_SQL = ", ".join(f"({Q.lit(t)}, {Q.lit(s)})" for t, s in STEMS.items())
_TOKENS_SQL = f"""
  SELECT doc_id AS message_id, {Q.words('lower(text)')} AS tokens FROM documents"""


def _tokens(spark, sf):
    rows = I.documents(spark, sf)
    return tk.message_words(rows.select(F.col("doc_id").alias("message_id"), F.lower("text").alias("message")))


@query(
    "tokens_without_stopwords",
    f"""SELECT message_id, generate_subscripts(k, 1) - 1 AS pos, unnest(k) AS token
        FROM (SELECT message_id, list_filter(tokens, lambda t: t NOT IN ({_STOP_SQL})) AS k FROM ({_TOKENS_SQL}))""",
)
def tokens_without_stopwords(spark, sf):
    out = tk.tokens_without_stop_words(_tokens(spark, sf), STOP_WORDS)
    return out.select("message_id", F.col("pos").cast("bigint").alias("pos"), "token")


@query(
    "normalise_tokens",
    f"""SELECT message_id, pos, token FROM (
          SELECT r.message_id, r.pos, coalesce(m.stem, r.token) AS token
          FROM (SELECT message_id, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS token
                FROM ({_TOKENS_SQL})) r
          LEFT JOIN (SELECT * FROM (VALUES {_STEM_SQL}) v(token, stem)) m ON r.token = m.token)
        WHERE token <> '' AND token NOT IN ({_STOP_SQL})""",
)
def normalise_tokens(spark, sf):
    tokens = _tokens(spark, sf)
    stems = spark.createDataFrame(list(STEMS.items()), "token string, stem string")
    out = tk.normalise_tokens(tokens, stems, STOP_WORDS)
    return out.select("message_id", F.col("pos").cast("bigint").alias("pos"), "token")


_CLEAN = f"""
  SELECT message_id, channel_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
  FROM (SELECT message_id, channel_id, {Q.words(Q.clean_text('message'))} AS t FROM ({I.DOCUMENT_MESSAGES_SQL}))"""


@query(
    "clean_stemmed_messages",
    f"""SELECT message_id, channel_id, pos, token FROM (
          SELECT r.message_id, r.channel_id, r.pos, coalesce(m.stem, r.token) AS token FROM ({_CLEAN}) r
          LEFT JOIN (SELECT * FROM (VALUES {_STEM_SQL}) v(token, stem)) m ON r.token = m.token)
        WHERE token <> '' AND token NOT IN ({_STOP_SQL})""",
)
def clean_stemmed_messages(spark, sf):
    """The whole text path: clean, split, stem, drop stop words."""
    stems = I.configure(spark).createDataFrame(list(STEMS.items()), "token string, stem string")
    out = tk.clean_messages(I.document_messages(spark, sf), stems=stems, stop_words=STOP_WORDS)
    return out.select("message_id", "channel_id", F.col("pos").cast("bigint").alias("pos"), "token")
