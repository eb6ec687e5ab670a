import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinis.functions import text as tx
from affinis.operators import audience, heavy, tfidf, wordvec
from affinis.plans import vectors as pv
from affinis.queries import all_queries


def test_eligibility_and_sampling(spark):
    long = "one two three four five six seven."
    rows = [(1, i, f"{long} {long} short.") for i in range(20)]  # 40 sentences
    rows += [(2, i, f"{long} {long} {long}") for i in range(200)]  # 600 sentences
    rows += [(3, i, "too short. again.") for i in range(30)]
    rows += [(4, i, f"{long} {long} {long}") for i in range(19)]  # 57 sentences, 19 messages
    df = spark.createDataFrame(rows, "group_id bigint, item_id bigint, text string").repartition(6)
    valid = pv.valid_sentences(df, 7)
    stats = {r.group_id: (r.n_messages, r.n_sentences) for r in pv.group_statistics(valid).collect()}
    assert stats == {1: (20, 40), 2: (200, 600), 3: (0, 0), 4: (19, 57)}
    sampled = pv.sample_sentences(valid, pv.CHANNELS)
    sizes = {r.group_id: r["count"] for r in sampled.groupBy("group_id").count().collect()}
    assert sizes == {1: 40, 2: 500, 4: 57}
    assert sampled.select("group_id", "item_id", "pos").distinct().count() == 597
    got = {r.group_id: r.embedding for r in pv.group_vectors(df).collect()}
    assert set(got) == {2}
    assert np.linalg.norm(got[2]) == pytest.approx(1.0)  # equal sentences, so their mean is unit
    messages = df.select(F.col("group_id").alias("channel_id"), F.col("item_id").alias("message_id"), F.col("text").alias("message"))
    assert tuple(pv.rejected(messages).first()) == (3, 4)
    assert pv.channel_embeddings(messages, replace(pv.CHANNELS, min_messages=1), num_channels=2).count() == 1


def test_descriptions(spark):
    rows = [(1, "Rhino ate a book"), (2, ""), (3, "https://t.me/some_channel"), (4, "   "), (5, "😀"), (6, "x. 😀")]
    df = spark.createDataFrame(rows, "request_id bigint, text string")
    got = {r.request_id: r.embedding for r in pv.description_vectors(df).collect()}
    assert set(got) == {1, 6}
    assert np.linalg.norm(got[1]) == pytest.approx(1.0)
    assert np.linalg.norm(got[6]) == pytest.approx(0.5)  # the blank second sentence counts


def test_model_hook_sees_batches_of_cut_texts(spark):
    def make():
        def predict(texts):
            return np.array([[len(t.split()), len(texts) <= 16] for t in texts], dtype=np.float32)

        return predict

    df = spark.createDataFrame([(" ".join(["w"] * n),) for n in (3, 64, 90)], "sentence string")
    rows = pv.model_encoder(make, batch_size=16)(df).collect()
    assert [tuple(r.vec) for r in rows] == [(3, 1), (64, 1), (64, 1)]


def test_word_vectors_are_a_mean_of_means(spark):
    vec = {"aaaa": [1.0, 0.0], "bbbb": [0.0, 1.0], "cccc": [1.0, 1.0]}
    words = spark.createDataFrame(list(vec.items()), "token string, vector array<double>")
    texts = [(1, 1, "aaaa aaaa bbbb zzzz"), (1, 2, "cccc zzzz zzzz zzzz"), (1, 3, "zzzz zzzz zzzz yyyy"),
             (1, 4, "aaaa bbbb cccc"), (2, 5, "zzzz yyyy xxxx wwww")]
    df = spark.createDataFrame(texts, "channel_id bigint, message_id bigint, message string")
    tokens = wordvec.message_tokens(df)
    assert tokens.count() == 4  # three words are not enough
    got = {r.channel_id: r.embedding for r in wordvec.channel_means(tokens, words).collect()}
    want = np.mean([np.mean([vec["aaaa"], vec["aaaa"], vec["bbbb"]], axis=0), vec["cccc"]], axis=0)
    assert set(got) == {1} and got[1] == pytest.approx(list(want))
    per_message = {r.message_id: r.embedding for r in wordvec.message_means(tokens, words).collect()}
    assert set(per_message) == {1, 2} and per_message[2] == [1.0, 1.0]


def test_rows_of_one_message_id_are_messages_of_their_own(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vector array<double>")
    rows = [(1, 7, ["a", "a"]), (1, 7, ["b"]), (1, 8, ["a"])]
    tokens = spark.createDataFrame(rows, "channel_id bigint, message_id bigint, tokens array<string>")
    assert wordvec.channel_means(tokens, words).first().embedding == pytest.approx([2 / 3, 1 / 3])
    assert wordvec.message_means(tokens, words).count() == 3


def test_word_vectors_meet_a_word_once_a_block(spark):
    """A word of many messages is looked up once per block of messages, not once per message (F15)."""
    rng = random.Random(5)
    known = {w: [rng.random(), rng.random()] for w in "ab ba c d e".split()}
    rows = [(i % 3 or None, i, [rng.choice(["ab", "ba", "c", "d", "e", "x", None]) for _ in range(i % 7)]) for i in range(200)]
    rows += [(1, 200, ["ab"] * 50 + ["c"]), (2, 201, None), (9, 202, ["x", "x"])]  # longer than a block; none; none known
    tokens = spark.createDataFrame(rows, "channel_id bigint, message_id bigint, tokens array<string>").repartition(2)
    words = spark.createDataFrame(list(known.items()), "token string, vector array<double>")
    blocks = wordvec.word_blocks(tokens, block_words=40)
    sizes = blocks.where("ids is not null").groupBy("block").agg(
        F.sum(F.aggregate("counts", F.lit(0), lambda a, b: a + b)).alias("words"), F.count("*").alias("messages")
    ).collect()
    assert len(sizes) > 4 and sum(r.messages for r in sizes) == len(rows)
    assert all((r.words or 0) <= 40 or r.messages == 1 for r in sizes)
    listed = wordvec.block_tokens(blocks).select("block", F.explode("tokens").alias("token"))
    assert listed.count() == listed.distinct().count() <= 6 * len(sizes)
    parts = {}
    for channel, _, found in rows:
        if vectors := [known[w] for w in found or [] if w in known]:
            parts.setdefault(channel, []).append(np.mean(vectors, axis=0))
    for some in (blocks, None):
        got = {r.channel_id: r.embedding for r in wordvec.channel_means(tokens, words, some).collect()}
        assert got.keys() == parts.keys() == {None, 1, 2}
        assert all(got[c] == pytest.approx(list(np.mean(parts[c], axis=0))) for c in parts)
    weights = wordvec.word_weights(tokens, words).groupBy("channel_id").agg(F.sum("weight").alias("n")).collect()
    assert {r.channel_id: round(r.n, 9) for r in weights} == {c: len(v) for c, v in parts.items()}


def test_words_of_messages_are_those_of_the_cleaned_text(spark):
    texts = ["Don't STOP me now, http://x.y/z now", "a\u3000b\x1c c\n\nd - e", "<b>one</b> two @three four five six", "  ...  ", "",
             None, "Ёж и ЁЛКА \u0130stanbul \u212a \u1c80 -- ok\x00 so", "no more"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "channel_id bigint, message_id bigint, message string")
    want = df.select("message_id", tx.clean_words(tx.clean_text(F.col("message"))).alias("tokens")).where(F.size("tokens") > 3)
    got = wordvec.message_tokens(df).select("message_id", "tokens")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4


def test_tfidf_against_its_formula(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("alpha Beta gamma delta x eps".split()) for _ in range(12))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    terms = tfidf.document_terms(df)
    model = tfidf.fit(terms, min_df=5, max_features=12)
    got = {(r.doc_id, r.term): r.weight for r in model.long_form(model.vectors(terms)).collect()}
    counts = {}
    for i, text in docs:
        w = [t for t in text.lower().split() if len(t) > 1]
        counts[i] = Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:]))
    total, df_of = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df_of.update(c.keys())
    vocab = sorted((t for t in total if df_of[t] >= 5), key=lambda t: (-total[t], t))[:12]
    idf = {t: math.log((1 + len(docs)) / (1 + df_of[t])) + 1 for t in vocab}
    want = {}
    for i, c in counts.items():
        w = {t: c[t] * idf[t] for t in vocab if c[t]}
        n = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, t): x / n for t, x in w.items()})
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert tfidf.fit(terms, min_df=10**6).terms == []
    assert model.vectors(spark.createDataFrame([(1, [])], "doc_id bigint, terms array<string>")).first().idx == []


def test_tfidf_of_words_and_of_terms(spark):
    """N-grams are formed as numbers: the same model as from a table of terms, also where all terms are counted."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(i % 9))) for i in range(60)]
    docs += [(60, None), (61, ""), (7, "beta beta gamma")]  # an id may come twice
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    words = tfidf.document_words(df)
    for sizes in ({}, {"candidates": 1, "summary": 1}):
        a = tfidf.TfIdf(words, 2, 12, **sizes)
        b = tfidf.TfIdf(tfidf.terms_of_words(words), 2, 12, **sizes)
        assert (a.terms, a.idf, a.size) == (b.terms, b.idf, b.size) and a.exact == b.exact == (not sizes)
        rows = [sorted((r.doc_id, tuple(r.idx), tuple(r.val)) for r in m.fitted_vectors().collect()) for m in (a, b)]
        assert rows[0] == rows[1]
        again = {(r.doc_id, r.term): round(r.weight, 9) for r in a.long_form(a.vectors(words)).where("doc_id <> 7").collect()}
        assert again == {(r.doc_id, r.term): round(r.weight, 9) for r in a.long_form(a.fitted_vectors()).where("doc_id <> 7").collect()}


def test_terms_of_arrays_as_numbers():
    lists = pa.array([["b", "a", "b"], None, [], ["a"], ["b", None, "a", "b"]])
    got = [(r.tolist(), [items[int(c)].as_py() for c in codes]) for r, codes, items in heavy.coded(lists.slice(0), 3)]
    assert got == [
        ([0, 0, 0, 3, 4, 4, 4], ["b", "a", "b", "a", "b", "a", "b"]),
        ([0, 0, 4, 4], ["b a", "a b", "b a", "a b"]),
        ([0, 4], ["b a b", "b a b"]),
    ]


def test_audience_overlap_with_hot_users_and_channels(spark):
    rng = random.Random(1)
    visits = {(c, 0) for c in range(40)} | {(0, u) for u in range(200)}
    visits |= {(rng.randrange(40), rng.randrange(200)) for _ in range(500)}
    rows = list(visits) + list(visits)[:100]
    df = spark.createDataFrame(rows, "channel bigint, user bigint")
    want = {}
    by_user = {}
    for c, u in visits:
        by_user.setdefault(u, set()).add(c)
    for cs in by_user.values():
        for a in cs:
            for b in cs:
                if a < b:
                    want[(a, b)] = want.get((a, b), 0) + 1
    small = {"rows_per_bucket": 50, "users_per_cell": 20, "channels_per_panel": 7}
    for sizes in ({}, {"few_channels": 6, **small}, {"few_channels": 0}, small):
        got = {(r.channel_a, r.channel_b): r.common for r in audience.audience_overlap(df, **sizes).collect()}
        assert got == want
    assert audience.audience_overlap(df, min_common=3).count() == sum(v >= 3 for v in want.values())


def test_audience_counts_are_added_up_in_small_tasks(spark, monkeypatch):
    visits = spark.createDataFrame([(c, u) for u in range(40) for c in range(u % 7, 7)], "channel long, user long")
    monkeypatch.setattr(audience, "PAIRS_PER_TASK", 8)
    out = audience.audience_overlap(visits)
    pairs = [(a, b) for u in range(40) for a in range(u % 7, 7) for b in range(a + 1, 7)]
    assert out.rdd.getNumPartitions() == -(-len(pairs) // 8)
    assert {(r.channel_a, r.channel_b): r.common for r in out.collect()} == {p: pairs.count(p) for p in pairs}


def test_terms_where_tasks_have_no_rows(spark):
    """A split of a large file may hold no row group: its task has no rows, and its summary is empty (F1 to F6)."""
    docs = [(1, "alpha beta alpha"), (2, "beta gamma"), (3, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    empty = df.where("doc_id < 0")
    words = tfidf.document_words(empty.unionByName(df.coalesce(1)))  # tasks with rows and tasks without
    model = tfidf.TfIdf(words, 1, 3)
    assert (model.terms, model.size, model.exact) == (["alpha", "alpha beta", "beta"], 3, True)
    assert {r.doc_id: r.idx for r in model.fitted_vectors().collect()} == {1: [0, 1, 2], 2: [2], 3: []}
    none = tfidf.TfIdf(tfidf.document_words(empty), 1, 3)
    assert (none.terms, none.size, none.fitted_vectors().count()) == ([], 0, 0)


def test_summary_of_nothing():
    summary = heavy.Summary(3)
    summary.cut()
    assert (summary.counts.num_rows, summary.error) == (0, 0)
    summary.add(pa.array(["a"], pa.large_string()), np.array([2]))
    summary.cut()
    assert summary.counts.to_pylist() == [{"item": "a", "count": 2}]


@pytest.mark.parametrize("name,rows", [
    ("roundtrip_sparse", [(i, t, 0.57735) for i in range(6) for t in ("alpha", "alpha beta", "beta")]),
    ("tfidf_channel_vectors", [(c, t, 0.57735) for c in (1, 2) for t in ("alpha", "alpha beta", "beta")]),
    ("tfidf_similar_channels", [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]),
    ("tfidf_similar_docs", [(i, r + 1, j, 1.0) for i in range(6) for r, j in enumerate(j for j in range(6) if j != i)]),
    ("tfidf_similar_pairs", [(i, j, 1.0) for i in range(6) for j in range(6) if i != j]),
])
def test_queries_over_splits_without_rows(spark, tmp_path, name, rows):
    """A split of a written table that holds no row group is a task without rows (F1 to F5)."""
    docs = [(i, "alpha beta", "en", f"src{1 + i % 2}", 10) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    small = {"spark.sql.files.maxPartitionBytes": "800b", "spark.sql.files.openCostInBytes": "1b"}
    before = {key: spark.conf.get(key) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        got = all_queries()[name](spark, str(tmp_path)).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in got) == rows
