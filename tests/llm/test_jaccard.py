import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from affinis.llm import jaccard as J
from affinis.llm.batches import word_of
from affinis.llm.graph import components
from affinis.llm.query_jaccard import op5_jaccard_join


def shingles(text, n=5):
    words = [w for w in map(word_of, (text or "").split()) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def by_force(rows, threshold=Fraction(4, 5)):
    """Class and links of each row, by comparing all pairs."""
    sets = [shingles(text) if key is not None else set() for key, text in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted((key if key is not None else -1, least.get(root(i), -1), links[i]) for i, (key, _) in enumerate(rows))


def found(df):
    none = lambda x: -1 if x is None else x
    return sorted((none(r["doc_id"]), none(r["class_id"]), r["n_links"]) for r in df.collect())


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.99), (0.9, 0.9999)):
        bands, rows = J.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= J.HASHES
    assert J.choose_bands() == (30, 7)
    with pytest.raises(ValueError, match="recall"):
        J.choose_bands(0.02, 0.999)


def test_recall_of_signatures():
    rng = np.random.default_rng(1)
    bands, rows = J.choose_bands()
    missed = 0
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (80, 10, 10))  # 0.8 similar
        sets = [np.unique(np.concatenate([both, x])) for x in (a, b)]
        offsets = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        keys = J.band_hashes(offsets, np.concatenate(sets), bands, rows)
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 3


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    out = []
    for i in range(60):  # near copies of one text, with more or less edits
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = word()
        out.append((1000 - i, " ".join(text)))
    passage = " ".join(word() for _ in range(60))
    out += [(2000 + i, passage + " " + " ".join(word() for _ in range(100))) for i in range(20)]  # share a passage
    out += [(3000 + i, "Same, text!") for i in range(5)] + [(3010, "same text"), (3011, "same text again")]
    out += [(4000, None), (4001, ""), (4002, "... !!"), (None, "Same text"), (None, None)]
    out += [(3000, "Same, text!")]  # a repeated row
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_against_all_pairs(spark, rows, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "CELLS", 1 << 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    assert found(J.similarity_classes(df)) == by_force(rows)


def test_one_per_class(spark, rows):
    extra = [(*row, "x", 1) for row in rows]
    df = spark.createDataFrame(extra, "doc_id long, text string, rep string, class_id int")
    kept = J.one_per_class(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    classes = {key: cls for key, cls, _ in by_force(rows)}
    assert sorted(x for x in ids if x is not None) == sorted({cls for key, cls in classes.items() if key != -1})
    assert ids.count(None) == 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.similarity_classes(df).count() == 0 and J.one_per_class(df).count() == 0


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z")]
    got = found(J.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == [(1, 1, 0), (1, 1, 1), (2, 1, 1)]


def test_links_of_one_id_with_several_texts(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in (10, 60, 110, 160)]
    for ids in ((1, 1, 2, 3), (1, 1, 1, 1), (1, 2, 3, 4)):
        rows = list(zip(ids, texts, strict=True))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(J.similarity_classes(df)) == by_force(rows) == [(i, 1, 3) for i in ids]
        kept = J.one_per_class(df).collect()
        assert [r["doc_id"] for r in kept] == [1] and kept[0]["text"] in texts


def test_one_per_class_keeps_other_texts_of_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    far, near = "u v w x y z", " ".join([*base[:30], "other", *base[31:]])
    rows = [(1, " ".join(base)), (1, far), (1, "U, v w x y z"), (2, far), (3, near), (4, ""), (4, None), (4, "s o l o t e x t")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    kept = J.one_per_class(df.repartition(4)).collect()
    assert sorted(r["n"] for r in kept) == [0, 2, 5, 6, 7]
    classes = found(J.similarity_classes(df.select("doc_id", "text")))
    assert classes == by_force(rows)


def test_long_texts_in_many_families(spark, monkeypatch):
    """Blocks are cut by n-grams too, and the matrix of n-grams is formed a strip at a time."""
    import tracemalloc

    rng = np.random.default_rng(6)
    rows, sets = 0, []
    for _ in range(40):  # families of long texts, all in one component
        both = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
        for _ in range(3):
            sets.append(np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 900).astype(np.uint64)])))
    rows = len(sets)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    grams = np.concatenate(sets)
    monkeypatch.setattr(J, "CELLS", 1 << 16)
    every = np.arange(rows)
    tracemalloc.start()
    p, q = J.similar_pairs(np.zeros((rows, 1), np.int64), offsets, grams, every, every, Fraction(4, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(p.tolist(), q.tolist(), strict=True)) == [(i, j) for i in range(rows) for j in range(i + 1, rows) if i // 3 == j // 3]
    assert peak < 14 * grams.nbytes
    monkeypatch.setattr(J, "BLOCK_GRAMS", 500)
    texts = [(i, " ".join(f"f{i // 4}w{j}" for j in range(300) if j != 17 * (i % 4))) for i in range(24)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert found(J.similarity_classes(df)) == by_force(texts)


def test_sets_do_not_depend_on_the_batch():
    texts = ["a b c d e f g", "", "x", "a b c d e f g " * 3]
    whole, alone = J.shingle_sets(pa.array(texts, pa.large_string()), 5), []
    for text in texts:
        alone.append(J.shingle_sets(pa.array([text], pa.large_string()), 5)[1])
    assert (whole[1] == np.concatenate(alone)).all()
    assert [len(x) for x in alone] == [len(shingles(t)) for t in texts]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 900)] + [(7, 7), (None, 3), (3, 8), (8, 3)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, root(x)) for x in parent)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(op5_jaccard_join(spark, sf)) == by_force(rows)
