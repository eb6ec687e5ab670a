import random

import numpy as np
import pyarrow as pa
import pytest

from affinis.llm import decontaminate as D
from affinis.llm.batches import word_hashes, word_of
from affinis.llm.query_decontaminate import op2_decontamination


def words_of(text):
    return [w for w in map(word_of, (text or "").split()) if w]


def smith_waterman(item, text):
    best, above = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            score = max(0, above[j] + (D.MATCH if a == b else D.MISMATCH), above[j + 1] - D.GAP, row[j] - D.GAP)
            row.append(score)
            best = max(best, score)
        above = row
    return best


def by_force(docs, items):
    out = {}
    for doc, text in docs:
        for item, passage in items:
            words = words_of(passage)
            if item is not None and len(words) >= D.N:
                share = smith_waterman(words, words_of(text)) / (D.MATCH * len(words))
                if share >= D.LEAST:
                    out[doc, item] = max(out.get((doc, item), 0), share)
    return out


def found(df):
    return {(r["doc_id"], x["item_id"]): x["score"] for r in df.collect() for x in r["leaks"]}


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    common = vocabulary[:12]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary)
    some = lambda n: [word() for _ in range(n)]
    items = [(i, some(rng.randint(15, 50))) for i in range(12)]
    docs = []
    for i in range(60):
        text = some(rng.randint(0, 150))
        if i % 3 == 0:
            passage = list(items[i % 12][1])
            for _ in range(rng.randint(0, len(passage) // 5)):  # edits: other, more and fewer words
                at = rng.randrange(len(passage))
                passage[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [word()], [word()]])
            at = rng.randint(0, len(text))
            text[at:at] = passage
        if i % 10 == 0:  # a passage that many texts share
            text += items[5][1]
        docs.append((i, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "..."), (0, docs[0][1]), (103, " ".join(common) * 50)]
    return docs, [(i, " ".join(w).title() + ".") for i, w in items] + [(50, "too short"), (None, "a b c d e f"), (51, None)]


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 60])
def test_against_all_alignments(spark, tables, block):
    docs, items = tables
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, leaks string")
    got = D.with_leaks(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert got.columns == ["doc_id", "text", "leaks"] and got.count() == len(docs)
    want, seen = by_force(docs, items), found(got)
    assert set(seen) == set(want)
    assert all(abs(seen[x] - want[x]) < 1e-9 for x in want)


def edited(words, places):
    return ["other" + str(i) if i in places else w for i, w in enumerate(words)]


@pytest.mark.parametrize("step", [4, 5, 6])
@pytest.mark.parametrize("copies", [0, 1, 3])
def test_edited_copies_beside_exact_ones(spark, step, copies):
    """What a text holds of an item does not depend on what other texts hold of it."""
    item = [f"word{i}" for i in range(38)]
    texts = [edited(item, {*range(0, 38, step), 36}), edited(item, set(range(1, 38, step))), *[item] * copies]
    spread = [x for i in range(0, 38, 4) for x in [*item[i : i + 4], "between", "them"]]  # insertions only
    moved = [*item[:19], *["between"] * 17, *item[19:]]
    docs = [(i, " ".join(["before"] * 7 * i + t + ["after"] * 9)) for i, t in enumerate([*texts, spread, moved])]
    items = [(1, " ".join(item))]
    got = found(D.with_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert len(got) >= copies + 3 and got == by_force(docs, items)


def test_passages_of_long_items(spark):
    item = [f"word{i}" for i in range(1000)]
    short = item[:59]
    runs = {1: item[300:750], 2: item[500:513], 3: item[500:512], 4: edited(item[100:400], set(range(0, 300, 6)))}
    runs |= {5: edited(item[100:400], set(range(2, 300, 3))), 6: short[20:48], 7: item[200:207] + ["x"] + item[207:214]}
    runs |= {8: item[200:208] + ["x"] + item[208:215]}
    docs = [(k, " ".join(["before"] * 5 + words + ["after"] * 5)) for k, words in runs.items()]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    got = {(r["doc_id"], x["item_id"]): x for r in D.with_leaks(docs, items).collect() for x in r["leaks"]}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (6, 1), (6, 2), (8, 1)}
    assert [tuple(got[1, 1])[1:], tuple(got[2, 1])[1:], tuple(got[6, 2])[1:]] == [(0.45, 5, 455), (0.013, 5, 18), (28 / 59, 5, 33)]


def test_few_meetings_at_a_time(spark, tables, monkeypatch):
    docs, items = tables
    texts = pa.array([text or "" for _, text in docs], pa.large_string())
    ids = [(i, w) for i, w in ((i, words_of(x)) for i, x in items if i is not None) if len(w) >= D.N]
    offsets, hashes = word_hashes(pa.array([" ".join(w) for _, w in ids], pa.large_string()))
    block = D.ItemBlock(np.array([i for i, _ in ids]), offsets, hashes)
    seeds = D.Seeds(block, D.N)
    want = D._leaks_of(texts, block, seeds, D.N, D.LEAST)
    monkeypatch.setattr(D, "MEETINGS", 3)
    assert any(want) and D._leaks_of(texts, block, seeds, D.N, D.LEAST) == want


def test_spans(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two alpha beta gamma delta epsilon zeta three")], "doc_id long, text string")
    leak = D.with_leaks(docs, items).first()["leaks"][0]
    assert (leak["start"], leak["end"], leak["score"]) == (2, 8, 1.0)


def test_every_copy_of_a_common_passage(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(i, f"{i} x {passage} y {i}") for i in range(500)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (1, passage), (2, passage)], "item_id long, text string")
    assert len(found(D.with_leaks(docs, items))) == 1000


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.with_leaks(docs, none).first()["leaks"] == []
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert D.with_leaks(docs.limit(0), items).count() == 0


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [d for d in docs if len(words_of(d[1])) < 400]
    want = by_force(docs, items)
    kept = {d for d, _ in docs}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in op2_decontamination(spark, sf).collect() if r["doc_id"] in kept}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in got)
