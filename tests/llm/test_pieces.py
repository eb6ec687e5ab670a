import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from affinis.llm import pieces as P
from affinis.llm.query_pieces import op1_sentencepiece

MODEL = P.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
TRICKY = [
    "", " ", "  ", "a", " a", "a ", "▁", "▁a", "a▁b", "a ▁ b", "<s>hi</s>", "<0x0A>", "\n\n", "\r\n a", "x" * 300,
    "日本" * 50, "�", "é é", "👩‍👩‍👧 \x00 end", "1234 56,7 8", "a b　c", "tab\tnew\n line ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def encoded(model, texts):
    offsets, ids, begins, ends = model.encode(pa.array(texts, pa.large_string()))
    return [
        (ids[a:b].tolist(), begins[a:b].tolist(), ends[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)
    ]


def check(model, library, texts):
    got = encoded(model, texts)
    want = library.encode(texts, num_threads=1)
    assert [g[0] for g in got] == want
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in want])]).astype(np.int64)
    flat = np.array([i for w in want for i in w], np.int64)
    assert model.decode(offsets, flat) == [library.decode(w) for w in want]
    for text, (ids, begins, ends) in zip(texts, got, strict=True):
        assert len(ids) == len(begins) == len(ends)
        if ids:  # the spans cover the source without a gap
            assert begins[0] == 0 and ends[-1] == len(text.encode()) and begins[1:] == ends[:-1]


def test_same_as_library(library):
    check(P.Pieces(MODEL), library, TRICKY)


def test_own_merges(library):
    model = P.Pieces(MODEL)
    model.library, model.plain = None, False
    check(model, library, TRICKY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_text(texts):
    check(P._pieces(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL), texts)


def test_spans_are_the_sources_of_pieces():
    text = "Ünï  code\nand ▁ marks 日本"
    data = text.encode()
    model = P._pieces(MODEL)
    ids, begins, ends = encoded(model, [text])[0]
    for i, b, e in list(zip(ids, begins, ends, strict=True))[1:]:
        surface = model.surface[model.start[i] : model.start[i] + model.length[i]].tobytes()
        assert data[b:e].replace("▁".encode(), b" ") == surface


def test_any_ids(library):
    rng = random.Random(5)
    model = P._pieces(MODEL)
    for _ in range(1000):
        ids = [rng.choice([rng.randrange(32000), rng.randint(3, 258), 29871, 0, 1, 2]) for _ in range(rng.randint(1, 12))]
        assert model.decode(np.array([0, len(ids)]), np.array(ids)) == [library.decode(ids)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_character_maps(rule):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(normalizer.serialized_normalizer_spec())
    model = P.Pieces(MODEL)
    model.map, model.dummy = P.CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix
    model.squeeze, model.space = spec.remove_extra_whitespaces, P.MARK if spec.escape_whitespaces else " "
    for text in [*TRICKY, "ﬁ ① Ａ　Ｂ  c", "ｶﾞ", " ﷺ x", "İ ẞ ǅ"]:
        got, source = model.normalise(text)
        assert got == normalizer.normalize(text)
        assert len(source) == len(got.encode()) + 1 and source == sorted(source)


def test_longest_key_and_alignment():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(normalizer.serialized_normalizer_spec())
    model = P.Pieces(MODEL)
    model.map, model.squeeze, model.library, model.plain = P.CharacterMap(spec.precompiled_charsmap), True, None, False
    ids, begins, ends = encoded(model, ["ﬁne ①"])[0]
    assert begins[0] == 0 and ends[-1] == len("ﬁne ①".encode())
    assert model.map.longest("ｶﾞ".encode(), 0) == (6, "ガ".encode())  # not the first three bytes alone


def test_frames(spark, library):
    rows = [(1, "a b", 7), (2, None, 8), (3, "", 9), (1, "a b", 7), (4, "long " * 50_000, 0), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")  # a column named like a result
    out = P.encode(df, MODEL, decoded="back")
    assert out.columns == ["doc_id", "text", "ids", "begins", "ends", "back"]
    got = out.collect()
    assert len(got) == len(rows)
    for row in got:
        assert row["ids"] == library.encode(row["text"] or "") and row["back"] == library.decode(row["ids"])
    again = P.decode(out.select("doc_id", "ids", "decoded" if "decoded" in out.columns else "back"), MODEL, out="again")
    assert [r["again"] for r in again.collect()] == [r["back"] for r in got]
    assert P.encode(df.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        P.encode(df, MODEL, decoded="text")


def test_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert row["spanned_bytes"] == len(texts[row["doc_id"]].encode())
