import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from affinis.llm import crosstoken as C
from affinis.llm.query_crosstoken import op12_crosstoken, public_vocabularies

TEXTS = [
    "The quick brown fox, 12345 and 67890!",
    "naïve café — déjà vu \U0001f600\U0001f469‍\U0001f52c 漢字かな",
    "<|endoftext|> <s> </s> <0x41> [INST]",
    "   spaces \t tabs\r\n\r\nlines   ",
    "a ▁ mark of the model",
    " ",
    "\x00\x01 control",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "The quick brown fox, 12345 and 67890!",
    "",
    None,
    "word " * 30000,
    "x",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def visible():
    from tokenizers.pre_tokenizers import ByteLevel

    out = {}
    for x in range(256):  # what the library writes for the bytes of a character, one byte at a time
        if x < 128:
            out[ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(x))[0][0]] = x
    for x in range(0x80, 0x800):
        written = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(x))[0][0]
        out |= dict(zip(written, chr(x).encode(), strict=True))
    for x in [0x800, *range(0x1000, 0xD000, 0x1000), 0xD000, 0xE000, 0xF000, 0x10000, 0x50000, 0x90000, 0xD0000, 0x10FFFF]:
        written = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(x))[0][0]
        out |= dict(zip(written, chr(x).encode(), strict=True))
    return out


def tokens(libraries, text):
    a, b = libraries
    if not text:
        return [], []
    table = visible()
    found_a = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    found_b = [
        (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
        for i in b.encode(text)
    ]
    said = (" " + text).encode()
    if b"".join(x for _, x in found_a) != said or b"".join(x for _, x in found_b) != said:
        return [], []
    return found_a, found_b


def spans(found):
    out, at = [], 0
    for i, said in found:
        out.append((i, at, at + len(said)))
        at += len(said)
    return out


def links_of(a, b):
    """Both tilings walked at once."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((i, j, min(a[i][2], b[j][2]) - max(a[i][1], b[j][1])))
        step_a, step_b = a[i][2] <= b[j][2], b[j][2] <= a[i][2]
        i, j = i + step_a, j + step_b
    return out


def groups_of(a, b):
    both = {x[2] for x in a} & {x[2] for x in b}
    ends = sorted(both)
    out = [([], []) for _ in ends]
    for side, found in enumerate((a, b)):
        g = 0
        for i, _, end in found:
            out[g][side].append(i)
            g += end in both
    return out


def by_force(libraries, rows):
    per, counts = [], Counter()
    for doc, text in rows:
        a, b = map(spans, tokens(libraries, text))
        links = [(a[i][0], b[j][0]) for i, j, _ in links_of(a, b)]
        counts.update(links)
        per.append((doc, a, b, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for doc, a, b, links in per:
        groups = groups_of(a, b)
        said = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if a else ""
        tops = sum(counts[x] == best[x[1]] for x in links)
        shared = sum(len(x) * len(y) for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), shared, tops, sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def rows_of(df):
    names = "doc_id n_a n_b n_groups n_links n_shared n_best count_sum groups_sha256".split()
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


@pytest.mark.parametrize("size", [C.SLICE_BYTES, 60])
def test_against_force(spark, libraries, size, monkeypatch):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(3, "a row that repeats its id"), (None, "no id")]
    monkeypatch.setattr(C, "SLICE_BYTES", size)  # also a slice per text or so
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_a int").repartition(4)
    assert rows_of(C.alignment_counts(df, public_vocabularies())) == by_force(libraries, rows)


@pytest.mark.parametrize("step", [10, 1 << 20])
def test_chunks_change_nothing(libraries, step, monkeypatch):
    monkeypatch.setattr(C, "STEP_BYTES", step)
    tokenizers = C.Tokenizers(public_vocabularies())
    assert tokenizers.cuts
    texts = pa.array([x or "" for x in TEXTS], pa.large_string())
    found = C._sliced_up(tokenizers, texts, 0)
    tokenizers.cuts = False
    whole = C._sliced_up(tokenizers, texts, 0)
    for name in (*C._COUNTS, "groups_sha256", "a", "b", "links"):
        assert np.array_equal(found[name], whole[name]), name


ODD_SPACES = [" ", "  ", "\t ", " \t", "\n \n", "\u00a0 ", " \u3000", "\x1c ", "a\x1c b", "\x85 x", " x", "x ", "!\u2009 !", "a\u200b b"]


def test_odd_spaces_in_words(libraries):
    """Cut texts have the tokens of whole ones, whatever stands beside the spaces."""
    tokenizers = C.Tokenizers(public_vocabularies())
    texts = [f"{a}{space}{b}" for space in ODD_SPACES for a in ("word", "don't", "3.", "é", "") for b in ("next 'll", "7 7", "…", "")]
    texts = [x for x in texts if x]
    bounds, codes, distinct = C.chunks(pa.array(texts, pa.large_string()), True)
    ids = tokenizers.encode(distinct)
    for i, text in enumerate(texts):
        mine = [[x for c in codes[bounds[i] : bounds[i + 1]] for x in flat[at[c] : at[c + 1]]] for flat, at in ids]
        assert mine == [list(x) for x in (libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text))], text


def test_query(spark, libraries, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op12_crosstoken(spark, sf)) == by_force(libraries, rows)


def test_aligned(spark, libraries):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in C.aligned(df, public_vocabularies()).collect():
        a, b = map(spans, tokens(libraries, TEXTS[r["doc_id"]]))
        assert (r["a_ids"], r["a_ends"]) == ([x[0] for x in a], [x[2] for x in a])
        assert (r["b_ids"], r["b_ends"]) == ([x[0] for x in b], [x[2] for x in b])
        assert list(zip(r["link_a"], r["link_b"], r["link_bytes"], strict=True)) == links_of(a, b)
        groups = groups_of(a, b)
        for side, ids, place in ((0, r["a_ids"], r["a_groups"]), (1, r["b_ids"], r["b_groups"])):
            assert [[i for i, g in zip(ids, place, strict=True) if g == n] for n in range(len(groups))] == [g[side] for g in groups]


def test_products():
    rng = np.random.default_rng(3)
    for cells in (1, 7, 1 << 20):
        x, y = rng.random((30, 20)) < 0.2, rng.random((20, 25)) < 0.2
        as_csr = lambda m: C.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])
        dense = np.zeros((30, 25), int)
        for rows, columns, values in C.product(as_csr(x), as_csr(y), cells):
            dense[rows, columns] += values
        assert (dense == x.astype(int) @ y.astype(int)).all()
        turned = C.transposed(as_csr(x))
        assert np.array_equal(turned.columns, np.nonzero(x.T)[1])
    a, b = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 1, 1, 2])
    side = lambda g: C.Csr(np.arange(len(g) + 1), g, 3)
    found = [(i, j) for rows, columns, _ in C.shared_group_links(side(a), side(b), 2) for i, j in zip(rows, columns, strict=True)]
    assert found == [(i, j) for i in range(6) for j in range(4) if a[i] == b[j]]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert C.alignment_counts(df, public_vocabularies()).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(C.alignment_counts(df, public_vocabularies())) == [(1, 0, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, 0, "")]
    assert C.aligned(df, public_vocabularies()).count() == 2
