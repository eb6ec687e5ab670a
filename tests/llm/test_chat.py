import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from affinis.llm import chat as C
from affinis.llm.query_chat import op6_chat

RECORDS = {
    "prompt_completion": ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    "prompt_response": ({"response": "r", "prompt": "p"}, [("user", "p"), ("assistant", "r")]),
    "instruction": (
        {"instruction": "i", "input": "more", "output": "o", "system": "s"},
        [("system", "s"), ("user", "i\n\nmore"), ("assistant", "o")],
    ),
    "question_answer": ({"question": None, "answer": "a"}, [("user", ""), ("assistant", "a")]),
    "messages": (
        {"messages": [{"role": "user", "content": "x"}, {"content": None, "role": "tool"}]},
        [("user", "x"), ("tool", "")],
    ),
    "speakers": (
        {"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}], "system": "s"},
        [("system", "s"), ("user", "x"), ("assistant", "y")],
    ),
    "nested_messages": ({"turns": [{"author": "bot", "text": 5}]}, [("assistant", "5")]),
}


def turns(spark, records):
    df = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    return [tuple(r) for r in C.canonical_turns(df).orderBy("id", "part").collect()]


def test_layouts(spark):
    got = turns(spark, [json.dumps(r) for r, _ in RECORDS.values()])
    want = [(i, name, j, *turn) for i, (name, (_, found)) in enumerate(RECORDS.items()) for j, turn in enumerate(found)]
    assert got == want


def test_unknown_records(spark):
    odd = [None, "", "no json", "[1]", '{"prompt": "x", "extra": 1}', '{"messages": []}', '{"messages": null}', '"x"', "[" * 5000]
    got = turns(spark, odd)
    assert [g for g in got if g[1]] == []
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 7, 8]  # lists without entries have no turns


def test_fingerprint_is_of_paths():
    same = [{"a": [{"b": 1}, {"c": 2}], "d": {"e": 0}}, {"d": {"e": "x"}, "a": [{"c": 0, "b": []}] * 3}]
    assert len({C.fingerprint(C.paths_of(x)) for x in same}) == 1
    assert C.paths_of(same[0]) == {"a", "a[].b", "a[].c", "d.e"}
    assert C.fingerprint({"a.b"}) != C.fingerprint({"a", "b"})


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, '{"prompt": "x"}', 5, "old")], "id long, record string, Role int, text string")
    out = C.canonical_turns(df)
    assert out.columns == ["id", "layout", "part", "role", "text"] and out.first()["text"] == "x"
    again = C.formatted(out.selectExpr("*", "1 AS segment"))
    assert again.columns.count("segment") == 1 and C.read_segments(again.first()["segment"]) == [("user", "x")]
    assert C.canonical_turns(df.limit(0)).count() == 0


hard = st.lists(
    st.sampled_from([*C.CONTROL, "\\", "<", "[", "s>", "/", "<\\s>", "\\\\", "x", "\n", "é", "$1", "<<", "SYS>>", ""]), max_size=12
).map("".join)


def test_escapes_can_be_read_back(spark):
    texts = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(hard, hard)
    def gather(role, text):
        texts.append((role, text))

    gather()
    texts += [(None, None), ("", ""), ("user", "a" * 100_000)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, role string, text string")
    rows = C.formatted(df, learned="user").orderBy("id").collect()
    whole = "".join(r["segment"] for r in rows)
    assert C.read_segments(whole) == [(a or "", b or "") for a, b in texts]
    for row, (role, text) in zip(rows, texts, strict=True):
        inner = row["segment"][len(C.OPEN + C.ROLE) : -len(C.CLOSE)].replace(C.TEXT, "\0", 1)  # role and text apart
        assert not any(c in inner for c in C.CONTROL)
        assert C.unescaped(row["segment"][row["loss_start"] : row["loss_end"]]) == ((text or "") if role == "user" else "")


def test_one_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(5000)] + [(None, 0, "user", "x"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r["conv_id"]: r for r in C.digests(C.formatted(df), ["turn"]).collect()}
    said = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1)
    assert got[1]["n_turns"] == 5000 and got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[None]["n_turns"] == 1 and got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert C.digests(C.formatted(df.limit(0)), ["turn"]).count() == 0


def test_tricky_conversation(spark, sf):
    row = op6_chat(spark, sf).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"]) == (2, len(text))
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("layout", C.LAYOUTS)
def test_every_layout_is_reachable(layout):
    assert layout in C.MAPPINGS.values()
