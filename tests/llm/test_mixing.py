import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from affinis.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, taken string"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def levels(sizes, weights, share, most):
    """Targets by resharing what is above a limit, round by round."""
    total, out, open_ones = share * sum(sizes.values()), {}, dict(weights)
    while open_ones:
        left, over = total - sum(out.values()), sum(open_ones.values())
        above = {s for s, w in open_ones.items() if left * w / over > most * sizes[s]}
        if not above:
            out |= {s: Fraction(left * w) / over for s, w in open_ones.items()}
            break
        out |= {s: Fraction(most * sizes[s]) for s in above}
        open_ones = {s: w for s, w in open_ones.items() if s not in above}
    return out


def by_force(rows, cycle=(5, 2, 1), share=Fraction(3, 2), most=2):
    groups = defaultdict(list)
    for doc, text, source, _ in rows:
        draw = int(hashlib.md5(f"mix:{'' if doc is None else doc}".encode()).hexdigest()[:15], 16)
        groups[source].append((draw, doc, size(text), text))
    names = sorted(groups, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(x[2] for x in groups[s]) for s in names}
    targets = levels(sizes, {s: cycle[i % len(cycle)] for i, s in enumerate(names)}, share, most)
    out = []
    for s in names:
        budget, before = int(targets[s]), 0
        for _, doc, n, _ in sorted(groups[s], key=lambda x: x[:2]):
            rest = budget % sizes[s] if sizes[s] else 0
            taken = (budget // sizes[s]) * n + max(0, min(n, rest - before)) if sizes[s] else 0
            before += n
            out.append((doc, n, sizes[s], float(targets[s]), taken))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect())


@pytest.fixture(scope="module")
def docs():
    words = lambda n, i: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, words(i * 7 % 23, i), f"s{min(i % 9, 4)}", "x") for i in range(300)]
    rows += [(400, None, "s1", "x"), (401, "", "s2", "x"), (402, " \t\v", None, "x"), (403, "a b\nc d", None, "x")]
    rows += [(404, words(20000, 4), "\U0001f600", "x"), (405, "one", "￿", "x"), (406, None, "nothing", None)]
    return rows


@pytest.mark.parametrize("cycle", [(5, 2, 1), (1,), (1000, 1)])
def test_against_resharing(spark, docs, cycle):
    df = spark.createDataFrame(docs, SCHEMA).repartition(7)
    got = M.mix(df, cycle)
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert rows_of(got) == by_force(docs, cycle)
    assert rows_of(M.mix(df.repartition(3), cycle)) == rows_of(got)  # no matter how the rows lie


def test_other_shares_and_given_weights(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    assert rows_of(M.mix(df, (5, 2, 1), Fraction(7, 3), 4)) == by_force(docs, share=Fraction(7, 3), most=4)
    names = sorted({r[2] for r in docs}, key=lambda s: (s is None, (s or "").encode()))
    given = spark.createDataFrame([(s, [5, 2, 1][i % 3]) for i, s in enumerate(names)], "source string, weight int")
    assert rows_of(M.mix(df, given)) == by_force(docs)


def test_equal_rows_share_alike(spark):
    rows = [(1, "a b c d e", "s", None)] * 7 + [(2, "x " * 30, "t", None)]
    got = rows_of(M.mix(spark.createDataFrame(rows, SCHEMA), (1, 100)))
    words = [r[4] for r in got if r[0] == 1]
    target = next(r[3] for r in got if r[0] == 1)
    assert len(set(words)) == 1 and target - 7 < sum(words) <= target


def test_ids_that_are_null(spark):
    rows = [(None, f"t{i} " * (i + 1), "s", None) for i in range(40)] + [(i, "y " * 100, "t", None) for i in range(9)]
    got = M.mix(spark.createDataFrame(rows, SCHEMA), (1, 3)).collect()
    assert sum(r["taken"] for r in got if r["source"] == "s") == int(next(r["target"] for r in got if r["source"] == "s"))


def test_epochs(spark, docs):
    mixed = M.mix(spark.createDataFrame(docs, SCHEMA), (5, 2, 1)).cache()
    taken = defaultdict(int)
    for r in M.epochs_of(mixed).collect():
        taken[r["doc_id"]] += size(r["text"])
        whole = next(x[1] for x in docs if x[0] == r["doc_id"])
        assert whole.startswith(r["text"]) and r["epoch"] >= 1
    assert dict(taken) == {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]}


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA), (5, 2, 1)).count() == 0
    only = rows_of(M.mix(spark.createDataFrame([(1, None, None, None)], SCHEMA), (5, 2, 1)))
    assert only == [(1, 0, 0, 0.0, 0)]
