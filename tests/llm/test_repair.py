import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from affinis.llm import repair as R
from affinis.llm.query_repair import NOTHING, damaged, op13_repair, repaired

SCHEMA = "conv_id long, turn long, role string, text string, cost int"
WS = " \t\n\v\f\r"


def cheapest(rows):
    """By force: the least ``(cost, edits)`` over all edits; ``rows`` are (initial, fault)."""

    @lru_cache(None)
    def best(i, state, inserted):
        out = []
        follows, initial = (3, "a") if state == 2 else (2, "u")
        if inserted < 2:  # more empty turns in a row than two never pay
            cost, said = best(i, follows, inserted + 1)
            out.append((3 + cost, "I" + said))
        if i == len(rows):
            out += [(0, "")] if state in (0, 3) else []
        else:
            first, fault = rows[i]
            cost, said = best(i + 1, state, 0)
            out.append((4 + cost, "D" + said))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                cost, said = best(i + 1, follows, 0)
                out.append((3 + extra + cost, "R" + said))
                if first == initial:
                    out.append((extra + cost, "K" + said))
                if first == "s" and state == 0:
                    cost, said = best(i + 1, 1, 0)
                    out.append((extra + cost, "K" + said))
        return min(out, default=(10**9, ""))

    return best(0, 0, 0)


def by_force(original, broken):
    groups = {r[0]: [] for r in original}
    for r in broken:
        groups[r[0]].append(r)
    out = []
    for conv, rows in groups.items():
        rows = [(t, " " if a is None else a, " " if b is None else b) for _, t, a, b in rows]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, role, text in rows:
            kept = text.strip(WS)
            faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "none")
            seen.add((role, text))
        line = [role[:1] for _, role, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(line, line[1:]))
        cost, audit = cheapest(tuple(zip(line, faults)))
        odd = (len(audit) - audit.count("D")) % 2
        said, todo, place = [], iter(rows), 0
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(todo)
            if edit != "D":
                said.append(f"{role if edit == 'K' else ['user', 'assistant'][(place + odd) % 2]}:{text}")
                place += 1
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def damaged_by_force(rows):
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot:
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            yield from [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)


def rows_of(df):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


def test_auction_against_force():
    draw = random.Random(5)
    for _ in range(400):
        codes = "".join(draw.choices(R.CODES, [4, 9, 9, 1, 1, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1], k=draw.randrange(1, 12)))
        rows = tuple((R._ROLES[R.CODES.index(c) % 4], R.FAULTS[R.CODES.index(c) // 4]) for c in codes)
        audit, todo, cost, state = R.edits_from(codes, True, R.END, [R.START])[0]
        assert (cost, audit) == cheapest(rows), codes
        assert len(todo) == len(codes) and "".join(x[::2] for x in todo) == audit and state in R.ACCEPTED
        written = "".join(y for x in todo for y in x[1::2] if y != "-")
        assert re.fullmatch("(s?(ua)+)?", written)


@pytest.mark.parametrize("window", [1, 3, 32])
def test_windows_and_prices(window, monkeypatch):
    monkeypatch.setattr(R, "WINDOW", window)
    draw = random.Random(6)
    for _ in range(60):
        codes = "".join(draw.choices(R.CODES, k=draw.randrange(1, 40)))
        rows = tuple((R._ROLES[R.CODES.index(c) % 4], R.FAULTS[R.CODES.index(c) // 4]) for c in codes)
        audit, _, cost, _ = R.edits_from(codes, True, R.END, [R.START])[0]
        assert (cost, audit) == cheapest(rows)
    lattice = R.Lattice("bcbfcbjco", True, R.END)
    assert all(lattice.auction((0, q)) is not None for q in range(4))
    for node, arcs in lattice.arcs.items():  # prices that no arc undercuts
        assert all(lattice.prices[node] <= cost + lattice.prices[end] for _, _, cost, end in arcs)


def conversations(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(longest)):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "Unknown"])
            text = draw.choice(["Yes.", "No!", "so", " \t", "Why? ", "…", f"text {draw.random()}.", "a.\n", "x " * 50])
            rows.append((conv, turn * draw.choice([1, 1, 1, 2]) + conv, role, text))
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.fixture(scope="module")
def odd():
    rows = conversations(7, 80, 14)
    rows += [(90, None, "user", "first."), (90, 5, None, "x."), (90, 7, "assistant", None), (None, 1, "user", "Hm."), (None, 2, "assistant", "Ok.")]
    rows += [(91, 3, "user", "Twice."), (91, 3, "user", "Twice."), (91, 4, "assistant", "Ok."), (92, None, "user", None), (93, 1, "user", "")]
    return rows


def test_against_force(spark, odd):
    df = spark.createDataFrame([(*r, 1) for r in odd], SCHEMA).repartition(6)
    assert rows_of(repaired(df, df)) == by_force(odd, odd)
    assert rows_of(repaired(df, damaged(df))) == by_force(odd, list(damaged_by_force(odd)))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(op13_repair(spark, sf))
    assert got == by_force(rows, list(damaged_by_force(rows)))
    assert any("I" in r[7] for r in got) and any("R" in r[7] for r in got) and any("D" in r[7] for r in got)


def test_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 2)  # pieces of up to four rows
    rows = conversations(8, 6, 90)
    rows += [(50, i, "user", "The same.") for i in range(40)] + [(51, 1, "assistant", "Equal rows.")] * 30
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(5)
    assert rows_of(repaired(df, df)) == by_force(rows, rows)
    placed = R.placed(df)
    cut = R.pieces(placed)
    assert cut.agg({"number": "max"}).first()[0] > 9
    turns = R.repaired_turns(placed, R.edits(cut)).collect()
    for conv, *_, digest in by_force(rows, rows):
        said = [f"{r['role']}:{r['text']}" for r in sorted(turns, key=lambda r: (r["at"], r["part"])) if r["conv"] == conv]
        assert hashlib.sha256("\n".join(said).encode()).hexdigest() == digest


def test_very_long_conversation(spark):
    rng = np.random.default_rng(9)
    n = 60_000
    faults = rng.choice(4, n, p=[0.85, 0.1, 0.03, 0.02])
    roles = np.where(rng.random(n) < 0.9, np.arange(n) % 2 + 1, rng.integers(0, 4, n))
    codes = "".join(R.CODES[4 * f + r] for f, r in zip(faults, roles, strict=True))
    audit, todo, cost, _ = R.edits_from(codes, True, R.END, [R.START])[0]
    assert len(todo) == n and re.fullmatch("(s?(ua)+)?", "".join(y for x in todo for y in x[1::2] if y != "-"))
    exact = [0, 10**9, 10**9, 10**9]  # the usual recurrence, layer by layer
    for code in codes:
        i = R.CODES.index(code)
        for q in (2, 3, 2):
            exact[q] = min(exact[q], 3 + min(exact[x] for x in ((2,) if q == 3 else (0, 1, 3))))
        new = [x + 4 for x in exact]
        if i < 8:
            extra = 3 * (i >= 4)
            role = R._ROLES[i % 4]
            for q in range(4):
                to = 3 if q == 2 else 2
                new[to] = min(new[to], exact[q] + extra + (0 if role == "ua"[to - 2] else 3))
            if role == "s":
                new[1] = min(new[1], exact[0] + extra)
        exact = new
    assert cost == min(exact[0], exact[3], exact[2] + 3, exact[1] + 6)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repaired(none, none).count() == 0
    one = spark.createDataFrame([(1, 1, "user", "x.", 0)], SCHEMA)
    assert rows_of(repaired(one, none)) == [(1, 0, 0, 0, 0, 0, 0, "", NOTHING)]
