"""Conversation repair against a plain dynamic programme over all edits."""

import random
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import conversation_repair as repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, repaired rows) of (role, text, fault) rows: all edits, kept least by (cost, audit) per state."""
    ways = {"": (0, "", ())}
    for role, text, fault in rows:
        ways = with_inserts(ways)
        new = {}

        def offer(state, way, new=new):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        late = fault == "t"
        for state, (cost, audit, out) in ways.items():
            offer(state, (cost + 3, audit + "D", out))
            if fault in ("b", "d"):
                continue
            offer(NEXT[state], (cost + 2 + late, audit + "R", (*out, ({"u": "user", "a": "assistant"}[NEXT[state]], text))))
            if role and state + role[:1] in ("s", "u", "su", "ua", "au"):
                offer(role[:1], (cost + late, audit + "K", (*out, (role, text))))
        ways = new
    return min((w for s, w in with_inserts(ways).items() if s in ("", "a")), key=lambda w: w[:2])


def with_inserts(ways):
    ways = dict(ways)
    for _ in range(4):
        for state, (cost, audit, out) in list(ways.items()):
            to = NEXT[state]
            way = (cost + 2, audit + "I", (*out, ({"u": "user", "a": "assistant"}[to], "")))
            if to not in ways or way[:2] < ways[to][:2]:
                ways[to] = way
    return ways


def key(x):
    return (x is not None, x or 0)


def results(rows):
    """{conv_id: results} of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda r: (key(r[0]), r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in mine:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            marked.append((role, text, "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"))
            seen.add((role, text))
        cost, audit, left = cheapest(marked)
        turns = {t for t, *_ in mine if t is not None}
        kinds = [f for *_, f in marked]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest(), left)
    return out


faulty = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from("-tbd--")), max_size=14)


@settings(max_examples=300, deadline=None)
@given(faulty)
def test_search_equals_dynamic_programme(rows):
    made = [(r, "x", f) for r, f in rows]
    got = repair.Search([r[:1] for r, _ in rows], [f for _, f in rows]).best("^", None)
    assert got == cheapest(made)[:2]


@settings(max_examples=150, deadline=None)
@given(faulty, st.integers(1, 4))
def test_pieces_put_together_equal_one_search(rows, size):
    cut = [rows[i : i + size] for i in range(0, len(rows), size)]
    tables = [repair.Search([r[:1] for r, _ in p], [f for _, f in p]).table() for p in cut]
    ahead = [[2 * len(repair.TAIL[s]) for s in repair.STATES]]
    for costs, _ in reversed(tables):
        ways = [[costs[4 * p + q] + ahead[0][q] for q in range(4) if costs[4 * p + q] >= 0 and ahead[0][q] >= 0] for p in range(4)]
        ahead.insert(0, [min(w, default=-1) for w in ways])
    state, total, audit = "^", 0, ""
    for part, (costs, audits), later in zip(cut, tables, ahead[1:], strict=True):
        cost, edits = repair._pick({"costs": costs, "audits": audits, "ahead": later}, state)
        total, audit, state = total + cost, audit + edits, repair._after([r for r, _ in part], edits, state)
    assert (total + 2 * len(repair.TAIL[state]), audit + repair.TAIL[state]) == cheapest([(r, "x", f) for r, f in rows])[:2]


@pytest.fixture(scope="module")
def talks():
    rng, out = random.Random(3), []
    say = lambda: rng.choice(["Hello there.", "What is it?", "no end", "Well!", " \t", "", "two\nlines.", None, "é" * 40 + "."])
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 9)):
            out.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""]), say()))
    out += [(77, t // 2, ("user", "assistant")[t % 2], f"turn {t // 3}" + "." * (t % 5 > 0)) for t in range(300)]  # many pieces and ties
    out += [(78, 5, "user", "the same."), (78, 5, "user", "the same."), (79, None, "assistant", "x" * 100_000)]
    return out


@pytest.mark.parametrize("size", [2, 7, 64])
def test_repair_equals_brute_force(spark, talks, size):
    df = spark.createDataFrame([(*r, 1, "x") for r in talks], "conv_id long, turn long, role string, text string, cost int, seq string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df, piece_rows=size).collect()}
    assert got == {c: w[:-1] for c, w in results(talks).items()}
    turns = {}
    for r in sorted(repair.repaired_turns(df, piece_rows=size).collect(), key=lambda r: (key(r.conv_id), r.n)):
        assert r.n == len(turns.setdefault(r.conv_id, []))
        turns[r.conv_id].append((r.role, r.text))
    assert turns == {c: list(w[-1]) for c, w in results(talks).items() if w[-1]}


def test_damage_and_ids_without_rows(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    rows = []
    for c, t, role, text in talks:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        rows += [(c, t, "user" if kind == 4 else role, text)] * ((kind != 0) + (kind == 3))
    broken = repair.damaged(df)
    assert sorted(map(repr, map(tuple, broken.collect()))) == sorted(map(repr, rows))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_all(df, broken).collect()}
    none = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    want = {c: w[:-1] for c, w in results(rows).items()}
    assert got == {c: want.get(c, none) for c in {r[0] for r in talks}}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_all(df, repair.damaged(df)).count() == 0 and repair.repaired_turns(df).count() == 0
