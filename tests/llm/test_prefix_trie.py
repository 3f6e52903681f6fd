"""Prefix tries against a plain dictionary of all first turns, and the radix tree against its keys."""

import random
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(talks):
    """The rows of all nodes for {conv_id: [(role, text)]}."""
    members = {}
    for conv, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(sums[c][0] for c in below) or 1, own + sum(sums[c][1] for c in below))
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(talks[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), *sums[node], sha256(ends.encode()).hexdigest()))
    return out


def in_order(rows):
    """{conv_id: turns}; rows of the same turn by role and id."""
    from hashlib import md5

    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            talks.setdefault(conv, []).append(((turn is not None, turn or 0, role, md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    return {c: [t for _, t in sorted(x)] for c, x in talks.items()}


def reopened(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = talks.get(c - c % 100, [])[:h] + own[h:]
    return out


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    for conv in [*range(0, 60), *range(100, 140), *range(203, 230), 5000]:
        for turn in range(rng.randint(1, 8)):
            out.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello é", "", None, "why?", "no"])))
    for conv in (301, 302, 303, 304, 305):  # long ones that part late, not at all, or end within another
        out += [(conv, t, "user", f"turn {t}") for t in range(30 if conv != 304 else 21)] + ([(conv, 30, "user", f"end {conv}")] if conv < 303 else [])
    out += [(None, 1, "user", "left out"), (7, 3, "user", "hi"), (7, 3, "user", "hi")]
    return out


@pytest.mark.parametrize(("keys", "band"), [(trie.BLOCK, trie.BAND), (3, 2), (50, 5)])
def test_tries_equal_brute_force(spark, rows, keys, band):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", part int, id string").repartition(3)
    for make, change in ((trie.sequences, lambda x: x), (trie.rebuilt, reopened)):
        got = trie.prefix_trie(*make(df), block_keys=keys, band=band)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(change(in_order(rows)))))


def test_one_group_of_copies_and_conversations_without_turns(spark):
    copies = [(c, t, "user", "same") for c in range(9000, 9300) for t in range(2)]
    got = trie.prefix_trie(*trie.rebuilt(spark.createDataFrame(copies, SCHEMA)), block_keys=4).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(reopened(in_order(copies)))))
    short = [(c, 0, "user", "x") for c in range(1, 40)]  # no conversation 0: most keep no turn
    got = trie.prefix_trie(*trie.rebuilt(spark.createDataFrame(short, SCHEMA))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(reopened(in_order(short)))))


def test_empty_table(spark):
    assert trie.prefix_trie(*trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


ids = st.integers(0, 300).map(lambda n: n.to_bytes(trie.TURN, "big"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(ids, max_size=4), min_size=1, max_size=40))
def test_radix_tree_has_every_prefix(made):
    keys = sorted({b"".join([b"c" * trie.TURN, *k]) for k in made})
    nodes = list(trie.RadixTree(keys).nodes())
    got = {}
    for parent, depth, own, some in nodes:
        prefix = keys[some][:depth]
        assert prefix not in got and (own is None or keys[own] == prefix)
        assert parent == -1 if depth == trie.TURN else keys[nodes[parent][3]][: nodes[parent][1]] == prefix[: -trie.TURN]
        got[prefix] = own
    assert set(got) == {k[:d] for k in keys for d in range(trie.TURN, len(k) + 1, trie.TURN)}
    assert {p for p, own in got.items() if own is not None} == set(keys)


def test_nodes_grow_through_all_layouts():
    node, seen = trie.Inner(b"", 0), set()
    for n, byte in enumerate(random.Random(1).sample(range(256), 256)):
        node.put(byte, byte)
        seen.add(node.layout)
        assert len(list(node.items())) == n + 1 and node.get(byte) == byte
    assert seen == {0, 1, 2, 3} and list(node.items()) == [(b, b) for b in range(256)]
