"""Substring de-duplication against every window looked up in a dictionary."""

import random
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import substring_dedup as sub

N = sub.WINDOW


def removed(rows):
    """The covered word numbers of each (id, text) row, rows of one id in the order given."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    words, first, out = [[w.decode() for w in (t or "").encode().split()] for _, t in rows], {}, {}
    for k in order:
        for s in range(len(words[k]) - N + 1):
            first.setdefault(tuple(words[k][s : s + N]), (k, s))
    for k in range(len(rows)):
        gone = set()
        for s in range(len(words[k]) - N + 1):
            if first[tuple(words[k][s : s + N])] != (k, s):
                gone.update(range(s, s + N))
        out[k] = gone
    return words, out


def check(df, rows, **options):
    words, gone = removed(rows)
    want = sorted(repr((i, len(w), len(g), sha256(" ".join(x for n, x in enumerate(w) if n not in g).encode()).hexdigest())) for (i, _), w, g in zip(rows, words, gone.values(), strict=True))
    got = sub.dedup_substrings(df, **options).collect()
    assert sorted(repr(tuple(r)[:4]) for r in got) == want
    assert all(sum(s.e - s.s for s in r.spans) == r.n_removed for r in got)
    return got


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "dé", "e", "f,"]) for _ in range(n))
    passage, other = say(70), say(25)
    out = [(i, t) for i, t, _ in texts if i != 105]
    out += [(200 + i, say(rng.randint(0, 40)) + " " + " ".join(passage.split()[rng.randint(0, 30) : rng.randint(40, 70)]) + "\n" + say(5) + rng.choice([" ", "\t\n"]) + other) for i in range(25)]
    out += [(300, "same " * 21), (301, "same " * 60), (302, "a b c " * 30), (303, passage + " " + passage), (304, " ".join(passage.split()[:19])), (305, " ".join(passage.split()[:20]))]
    out += [(None, passage), (None, other + " " + passage), (306, passage.replace(" ", "\x0b")), (306, say(300)), (306, say(25) + " " + passage)]
    return out


@pytest.mark.parametrize(("block", "shard"), [(1 << 21, 20_000), (2000, 7)])
def test_equals_brute_force(spark, rows, block, shard):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({c: F.lit(1) for c in ("uid", "block", "h", "kind", "sha")})
    got = check(df, rows, block_bytes=block, shard_phrases=shard, with_text=True)
    assert sum(r.n_removed > 0 for r in got) > 40
    for r in got:
        assert r.n_removed == 0 or sha256((r.text or "").encode()).hexdigest() == r.kept_sha256


def test_repeated_rows_and_an_empty_table(spark, rows):
    df = spark.createDataFrame([(7, "w " * 5 + "x y z " * 9)] * 3 + [(7, None), (None, "")], "doc_id long, text string")
    got = sub.dedup_substrings(df).collect()
    words, gone = removed([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(r.n_removed for r in got) == sorted(len(g) for g in gone.values())
    assert sub.dedup_substrings(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.integers(1, 6))
def test_anchors_of_equal_windows_are_equal(letters, period):
    import numpy as np

    text = " ".join((letters * 3)[: 80 // period * period])
    words = sub.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    split, seen = text.split(), {}
    assert len(words.anchors) == max(0, len(split) - N + 1)
    for s, (anchor, one) in enumerate(zip(words.anchors.tolist(), words.windows(np.arange(len(words.anchors)), 1).tolist(), strict=True)):
        assert seen.setdefault(tuple(split[s : s + N]), (anchor, one)) == (anchor, one)
        assert anchor == min(words.grams[s : s + N - sub.ANCHOR + 1].tolist())


def test_words_have_letters_of_their_own():
    spelt = [sub.spelling(i) for i in [*range(5000), *range(7_000_000, 7_100_000)]]
    assert len(set(spelt)) == len(spelt) and all(len(x) == 2 for x in spelt)
    assert not any(0xD800 <= ord(c) < 0xE000 for x in spelt for c in x)
    assert not {x[0] for x in spelt} & {x[1] for x in spelt}
