"""Line de-duplication of short lines, at the steps of the ends and of lines made to collide, against brute force."""

import random

import brute
import numpy as np
import pytest

from tidemark.llm import line_dedup, queries
from tidemark.llm.common import word_hashes


@pytest.mark.parametrize("least", [2, 6, 12])
def test_short_lines_one_word_edit_away(spark, least):
    rng = random.Random(11)
    rows = []
    for i in range(80):
        n = [*range(1, 14), 19, 20, 21, 39, 40, 41, 80, 81][i % 21]
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        for k in range(4):  # the line, and a word replaced, deleted or inserted
            w, at = list(base), rng.randrange(n)
            w[at : at + 1] = [[w[at]], [f"x{rng.randrange(4000)}"], [], [w[at], "new"]][k]
            rows.append((4 * i + k, " ".join(w) + "\nown line of the text " + str(4 * i + k) * 2))
    rows.append(rows[9])
    rng.shuffle(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()}
    want = brute.dedup_lines(rows, least=least)
    assert got == {i: want[i, t] for i, t in rows}
    assert want != brute.dedup_lines(rows, least=100)


def thue_morse(a, b, n):
    return [(a, b)[i.bit_count() & 1] for i in range(n)]


def test_lines_that_a_polynomial_hash_takes_for_the_same_stay(spark):
    rows, at = [], 0
    for n in (1024, 2048, 4096):
        for a, b in (("alpha", "beta"), ("beta", "alpha")):
            for join in (" ", ""):  # as words, and as one long word with a few others
                rows.append((at, join.join(thue_morse(a, b, n)) + " and five more words here"))
                at += 1
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.dedup_lines(rows)
    assert got == {i: want[i, t] for i, t in rows}
    # those of one long word are one replaced word apart; the others have nothing in common
    assert sum(bool(t) for t in got.values()) == 6 + 1


def test_words_of_all_lengths_have_their_own_hash():
    words = [w.encode() for n in (*range(1, 20), 31, 32, 33, 1024) for w in ("a" * n, "a" * (n - 1) + "b", "b" + "a" * (n - 1), "".join(thue_morse("a", "b", n)), "".join(thue_morse("b", "a", n)))]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    got = word_hashes(data, starts, ends).tolist()
    assert len(set(got)) == len(set(words)) and len(set(zip(got, words, strict=True))) == len(set(words))


@pytest.mark.parametrize("a, b, near", [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("a b c", "a b x c", True), ("a b c", "x b y", False), ("a b", "a b c d", False), ("", "a", True), ("a b c d", "b c d e", False)])
def test_one_edit(a, b, near):
    assert line_dedup.one_edit(a.encode(), b.encode()) == line_dedup.one_edit(b.encode(), a.encode()) == near == brute.near_lines(a.split(), b.split())


def test_the_query_compares_lines_of_six_words(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five seven\nkept")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()} == {1: "one two three four five six", 2: "kept"}


def test_ends_too_long_for_the_line_are_refused(spark):
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"), min_words=1)
