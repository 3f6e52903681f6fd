"""Properties of the byte-wise text helpers."""

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import html_extract, simhash
from tidemark.llm.common import LOWER, NOT_ALNUM, SPACE, shingle_hashes, slices, word_bounds, word_hashes
from tidemark.llm.line_dedup import _lines

TEXT = st.text(st.sampled_from("abcXYZ01 \n\t.,-é公😀\x0b\x00"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 40))
def test_words_and_shingles_of_batches(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for separators, pattern in ((SPACE, brute.SPACED), (NOT_ALNUM, brute.ALNUM)):
        words, seen = [], {}
        for part, data, offsets in slices(batch, "text", limit):
            starts, ends, first = word_bounds(data, offsets, separators)
            low = LOWER[data]
            hashes = word_hashes(low, starts, ends)
            own = [low[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)]
            for w, h in zip(own, hashes.tolist(), strict=True):
                assert seen.setdefault(w, h) == h
            shingles, begin = shingle_hashes(hashes, first, 3)
            for i in range(len(part)):
                mine = own[first[i] : first[i + 1]]
                words.append(mine)
                assert begin[i + 1] - begin[i] == (max(1, len(mine) - 2) if mine else 0)
            assert len(shingles) == begin[-1]
        assert words == [brute.words(t, pattern) for t in texts]
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_lines_are_numbered_within_their_text(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    *_, text, at, first, last = _lines(np.frombuffer(b"".join(raw), np.uint8), offsets)
    got = [(int(t), int(a), int(n)) for t, a, n in zip(text, at, last - first, strict=True)]
    assert got == [(i, k, len(brute.words(x))) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if brute.words(x)]


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute.fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=12), st.integers(0, 60))
def test_spanning_pairs_connect_what_all_pairs_do(fps, low):
    fps = list(dict.fromkeys([f % (1 << max(low, 1)) for f in fps]))
    pairs = {frozenset((a % 2**64, b % 2**64)) for a, b in simhash.spanning(np.array(fps, np.uint64), 3)}
    assert all((a ^ b).bit_count() <= 3 for a, b in map(tuple, pairs))
    near = brute.reachable(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert near == brute.reachable(fps, lambda i, j: frozenset((fps[i], fps[j])) in pairs)
    assert len(pairs) < max(1, len(fps))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>/apdivbr =\"'!-&;x "), max_size=80))
def test_any_text_parses(html):
    out = html_extract.main_text(html)
    assert out == out.strip() and "\n\n" not in out
