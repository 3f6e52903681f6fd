"""Near copies, lines, benchmark passages, quality and mixing against brute force."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, mixing, quality, simhash
from tidemark.llm.components import components


@pytest.mark.parametrize("bucket", [256, 2])
def test_simhash_components(docs, texts, bucket):
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash.simhash_components(docs, bucket=bucket).collect())
    fps = [brute.fingerprint(t) for _, t, _ in texts]
    comp = brute.reachable([i for i, *_ in texts], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert got == sorted(((i is not None, i or 0), f"{f:016x}", c) for (i, *_), f, c in zip(texts, fps, comp, strict=True))


def test_covering_masks_hide_any_three_bits():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        bits = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & bits for m in simhash.MASKS)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(docs, texts):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*[c for c in docs.columns], "n_lines", "n_dropped"]
    want = brute.dedup_lines([(i, t) for i, t, _ in texts])
    rows = out.select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert len(rows) == len(texts)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, ((i, want[i, t]) for i, t, _ in texts)))
    assert sum(r.n_dropped for r in rows) > 60


@pytest.fixture(scope="module")
def items(spark, texts):
    long = texts[105 + 2][1].split()
    made = [(0, " ".join(long[200:230])), (1, " ".join(long[500:540]).upper()), (2, "three little words"), (3, ""), (4, None), (None, "left out of it"), (5, texts[3][1]), (6, " ".join(long[700:720]) + " never seen words at the very end of it all")]
    return spark.createDataFrame(made, "item_id long, text string").withColumns({c: F.lit(0) for c in ("hash", "id", "size_class")})


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_contamination(docs, texts, items, most):
    got = {(r.doc_id, r.item_id): r.containment for r in decontam.contaminated(docs, items, most_hashes=most).collect()}
    want = {(i, r.item_id) for i, t, _ in texts for r in items.collect() if r.item_id is not None and brute.contained(t, r.text)}
    assert set(got) == want and len(want) >= 3 and all(c >= 0.8 for c in got.values())
    left = decontam.drop_contaminated(docs, items, most_hashes=most)
    assert left.columns == docs.columns
    assert left.count() == len([i for i, *_ in texts if i not in {d for d, _ in want}])


def test_words_changed_beyond_a_fifth_do_not_match(spark):
    words = [f"w{i}" for i in range(60)]
    few, many = list(words), list(words)
    few[0] = few[59] = "x"
    for i in range(0, 60, 4):
        many[i] = "x"
    df = spark.createDataFrame([(1, " ".join(["a"] * 3000 + few)), (2, " ".join(many))], "doc_id long, text string")
    item = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(df, item).collect()] == [(1, 9)]


@pytest.fixture(scope="module")
def labelled(spark, docs, texts):
    """Shouting junk has label 0."""
    rows = [(1000 + i, "BUY!! NOW!! " * (3 + i % 50), "src9") for i in range(120)]
    junk = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in docs.columns if c not in ("doc_id", "text", "source")})
    both = docs.unionByName(junk.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    labels = [(i, 1, 0) for i, *_ in texts if i is not None] + [(1000 + i, 0, 0) for i in range(120)] + [(None, 0, 0), (5, None, 0), (77_777, 0, 1)]
    return both, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("score", F.lit(9))


def test_quality(labelled):
    both, labels = labelled
    rows = quality.quality_scores(both, labels).collect()
    assert len(rows) == both.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id != 102]
    assert np.mean([r.predicted == int(r.doc_id < 1000) for r in held]) >= 0.95
    kept = quality.keep_good(both, labels)
    assert kept.columns == both.columns and kept.count() == sum(r.predicted for r in rows)


def test_quality_without_labels(docs, labelled):
    none = labelled[1].where("false")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {1.0}
    assert quality.keep_good(docs, none).count() == docs.count()


def test_statistics_match_plain_counts():
    data = "Ab, 1! é|\nb b".encode()
    x = dict(zip(quality.FEATURES, quality.statistics(np.frombuffer(data, np.uint8), np.array([0, len(data), len(data)]))[0], strict=True))
    assert x["log_chars"] == pytest.approx(np.log1p(13)) and x["log_words"] == pytest.approx(np.log1p(5))
    share = lambda a, b: np.arcsin(np.sqrt(a / b))
    assert x["upper_share"] == pytest.approx(share(1, 13)) and x["bar_share"] == pytest.approx(share(1, 13)) and x["distinct"] == pytest.approx(share(4, 5)) and x["repeat"] == pytest.approx(share(2, 5))


def test_mixing(docs, texts):
    got = sorted((((r.doc_id is not None, r.doc_id or 0), r.size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect()))
    assert got == sorted(((i is not None, i or 0), n, round(t, 6), k) for i, n, t, k in brute.mixed(texts))
    assert got == sorted((((r.doc_id is not None, r.doc_id or 0), r.size, round(r.target, 6), r.taken) for r in mixing.mix(docs.repartition(5)).collect()))


def test_mixing_reshares_above_the_cap(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (500, "b"), (2, "c"), (400, "d"), (3, None)])]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: pytest.approx(r.target) for r in out} == {i: t for i, _, t, _ in brute.mixed(rows)}
    assert all(r.taken <= 3 * r.size for r in out)


def test_empty_tables(empty, items, labelled):
    assert simhash.simhash_components(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(empty, items.where("false")).count() == 0
    assert quality.quality_scores(empty, labelled[1]).count() == 0
    assert mixing.mix(empty).count() == 0


def test_rates_of_many_sources_equal_those_of_few(spark):
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 300):
        rows = [(f"s{k}" if k else None, int(x)) for k, x in enumerate(rng.pareto(0.7, n) * 20)]
        sizes = spark.createDataFrame(rows, "source string, size long")
        few, many = ({r.source: r.target for r in mixing.source_rates(sizes, in_one_task=k).collect()} for k in (n, -1))
        assert many == pytest.approx(few) and len(few) == n
        assert not rows or sum(few.values()) == pytest.approx(sum(x for _, x in rows))


def test_scores_are_the_densities_of_two_normal_distributions():
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    x = {k: rng.standard_normal((200, d)) @ rng.standard_normal((d, d)) + k for k in (0, 1)}
    model = quality.Discriminant.fit({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()})
    rows = rng.standard_normal((50, d)) * 2
    log = []
    own = [np.cov(x[k].T, bias=True) for k in (0, 1)]
    for k in (0, 1):
        c = (1 - quality.SHRINK_POOLED) * own[k] + quality.SHRINK_POOLED * (own[0] + own[1]) / 2
        c = (1 - quality.SHRINK_UNIT) * c + quality.SHRINK_UNIT * np.trace(c) / d * np.eye(d)
        apart = rows - x[k].mean(axis=0)
        log.append(-0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", apart, np.linalg.inv(c), apart))
    assert model.scores(rows) == pytest.approx(1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60))), rel=1e-4, abs=1e-9)


def test_held_out_labels_are_told_apart(spark):
    """Area under the curve on the given labels that were never learned from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == k]) for k in (1, 0))
    auc = ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()
    print("held-out AUC", round(float(auc), 4), "of", len(rows))
    assert auc > 0.9


def test_the_mixed_corpus_holds_each_row_as_often_as_taken(spark):
    rows = [(i, "a b " * (1 + i % 3), f"s{min(i % 9, 2)}", i, "x") for i in range(60)] + [(None, "c d", None, 1, None), (7, None, "s0", 2, None), (7, "", "s0", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copy string")
    counts = mixing.mix(docs, with_text=True).collect()
    out = mixing.emitted(docs)
    assert out.columns == ["doc_id", "text", "source", "size", "copy"]
    want = Counter({(r.doc_id, r.text): 0 for r in counts})
    for r in counts:
        want[r.doc_id, r.text] += r.copies
    assert Counter((r.doc_id, r.text) for r in out.collect()) == +want and len(counts) == len(rows)
    assert mixing.emitted(docs.limit(0)).count() == 0


def test_a_shingle_of_all_items_and_texts_leads_nowhere(spark):
    common = "this very phrase stands in all of them"
    rng = np.random.default_rng(2)
    made = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    rows = [(i, f"{common} {made(30)}") for i in range(60)]
    held = [(i, f"{made(40)} {common} {made(12)}") for i in range(58)] + [(58, rows[3][1] + " " + made(20)), (59, made(20) + "\n" + rows[4][1].upper())]
    items, docs = (spark.createDataFrame(x, f"{i} long, text string") for x, i in ((rows, "item_id"), (held, "doc_id")))
    sketch = decontam.sketches(items, "item_id", "text", 5, 0.8)
    assert sketch.groupBy("hash").count().where("count > 1").count() == 0 and sketch.count() > 60
    for most in (2_000_000, 0):
        got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, most_hashes=most).collect()}
        assert got == {(58, 3), (59, 4)}
        assert decontam.drop_contaminated(docs, items, most_hashes=most).count() == 58
