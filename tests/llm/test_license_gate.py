"""The license scan against its rules applied one by one, and what its keyword filter lets through."""

import random
import re
import time

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import license_scan
from tidemark.llm.license_rules import root, signatures, written

TEXTS = [
    ("All rights\n * reserved", "proprietary"),
    ("in the public\ndomain", "public-domain"),
    ("CC_BY 4.0", "cc-by-4.0"),
    ("CC  BY-SA", "cc-by-sa"),
    ("deal in the software without\n// restriction", "mit"),
    ("released into the public -- domain", "public-domain"),
    ("3-clause BSD", "bsd-3-clause"),
    ("the classpath exception", "gpl-exception"),
    ("Datenlizenz Deutschland", "dl-de-by"),
    ("GFDL v3", "gfdl-3"),
    ("public İ domain", "public-domain"),
    ("account by the accused, trails and sanctuary", ""),
    ("neither the name of -- nor the names of its contributors may be used to endorse", "bsd-3-clause"),
]


def test_separators_between_words_do_not_hide_a_rule(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(TEXTS)}


def example(expression, rng):
    """A text of a rule: one alternative of each group, optional parts at random."""
    s = expression.replace(r"\b", "").replace("[cs]", rng.choice("cs")).replace("[01]", "1").replace(r"\d{4}", "2019").replace(r"\d", "3").replace(r"\w+", "oo").replace(".{0,80}?", "any one ").replace(".{1,80}? ", "any one ").replace(".{1,60}? ", "any one ")
    while m := re.search(r"\((?:\?:)?([^()]*)\)(\?)?", s):
        s = s[: m.start()] + (rng.choice(m[1].split("|")) if not m[2] or rng.random() < 0.5 else "") + s[m.end() :]
    return re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", s)


def wrapped(text, rng):
    return re.sub(" ", lambda _: rng.choice([" ", " ", "\n", "-", "\n * ", " _", ", "]), rng.choice([str, str.upper, str.title])(text))


def detections(text):
    """Every rule on every text, and every pair of places."""
    found = {(m.start(), m.end(), p, label) for label, p, _, whole, _ in signatures() for m in re.finditer(whole, text, re.A)}

    def beats(o, d):
        around, inside = o[0] <= d[0] and o[1] >= d[1], o[0] >= d[0] and o[1] <= d[1]
        return (around or inside) and o[2] > d[2] or around and o[2] == d[2] and o[1] - o[0] > d[1] - d[0]

    return sorted(d for d in found if not any(beats(o, d) for o in found))


def expected(text):
    """labels, score and detections."""
    w, found = brute.words(text, brute.ALNUM), detections(text or "")
    base = {label for label, p in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
    return ",".join(sorted(base | {d[3] for d in found})), 1.0 if base else max((d[2] for d in found), default=0) / 100, found


def made():
    rng = random.Random(8)
    out = [wrapped(example(single, rng), rng) for *_, single in signatures()]
    prose = ["some words of prose", "account by account", "the trail", "reserved seats in the domain", "é", "mit", "license", "version 2", "or later", "CC", "by nc", "under the"]
    for _ in range(150):
        out.append(rng.choice([" ", "\n", ". "]).join(wrapped(example(rng.choice(signatures())[-1], rng), rng) if rng.random() < 0.6 else rng.choice(prose) for _ in range(rng.randint(1, 8))))
    return [*out, "", None]


def test_scan_equals_all_rules_on_all_texts(spark):
    rows = list(enumerate(made()))
    got = {r.doc_id: (r.labels, r.score, [tuple(d) for d in r.detections or []]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {i: expected(t) for i, t in rows}
    for i, t in rows:
        assert got[i] == want[i], t
    assert sum(bool(w[0]) for w in want.values()) > 300


@pytest.mark.parametrize("seed", range(5))
def test_every_match_holds_its_keyword(seed):
    rng = random.Random(seed)
    for label, _, keyword, whole, single in signatures():
        text = wrapped(example(single, rng), rng)
        assert re.search(whole, text, re.A), (label, text)
        collapsed = re.sub("[^A-Za-z0-9]+", " ", text).lower()
        assert keyword in collapsed and keyword in text.lower() and re.search(single, collapsed), (label, text)
        assert root(keyword, single) in text.lower(), (label, text)
        assert keyword not in license_scan.CLOSER or re.search(license_scan.CLOSER[keyword].replace(r"\z", r"\Z"), text.lower()), (label, text)


def test_rules():
    rules = signatures()
    assert len({r[3] for r in rules}) == len(rules) and len({r[3] for r in written()}) >= 200
    assert all(re.fullmatch("[a-z0-9]+", r[2]) for r in rules)


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 2, 3), (None, "under the mit license", 2, 3), (1, None, 2, 3)], "doc_id long, text string, base int, __text int")
    assert license_scan.scan(df.where("false")).count() == 0
    assert sorted((r.doc_id or 0, r.n_words, r.labels) for r in license_scan.scan(df).collect()) == [(0, 4, "mit"), (1, 0, ""), (1, 0, "")]


def test_long_text_with_many_places(spark):
    df = spark.createDataFrame([(1, "CC BY-SA 4.0, GPL v3, some words. " * 5_000)], "doc_id long, text string").cache()
    df.count()
    began = time.perf_counter()
    row = license_scan.scan(df).first()
    assert len(row.detections) == 10_000 and row.labels == "cc-by-sa-4.0,gpl-3" and row.n_words == 45_000
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("n", [7, 20_000])
def test_places_that_overlap_in_a_chain(spark, n):
    text = "under the mit license " * n
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    df.count()
    began = time.perf_counter()
    row = license_scan.scan(df).first()
    assert time.perf_counter() - began < 60
    assert row.n_base == n and row.labels == "mit" and row.detections
    if n < 100:
        assert [tuple(d) for d in row.detections] == detections(text)


def test_chained_and_nested_places_equal_all_pairs(spark):
    rng, rows = random.Random(5), []
    for _ in range(120):
        rows.append([(s, s + rng.randint(1, 6), rng.choice([10, 20, 30]), rng.choice("ab")) for s in (rng.randint(0, 12) for _ in range(rng.randint(1, 150 if _ % 40 == 0 else 9)))])

    def beats(o, d):
        around, inside = o[0] <= d[0] and o[1] >= d[1], o[0] >= d[0] and o[1] <= d[1]
        return (around or inside) and o[2] > d[2] or around and o[2] == d[2] and o[1] - o[0] > d[1] - d[0]

    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, found array<struct<s: int, e: int, priority: int, label: string>>")
    got = {r.i: [tuple(x) for x in r.kept] for r in df.select("i", license_scan.unsuppressed(F.col("found"), [10, 20, 30]).alias("kept")).collect()}
    assert got == {i: sorted(d for d in set(r) if not any(beats(o, d) for o in r)) for i, r in enumerate(rows)}
