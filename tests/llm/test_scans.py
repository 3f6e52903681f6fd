"""License and secret scans, URL rules, main text and vectors."""

import hashlib
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_extract, license_scan, queries, secret_scan, url_filter, vector_dedup

LICENSES = [
    (0, "Licensed under the GNU General Public License, version 3 or later.", "gpl-3-or-later"),
    (1, "SPDX-License-Identifier: MIT", "mit"),
    (2, "This is CC BY-NC-SA 4.0 text", "cc-by-nc,cc-by-nc-sa-4.0"),
    (3, "under the mit license and the Apache License, Version 2.0", "apache-2,mit"),
    (4, "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    (5, "no terms here", ""),
    (6, None, ""),
    (7, "underthe mit license; CC  by\nNC", "cc-by-nc,mit"),
]


def test_license_labels(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in LICENSES], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("labels", "__low", "places", "base")})
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert {i: got[i].labels for i, *_ in LICENSES} == {i: want for i, _, want in LICENSES}
    assert got[3].score == 1.0 and got[5].score == 0.0 and 0 < got[0].score < 1


def test_license_base(docs, texts):
    phrases = {label: p.split() for label, p in license_scan.PHRASES}
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(docs).collect())
    want = []
    for i, t, _ in texts:
        w = brute.words(t, brute.ALNUM)
        hits = sorted((k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p)
        want.append(((i is not None, i or 0), len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))))
    assert got == sorted(want)


def _base(text):
    text = text or ""
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    found = sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least)
    return ",".join(f"{name}:{s}:{e}" for s, _, e, name in found)


def test_secret_base(spark, docs, texts):
    more = [(200, "token=token:abcdefg password = 'x' secret:\"abcdef\" 😀 API_KEY=ABCDEFabc"), (201, "AKIA" * 9 + " " + "ab12" * 9), (202, "token=" * 50 + "abcdefgh")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = secret_scan.scan(df).select("doc_id", secret_scan.joined("base_spans").alias("b")).collect()
    assert sorted((r.doc_id or -1, r.b) for r in got) == sorted((i or -1, _base(t)) for i, t in [(i, t) for i, t, _ in texts] + more)


def test_secret_query_has_the_digest(spark, tmp_path):
    spark.createDataFrame([(1, "token = abcdef123"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_secret_scans(spark, str(tmp_path)).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"assign:0:17").hexdigest() and got[1].spans == "assign:0:17"
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""


@pytest.mark.parametrize("s", ["EXAMPLEaB3xK9mQ2pL7vR4tY8", "0123456789abcdefghijkl", "internationalisationally"])
def test_allowed_strings(spark, s):
    assert not secret_scan.scan(spark.createDataFrame([(1, s)], "doc_id long, text string")).first().all_spans


URLS = ["http://www.example.com/en/71?x", "https://example.com/en/6", "http://a.net/de/8", "http://b.EXAMPLE.net/de/81#top", "https://x.org/fr/1", "http://com/en/", "no scheme", None, "http://example.com", "x://notexample.com/en/7", "http://h/p?u=http://example.com/en/1", "http://user:p@example.org:80/es/1", "http://example.com/EN/7"]


def _judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(brute.UPPER)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("rules", [url_filter.RULES, [], [("", "/p", "block"), ("example.com", "", "block"), ("com", "/en/71", "allow"), ("example.com", "/en/71", "block"), ("org:80", "/es/1", "block")]])
def test_url_rules(spark, rules):
    rows = [(i % 9, u) for i, u in enumerate(URLS * 3)] + [(None, URLS[0])] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(0) for c in ("host", "part", "key", "salt", "rule")})
    made = spark.createDataFrame([*rules, (None, "/x", "block")], "host string, path string, verdict string")
    got = url_filter.judge_urls(pages, made).collect()
    assert sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(repr, ((i, *_judge(u, rules)) for i, u in rows)))
    assert url_filter.judge_urls(pages.where("false"), made).count() == 0


def test_rules_are_those_of_the_contract(spark, tmp_path):
    said = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    made = [(*rule.partition("/")[::2], verdict) for verdict, rule in (x.split(" ") for x in said.split(", "))]
    assert url_filter.RULES == [(host, f"/{path}", verdict) for host, path, verdict in made]
    spark.createDataFrame([(1, "http://a.net/de/9"), (2, "http://a.example.net/de/81")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op2_url_filters(spark, str(tmp_path)).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block")}


def test_many_nested_rules_over_many_ranges(spark):
    hosts = [f"h{i % 40}.example.com" for i in range(2000)]
    rows = [(i, f"http://{h}/a/{i % 7}/{i % 11}/x") for i, h in enumerate(hosts)]
    rules = [("example.com", "/", "allow"), ("com", "/a/1", "block")] + [(f"h{k}.example.com", f"/a/{k % 7}/{k % 11}", "block") for k in range(40)] + [("example.com", f"/a/{k}/", "allow") for k in range(7)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: _judge(u, rules) for i, u in rows}


HTML = [
    ("<html><body><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>One &amp; two,\n three.<p>Four <b>bold</b>.</article><footer>f</footer></body></html>", "Title\nOne & two, three.\nFour bold."),
    ("<body><div id=menu><a href=1>Home</a><a href=2>About us</a></div><div class='content'><h1>Title here</h1><div>First long paragraph of the text, with <a href=x>a link</a> inside.</div><div>Second paragraph, also long enough to count.</div></div></body>", "Title here\nFirst long paragraph of the text, with a link inside.\nSecond paragraph, also long enough to count."),
    ("<main><header><h1>T</h1></header><p>Hello world.</p><section id='comments'><p>A reader says very much here.</p></section><div class='cookie-notice'>Accept?</div><form>Name <input></form></main>", "T\nHello world."),
    ("<div id='header'>Site</div><div id='content'><p>One long enough line of text.</p><p>Another long enough line.</p></div><div class='sidebar-right'>s</div>", "One long enough line of text.\nAnother long enough line."),
    ("plain text &lt;here&gt;", "plain text <here>"),
    ("<script>var a = '<p>x</p>'</script><style>p{}</style><!-- c --><p hidden>h</p>", ""),
    ("<article><p>Cut off in the mid", "Cut off in the mid"),
    ("<p>a</p></div></span><p>b", "a\nb"),
    ("<" * 50 + "p>deep", None),
    ("", ""),
    (None, ""),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(HTML)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "id")})
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert len(got) == len(HTML)
    for i, (_, want) in enumerate(HTML):
        assert want is None or got[i].text == want, i
        assert got[i].n_chars == len(got[i].text) and got[i].url == f"u{i}"
    assert html_extract.extract(df.where("false")).count() == 0


def test_deep_nesting_and_long_pages():
    assert html_extract.main_text("<div>" * 30_000 + "x" + "</div>" * 30_000) == "x"
    assert len(html_extract.main_text("<article>" + "<p>word</p>" * 20_000 + "</article>")) == 5 * 20_000 - 1


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.22 * rng.standard_normal(24)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(400 + i, [3.0 * x for x in rows[i][1]]) for i in range(5)]
    odd = [(500, None), (501, [0.0] * 24), (502, [float("nan")] * 24), (503, [None] * 24), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [float("inf")] + [0.0] * 23)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "id", "links", "component", "label")})
    got = {r.vec_id: r for r in vector_dedup.link_vectors(df, block=40).collect()}
    linked = brute.cosines([v for _, v in rows]) >= 0.9
    comp = brute.reachable([i for i, _ in rows], lambda a, b: linked[a, b])
    assert len(got) == len(rows) + len(odd)
    recall = sum(got[i].n_links for i, _ in rows) / (linked.sum() - len(rows))
    assert 0.99 <= recall <= 1
    assert [got[i].component_id for i, _ in rows] == comp and all(got[i].kept == (i == c) for (i, _), c in zip(rows, comp, strict=True))
    assert all(got[i].n_links == 0 and got[i].kept for i in (500, 501, 502, 503, 504, 507))
    assert (got[505].n_links, got[506].component_id) == (1, 505)
    assert vector_dedup.link_vectors(df.where("false")).count() == 0


def test_recall_against_brute_force_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = vector_dedup.link_vectors(df, threshold=0.5).agg(F.sum("n_links")).first()[0]
    x = brute.cosines([r.embedding for r in df.collect()])
    assert got >= 0.9 * ((x >= 0.5).sum() - len(x))
