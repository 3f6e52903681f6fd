"""Entropy spans of whole texts against brute force, and strings of any length."""

import math
import random
import re
import string
import time

import pytest

from tidemark.llm import secret_scan

KEY = string.ascii_letters + string.digits + "+/_-"


def windows(s, bits, w=secret_scan.WINDOW):
    """First and last window with so much entropy, each counted anew."""
    entropy = lambda x: -sum(x.count(c) / w * math.log2(x.count(c) / w) for c in set(x))
    hot = [i for i in range(len(s) - w + 1) if entropy(s[i : i + w]) >= bits - 1e-9]
    return (hot[0], hot[-1] + w) if hot else None


def base_spans(text):
    kinds = [("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24)]
    return [(m.start(), k, m.end(), name) for k, (name, p, least) in enumerate(kinds) for m in re.finditer(p, text, re.A) if len(m[1]) >= least]


def all_spans(text):
    text, base = text or "", base_spans(text or "")
    out = list(base)
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text):
        s = m[0]
        if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or re.search(secret_scan.ALLOWED, s):
            continue
        hex_only = re.fullmatch("[0-9a-fA-F]+", s)
        found = windows(s, secret_scan.HEX_BITS if hex_only else secret_scan.KEY_BITS)
        if found and not any(b < m.start() + found[1] and m.start() + found[0] < e for b, _, e, _ in base):
            out.append((m.start() + found[0], 3 if hex_only else 4, m.start() + found[1], "hex_entropy" if hex_only else "key_entropy"))
    return [(name, s, e) for s, _, e, name in sorted(out)]


def made():
    rng = random.Random(3)
    run = lambda n, chars=KEY: "".join(rng.choice(chars) for _ in range(n))
    out = ["", None, "no secrets", "ÄÖ " + run(40) + " 😀 " + run(21), "AbC123" * 4, "AAAABBBB1111" * 3]
    out += [run(n) for n in (19, 20, 21, 255, 256, 257, 275, 276, 300, 511, 512, 513, 900)]
    out += [run(n, "0123456789abcdefABCDEF") for n in (20, 24, 300)] + ["ab1" * 100 + run(30) + "ab1" * 200, "a1" * 200]
    for _ in range(60):
        parts = [rng.choice([run(rng.randint(5, 60)), run(30, "0123456789abcdef"), "token=" + run(12), "x-token: '" + run(25) + "'", "AKIA" + run(18, string.ascii_uppercase), "some words of prose", "EXAMPLE" + run(20), "secret=" + run(3)]) for _ in range(rng.randint(1, 12))]
        out.append(rng.choice([" ", "\n", "+ "]).join(parts))
    return out


def test_all_spans_equal_brute_force(spark):
    rows = list(enumerate(made()))
    got = {r.doc_id: [tuple(x) for x in r.all_spans] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {i: all_spans(t) for i, t in rows}
    assert got == want
    assert sum("entropy" in x[0] for w in want.values() for x in w) > 40


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 2, 3), (None, "token=abcdefg", 2, 3), (1, None, 2, 3)], "doc_id long, text string, base int, __text int")
    assert secret_scan.scan(df.where("false")).count() == 0
    assert sorted((r.doc_id or 0, len(r.all_spans)) for r in secret_scan.scan(df).collect()) == [(0, 1), (1, 0), (1, 0)]


@pytest.mark.parametrize("make", [lambda rng: "".join(rng.choice(KEY) for _ in range(1_000_000)), lambda rng: " ".join("token=" + "".join(rng.choice(KEY) for _ in range(24)) + " " + "".join(rng.choice(KEY) for _ in range(24)) for _ in range(8_000))])
def test_long_texts_take_linear_time(spark, make):
    df = spark.createDataFrame([(1, make(random.Random(4)))], "doc_id long, text string").cache()
    df.count()
    began = time.perf_counter()
    assert secret_scan.scan(df).selectExpr("size(all_spans)").first()[0] > 0
    assert time.perf_counter() - began < 40
