"""Places and running values against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.places import listed, matches, scanned


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_running_sums(spark, n):
    row = spark.range(1).select(F.expr(f"slice(transform(sequence(0, {n}), x -> int(x * 7 % 11)), 1, {n})").alias("x"))
    got = row.select(scanned(F.col("x"), F.lit(0), lambda s, x: s + x, lambda s, x: F.struct(s.alias("before"), x.alias("own")))).first()[0]
    items = [i * 7 % 11 for i in range(n)]
    assert [(r.before, r.own) for r in got] == [(sum(items[:i]), x) for i, x in enumerate(items)]


def test_null_has_no_running_values(spark):
    assert spark.sql("select cast(null as array<int>) x").select(scanned(F.col("x"), F.lit(0), lambda s, x: s + x, lambda s, x: x)).first()[0] is None


@pytest.mark.parametrize("text", ["", "none", "ab12 é99 😀7", "1" * 500, "a1" * 300])
def test_matches(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), F.lit("[0-9]+"), {"k": F.lit("n")})).first()[0]
    assert [(r.s, r.e, r.m, r.k) for r in got] == [(m.start(), m.end(), m[0], "n") for m in re.finditer("[0-9]+", text)]


def test_many_matches_take_linear_time(spark):
    text = "a1 " * 200_000
    got = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), F.lit("[0-9]+")).alias("m")).select(F.size("m"), F.element_at("m", -1)).first()
    assert got[0] == 200_000 and got[1].e == len(text) - 1


def test_listed_classes():
    assert re.fullmatch(listed("a-c", "+", "0-9") + "+", "abc+059") and not re.search(listed("a-c"), "d-")
    assert re.findall(listed(" ", "\t-\r", other=True) + "+", "a é\tb") == ["a", "é", "b"]
