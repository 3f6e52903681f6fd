"""Secret scan with Spark's own functions: base patterns, and sliding-window entropy over candidate strings.

A candidate is a run of key characters that holds a letter and a digit. A window slides over it; the sum of
c * log2(c) over the window's character counts is kept up to date by the counts of the one character that enters and
the one that leaves, and gives the Shannon entropy. Windows at or above the threshold of the candidate's character
class mark a span from the first to the last of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.places import bound, listed, matches, scanned

#: Base kinds in the order in which equal starts are listed: expression and what a match needs. Fixed values.
_VALUE = listed("A-Z", "a-z", "0-9", "+", "/", "_", ".", "=", "-")
_NAMED = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN, VALUE = f"(?i){_NAMED}({_VALUE}+)", f"(?is)^{_NAMED}"
ACCESS, HEX = f"AKIA{listed('A-Z', '0-9')}+", f"{listed('0-9', 'a-f')}+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "hex_entropy", "key_entropy")
WINDOW = 20
#: Candidates, and the entropy in bits from which a window of a class is random enough. A window of 20 characters has
#: log2(20) = 4.32 bits at most.
_KEY = listed("A-Z", "a-z", "0-9", "+", "/", "_", "-")
CANDIDATE = f"(?<!{_KEY}){_KEY}{{{WINDOW},}}+"
#: Windows swept at a time: characters of a string are counted from its start, so a long one is cut into pieces.
PIECE = 128
HEX_BITS, KEY_BITS = 3.0, 3.7
#: Allow-list: strings with these are examples, and those of one kind of character only are words, numbers or rulers.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6,}|0123456789|abcdefgh|(.)\1{7,}"


def _more(n: Column) -> Column:
    """By how much a window's sum grows if a character that it holds n times comes once more."""
    terms = [c * math.log2(c) if c > 1 else 0.0 for c in range(WINDOW + 1)]
    return F.get(F.array(*(F.lit(b - a) for a, b in zip(terms, terms[1:], strict=False))), n)


def _swept(s: Column, limit: Column, before: Column) -> Column:
    """struct<first, last>: starts of the first and last window of s whose sum is within the limit, from `before` on; null fields if there is none."""
    w = WINDOW
    part = lambda i, n: F.substring(s, i, n)
    without = lambda x, char: F.length(F.replace(x, char, F.lit("")))
    opening = F.aggregate(F.sequence(F.lit(1), F.lit(w)), F.lit(0.0), lambda acc, i: acc + _more(i - 1 - without(part(F.lit(1), i - 1), part(i, F.lit(1)))))

    def state(total: Column, first: Column, last: Column) -> Column:
        return F.struct(total.alias("t"), first.alias("first"), last.alias("last"))

    def step(acc: Column, i: Column) -> Column:
        # i: the start of the new window; the old one began at i - 1
        stays = lambda char: w - 1 - without(part(i, F.lit(w - 1)), char)
        total = acc["t"] - _more(stays(part(i - 1, F.lit(1)))) + _more(stays(part(i + (w - 1), F.lit(1))))
        return bound(total, lambda t: state(t, F.coalesce(acc["first"], F.when(t <= limit, i)), F.when(t <= limit, i).otherwise(acc["last"])))

    begun = bound(opening, lambda t: state(t, F.when(t <= limit, F.lit(1)), F.when(t <= limit, F.lit(1))))
    starts = F.filter(F.sequence(F.lit(1), F.length(s) - (w - 1)), lambda i: i > 1)
    return F.aggregate(starts, begun, step, lambda acc: F.struct((acc["first"] + before).alias("first"), (acc["last"] + before).alias("last")))


def hot_windows(s: Column, bits: Column) -> Column:
    """struct<first, last>: starts, from 1, of the first and last window of s at or above the bits; null fields if there is none.

    Each piece is swept with the characters behind it that its last windows reach.
    """
    most = F.lit(WINDOW) * (F.lit(math.log2(WINDOW)) - bits) + 1e-9  # entropy >= bits: sum <= w * (log2(w) - bits)

    def swept(pieces: Column, limit: Column) -> Column:
        reach = lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(pieces, i + 1), F.lit(1), F.lit(WINDOW - 1)), F.lit("")))
        return F.transform(pieces, lambda p, i: bound(reach(p, i), lambda x: F.when(F.length(x) >= WINDOW, _swept(x, limit, i * PIECE))))

    pieces = F.regexp_extract_all(s, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    hot = bound(most, lambda limit: bound(pieces, lambda p: swept(p, limit)))
    return bound(hot, lambda x: F.struct(F.array_min(F.transform(x, lambda h: h["first"])).alias("first"), F.array_max(F.transform(x, lambda h: h["last"])).alias("last")))


def apart(base: Column, found: Column) -> Column:
    """The found spans that meet no base span: none that begins before them reaches them, none begins within them."""
    row = lambda added: lambda x: F.struct(x["s"].alias("s"), F.lit(added).alias("added"), x["e"].alias("e"), x["k"].alias("k"), F.lit(True).alias("free"))
    mark = lambda x, free: F.struct(x["s"].alias("s"), x["added"].alias("added"), x["e"].alias("e"), x["k"].alias("k"), (x["free"] & free).alias("free"))
    both = F.sort_array(F.concat(F.transform(base, row(0)), F.transform(found, row(1))))
    ahead = scanned(both, F.lit(0), lambda most, x: F.when(x["added"] == 0, F.greatest(most, x["e"])).otherwise(most), lambda most, x: mark(x, most <= x["s"]))
    back = scanned(F.reverse(ahead), F.lit((1 << 31) - 1), lambda least, x: F.when(x["added"] == 0, F.least(least, x["s"])).otherwise(least), lambda least, x: mark(x, least >= x["e"]))
    return F.transform(F.filter(back, lambda x: (x["added"] == 1) & x["free"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_spans, all_spans) of every row of docs.

    Spans are structs of start, end (code points from 0, end exclusive) and kind, by start, then kind in the order of
    KINDS. Base matches run from the left without overlap in each kind and are dropped if too short. Entropy spans are
    added where they meet no base span. Null and empty texts have no spans. Repeated rows are each returned; an empty
    table gives an empty table. Other columns are not read.
    """
    text = F.col("__text")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    def base(kind: str, regex: str, size) -> Column:
        long = F.filter(matches(text, F.lit(regex)), lambda m: F.length(size(m["m"])) >= LEAST[kind])
        return F.transform(long, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(KINDS.index(kind)).alias("k")))

    whole = lambda m: m
    none = F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("k"))), lambda x: x["s"] > 0)
    is_assign = text.rlike(ASSIGN)
    long_hex = listed("0-9", "a-f") + "{%d" % LEAST["hex"]
    is_hex = text.rlike(long_hex + "}")
    assign = F.when(is_assign, base("assign", ASSIGN, lambda m: F.regexp_replace(m, F.lit(VALUE), F.lit("")))).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), base("access", ACCESS, whole)).otherwise(none)
    # a run of hex digits is one match, so runs too short can be left out at once
    hexes = F.when(is_hex, base("hex", long_hex + ",}", whole)).otherwise(none)

    strings = F.when(text.rlike(CANDIDATE), F.filter(matches(text, F.lit(CANDIDATE)), lambda m: m["m"].rlike("[0-9]") & m["m"].rlike("[A-Za-z]") & ~m["m"].rlike(ALLOWED)))
    named = rows.select("__id", F.sort_array(F.concat(assign, access, hexes)).alias("base"), strings.alias("strings"))
    is_hex_string = lambda m: m.rlike("^[0-9a-fA-F]+$")
    hot = F.transform("strings", lambda m: F.struct(m["s"].alias("s"), is_hex_string(m["m"]).alias("hex"), hot_windows(m["m"], F.when(is_hex_string(m["m"]), HEX_BITS).otherwise(KEY_BITS)).alias("h")))
    found = F.transform(F.filter(hot, lambda x: x["h"]["first"].isNotNull()), lambda x: F.struct((x["s"] + x["h"]["first"] - 1).alias("s"), (x["s"] + x["h"]["last"] - 1 + WINDOW).alias("e"), F.when(x["hex"], 3).otherwise(4).alias("k")))
    named = named.select("__id", "base", F.coalesce(found, none).alias("found"))
    added = F.when(F.size("found") > 0, apart(F.col("base"), F.col("found"))).otherwise(none)
    kind = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.transform(spans, lambda x: F.struct(kind[x["k"]].alias("kind"), x["s"].alias("start"), x["e"].alias("end")))
    # sorted by start, end and kind so far; two kinds at one start have their own order
    order = lambda spans: F.transform(F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return named.select(F.col("__id").alias(id_col), count("assign"), count("access"), count("hex"), shown(order(F.col("base"))).alias("base_spans"), shown(order(F.concat(F.col("base"), added))).alias("all_spans"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
