"""Places of regular expressions in texts, and running values along arrays, with Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Items appended one by one at a time: appending copies an array, so its cost grows with the square of this only.
BLOCK = 64


def listed(*ranges: str, other: bool = False) -> str:
    """A regular expression's class of ASCII characters, or of all others, that names each one.

    The engine looks single characters up in a bit map, but tests ranges one after the other: a tenth of the time.
    """
    chars = "".join(f"\\x{c:02X}" for r in ranges for c in range(ord(r[0]), ord(r[-1]) + 1))
    return f"[{'^' if other else ''}{chars}]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def scanned(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """emit(state, item) for each item in order, where state is step's of all items before; linear for any usual length."""

    def along(part: Column, state: Column) -> Column:
        none = F.transform(F.slice(part, 1, 0), lambda x: emit(state, x))
        return F.aggregate(part, F.struct(state.alias("s"), none.alias("out")), lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], x))).alias("out")), lambda acc: acc["out"])

    def over(whole: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(whole, i + 1, F.lit(BLOCK)))

        def each(blocks: Column) -> Column:
            # the state before each block first, and one more behind the last
            states = F.aggregate(blocks, F.array(start), lambda acc, part: F.concat(acc, F.array(F.aggregate(part, F.element_at(acc, -1), step))))
            return F.flatten(F.zip_with(blocks, F.slice(states, 1, F.size(blocks)), along))

        return bound(cut, each)

    return bound(items, over)


def places(gaps: Column, found: Column) -> Column:
    """array<struct<s, e, m>> of matches, from the texts between them and their own: code points from 0, end exclusive."""
    pieces = F.zip_with(gaps, found, lambda p, m: F.struct(F.length(p).alias("g"), F.length(m).alias("l"), m.alias("m")))
    return scanned(
        F.filter(pieces, lambda x: x["m"].isNotNull()), F.lit(0),
        lambda at, x: at + x["g"] + x["l"],
        lambda at, x: F.struct((at + x["g"]).alias("s"), (at + x["g"] + x["l"]).alias("e"), x["m"].alias("m")),
    )


def matches(text: Column, regex: Column, extra: dict[str, Column] | None = None) -> Column:
    """array<struct<s, e, m>> of all matches from the left that don't overlap. extra: columns added to each match."""
    found = places(F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0)))
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), *(v.alias(k) for k, v in extra.items()))) if extra else found


def few_matches(text: Column, regex: Column) -> Column:
    """The same places where a text holds few: in a shorter plan, for expressions that nest many of them.

    Each place is appended to a copy of those before it, so time grows with the square of their number.
    """
    pieces = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0)), lambda p, m: F.struct(F.length(p).alias("g"), F.length(m).alias("l"), m.alias("m")))
    none = F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("m"))), lambda x: x["s"] > 0)
    return F.aggregate(
        F.filter(pieces, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["g"] + x["l"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["l"]).alias("e"), x["m"].alias("m")))).alias("out")),
        lambda acc: acc["out"],
    )


def before(text: Column, start: Column, n: int) -> Column:
    """Up to n characters that stand before a 0-based place."""
    first = F.greatest(start - n, F.lit(0))
    return F.substring(text, first + 1, start - first)


def after(text: Column, end: Column, n: int) -> Column:
    return F.substring(text, end + 1, F.lit(n))
