"""Places of regular expressions in texts, with Spark's own functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def matches(text: Column, regex: Column, extra: dict[str, Column] | None = None) -> Column:
    """array<struct<s, e, m>> of all matches from the left that don't overlap: code points from 0, end exclusive.

    The pieces between matches and the matches themselves give the places. extra: columns added to each match.
    """
    pieces = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0)), lambda p, m: F.struct(F.length(p).alias("g"), F.length(m).alias("l"), m.alias("m")))
    more = [v.alias(k) for k, v in (extra or {}).items()]
    none = F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("m"))), lambda x: x["s"] > 0)
    found = F.aggregate(
        F.filter(pieces, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["g"] + x["l"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["l"]).alias("e"), x["m"].alias("m")))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), *more)) if more else found
