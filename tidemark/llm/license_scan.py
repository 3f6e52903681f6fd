"""License scan with Spark's own functions: ordered signature rules behind a keyword filter.

A rule is tried on texts that hold its keyword and match it with single blanks for all that stands between words, which
is never stricter. Of two places of which one contains the other, that of the lower priority is suppressed, with equal
priorities the shorter one; the labels of the others count.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.places import bound, listed, matches, places, scanned
from .license_rules import root, signatures

#: Word characters and the others, before A-Z are lower-cased. Fixed values.
_OTHERS = ("\x00-\x2f", "\x3a-\x40", "\x5b-\x60", "\x7b-\x7f")
WORD, OTHER = listed(*_OTHERS, other=True), listed(*_OTHERS)
NOT_ASCII_WORD = listed("0-9", "A-Z", "a-z", other=True)
#: Keywords that prose holds too often are looked for with what follows in every match.
CLOSER = {"cc": "cc[^a-z0-9]+by", "rail": "rail(?:[^a-z0-9]|\\z)", "sun": "sun[^a-z0-9]+(?:industry|public)", "net": "x[^a-z0-9]+net[^a-z0-9]", "icu": "icu[^a-z0-9]", "ntp": "ntp[^a-z0-9]", "asl": "asl[^a-z0-9]", "oak": "blue[^a-z0-9]+oak", "clear": "clear[^a-z0-9]+bsd", "tcl": "tcl[^a-z0-9]+tk"}
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


def phrase_regex(phrase: str) -> str:
    return rf"(?i)(?<!{WORD})" + f"{OTHER}+".join(phrase.split()) + rf"(?!{WORD})"


def _gate(low: Column, words: list[str]) -> Column:
    # one expression for each: an alternation of them is tried whole at every character
    tests = [F.contains(low, F.lit(w)) & low.rlike(CLOSER[w]) if w in CLOSER else F.contains(low, F.lit(w)) for w in words]
    return reduce(lambda a, b: a | b, tests)


def _flat(parts: list[Column]) -> Column:
    return F.flatten(F.array(*parts))


def rule_places(text: Column, flat: Column, rules: list[tuple[str, int, str, str, str]]) -> Column:
    """array<struct<s, e, priority, label>> of all places of all rules, some twice; flat is the collapsed text."""
    groups = defaultdict(list)
    for label, priority, keyword, whole, single in rules:
        found = F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.split(text, whole, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(whole), F.lit(0)).alias("found"))
        groups[keyword].append(F.when(flat.rlike(single), found))
    tried = F.array(*(F.when(F.contains(flat, F.lit(k)), F.array_compact(F.array(*own))) for k, own in groups.items()))
    hits = F.flatten(F.array_compact(tried))
    placed = F.transform(hits, lambda h: F.transform(places(h["gaps"], h["found"]), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), h["priority"].alias("priority"), h["label"].alias("label"))))
    return F.flatten(placed)


def unsuppressed(found: Column, priorities: list[int]) -> Column:
    """The places that no other suppresses, each once, by place.

    Two sweeps over the places in order of their start, the longer and then the higher first. Going on, what is held
    for each priority is how far the places so far reach: one that reaches to a place's end contains it. Going back, it
    is the nearest end of the places behind: one that isn't behind a place's end is contained in it. So time grows with
    the number of places, however they overlap.
    """
    keyed = F.sort_array(F.transform(found, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), (-x["priority"]).alias("low"), x["label"].alias("label"))))
    level = lambda x: -x["low"]
    end = lambda x: -x["back"]
    none, far = F.lit(-1), F.lit((1 << 31) - 1)
    here = lambda p, s, before, at: F.struct(p.alias("p"), s.alias("s"), before.alias("before"), at.alias("at"))

    def reached(held: Column, x: Column) -> Column:
        """Does a place so far contain x, and is of higher priority, or of the same and longer?"""
        higher = lambda h: (h["p"] > level(x)) & (F.greatest(h["before"], h["at"]) >= end(x))
        same = lambda h: (h["p"] == level(x)) & ((h["before"] >= end(x)) | F.when(h["s"] < x["s"], h["at"] >= end(x)).otherwise(h["at"] > end(x)))
        return F.exists(held, lambda h: higher(h) | same(h))

    def further(held: Column, x: Column) -> Column:
        moved = lambda h: F.when(h["s"] < x["s"], here(h["p"], x["s"], F.greatest(h["before"], h["at"]), end(x))).otherwise(here(h["p"], h["s"], h["before"], F.greatest(h["at"], end(x))))
        return F.transform(held, lambda h: F.when(h["p"] == level(x), moved(h)).otherwise(h))

    def judged(places_: Column) -> Column:
        distinct = F.filter(places_, lambda x, i: (i == 0) | (x != F.get(places_, i - 1)))

        def swept(each: Column) -> Column:
            contained = scanned(each, F.array(*(here(F.lit(p), none, none, none) for p in priorities)), further, reached)
            nearest = lambda held, x: F.transform(held, lambda h: F.when(h["p"] == level(x), F.struct(h["p"].alias("p"), F.least(h["e"], end(x)).alias("e"))).otherwise(h))
            around = scanned(F.reverse(each), F.array(*(F.struct(F.lit(p).alias("p"), far.alias("e")) for p in priorities)), nearest, lambda held, x: F.exists(held, lambda h: (h["p"] > level(x)) & (h["e"] <= end(x))))
            out = F.zip_with(F.zip_with(each, contained, lambda x, c: F.struct(x.alias("x"), c.alias("c"))), F.reverse(around), lambda y, a: F.when(~(y["c"] | a), y["x"]))
            kept = F.filter(out, lambda x: x.isNotNull())
            return F.sort_array(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), end(x).alias("e"), level(x).alias("priority"), x["label"].alias("label"))))

        return bound(distinct, swept)

    return bound(keyed, judged)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every row of docs.

    Base: the places where a phrase of PHRASES stands word by word. detections: array of (s, e, priority, label) of the
    places that no other suppresses, in code points. labels: those of the base and of the detections, distinct and
    sorted. score: the highest priority among detections as a share of 100, 1 with a base place, 0 without any. Null
    texts count as empty; empty texts have no words and no labels. Ties in priority and place keep all their labels.
    Repeated rows are each returned; an empty table gives an empty table. Other columns are not read.
    """
    text, low, flat = F.col("__text"), F.col("__low"), F.col("__flat")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).withColumn("__low", F.lower("__text"))
    # each word with what stands around it becomes one character; a text without words stays as it is
    marked = F.regexp_replace(text, f"{OTHER}*+{WORD}++(?:{OTHER}++\\z)?", "x")
    rows = rows.withColumn("__words", F.when(text.rlike(WORD), F.length(marked)).otherwise(0).cast("long"))

    base_gate = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in phrase.split())) for _, phrase in PHRASES))
    base = _flat([matches(text, F.lit(phrase_regex(phrase)), {"label": F.lit(label)}) for label, phrase in PHRASES])
    rules = signatures()
    found = rows.select("__id", "__text", "__words", F.when(base_gate, base).alias("base"), F.when(_gate(low, sorted({root(r[2], r[4]) for r in rules})), F.lower(F.regexp_replace("__text", NOT_ASCII_WORD + "+", " "))).alias("__flat"))
    found = found.withColumn("places", F.when(flat.isNotNull(), rule_places(text, flat, rules)))
    kept = found.withColumn("detections", F.when(F.size("places") > 0, unsuppressed(F.col("places"), sorted({r[1] for r in rules})))).withColumn("starts", F.transform("base", lambda m: m["s"]))
    names = F.transform(F.coalesce("base", F.filter("base", lambda _: F.lit(False))), lambda m: m["label"])
    some = F.size(F.coalesce("starts", F.array().cast("array<int>"))) > 0
    empty = F.array().cast("array<string>")

    def word_at(start: Column) -> Column:
        return F.when(some, F.regexp_count(F.substring("__text", F.lit(1), start), F.lit(f"{WORD}+")).cast("long"))

    return kept.select(
        F.col("__id").alias(id_col),
        F.col("__words").alias("n_words"),
        F.when(some, F.size("starts")).otherwise(0).cast("long").alias("n_base"),
        word_at(F.array_min("starts")).alias("first_word"),
        word_at(F.array_max("starts")).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.coalesce(names, empty))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(names, empty), F.coalesce(F.transform("detections", lambda d: d["label"]), empty)))), ",").alias("labels"),
        F.when(some, 1.0).otherwise(F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])) / 100.0, F.lit(0.0))).cast("double").alias("score"),
        "detections",
    )
