"""Rule extraction of events from documents, as regular-expression columns.

Documents are tested against the rules' headline gates in the scan; only hits go on. For each event, stock and type
the document of the best provider is weighed; the strongest type of a stock leads, the others stay as further facts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import text as X
from ..functions.places import after, before
from ..functions.places import few_matches as matches
from ..plans.session import cut, shared_dir
from . import extraction_rules as R
from .scoring import STAGES, materiality_level


#: Characters of a text's first line that stand for its title.
TITLE = 200


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _terminal_in(text: Column) -> Column:
    """A terminal word that is neither a risk warning, nor hypothetical, nor denied."""
    return text.rlike(R.TERMINAL) & F.exists(matches(text, F.lit(R.TERMINAL)), lambda m: ~F.contains(after(text, m["e"], 4), F.lit("风险")) & ~before(text, m["s"], 40).rlike(R.HYPOTHETICAL) & ~before(text, m["s"], 3).rlike(R.NOT_TERMINAL))


def terminal_state(text: Column, title: Column) -> Column:
    """True if the title, a stated decision or an unambiguous word near the event says that it ended or failed.

    Places are looked for only in texts with a match: most have none, and places take several searches.
    """
    decided = text.rlike(R.DECIDED) & F.exists(matches(text, F.lit(R.DECIDED)), lambda m: ~before(text, m["s"], 40).rlike(R.HYPOTHETICAL))

    def clear(m: Column) -> Column:
        around = F.concat(before(text, m["s"], 12), m["m"], after(text, m["e"], 12))
        near = F.concat(before(text, m["s"], 60), m["m"], after(text, m["e"], 40))
        other = (m["m"] == "失败") & before(text, m["s"], 8).rlike(R.TREATMENT) | (m["m"] == "未通过") & ~around.rlike(R.REVIEWED)
        return ~F.contains(after(text, m["e"], 4), F.lit("风险")) & ~other & near.rlike(R.ABOUT_EVENTS) & ~before(text, m["s"], 40).rlike(R.HYPOTHETICAL)

    return _terminal_in(title) | decided | ~title.rlike(R.PERIODIC) & text.rlike(R.CLEARLY_TERMINAL) & F.exists(matches(text, F.lit(R.CLEARLY_TERMINAL)), clear)


def direction(text: Column, title: Column) -> Column:
    return F.when(terminal_state(text, title), "negative").when(text.rlike(R.POSITIVE), "positive").when(text.rlike(R.NEGATIVE), "negative").otherwise("neutral")


def stage(text: Column) -> Column:
    """The common ladder of certainty; what matches nothing is a framework."""
    return F.when(text.rlike(R.EXECUTED), "executed").when(text.rlike(R.SIGNED), "signed").when(text.rlike(R.AWARDED), "awarded").when(text.rlike(R.RUMOR), "rumor").otherwise("framework")


def unexpectedness(beats: Column, first: Column, has_history: Column, progress: Column) -> Column:
    return F.when(beats, 100.0).when(first, 75.0).when(~has_history, 50.0).when(progress, 25.0).otherwise(0.0)


def novelty(has_history: Column, now: Column, then: Column) -> Column:
    """now and then: the amounts in order, as arrays."""
    return F.when(~has_history, 100.0).when((F.size(now) > 0) & (F.size(then) > 0) & (now != then), 60.0).otherwise(30.0)


def counter_evidence(title: Column, body: Column, periodic: Column) -> Column:
    """The kinds of counter-evidence: of hypothetical mentions only partial ones count; periodic reports only conflict."""

    def found(pattern: str, masked: bool) -> Column:
        real = F.exists(matches(body, F.lit(pattern)), lambda m: ~(before(body, m["s"], 40).rlike(R.HYPOTHETICAL) | m["m"].rlike(R.HYPOTHETICAL))) if masked else F.lit(True)
        return F.when(body.rlike(pattern), real).otherwise(title.rlike(pattern))

    kinds = F.array(
        F.when(title.rlike(R.POSITIVE) & found(R.CONFLICT, True), "title_body_conflict").otherwise(""),
        F.when(~periodic & found(R.UNCERTAIN, True), "high_uncertainty").otherwise(""),
        F.when(~periodic & found(R.PARTIAL, False), "partial").otherwise(""),
    )
    return F.array_remove(kinds, "")


def provider_rank(provider: Column, title: Column) -> Column:
    """Lower is better; opinions and audit reports come after all others."""
    return F.when(provider == "cninfo", 0).when(provider.isin("sse", "irm"), 1).otherwise(2) + F.when(title.rlike(R.AUXILIARY), 3).otherwise(0)


def _heads(body: Column, pattern: str) -> Column:
    return F.transform(matches(body, F.lit(pattern)), lambda m: m["s"])


def _rank(good: Column, other: Column, at: Column) -> Column:
    last = lambda heads: F.array_max(F.filter(heads, lambda s: s < at))
    return F.when(last(good).isNotNull() & (last(other).isNull() | (last(good) >= last(other))), 0).when(last(other).isNotNull(), 2).otherwise(1)


def section_rank(body: Column, at: Column) -> Column:
    """0 behind a heading on business or figures, 2 behind one of notes or risks, 1 before any; the nearest one counts."""
    return _rank(_heads(body, R.PREFERRED_SECTION), _heads(body, R.OTHER_SECTION), at)


def _figures(body: Column, places: Column, good: Column, other: Column) -> Column:
    about = F.filter(places, lambda m: m["m"].rlike(R.EARNINGS))
    best = F.array_min(F.transform(F.when(F.size(about) > 0, about).otherwise(places), lambda m: F.struct(_rank(good, other, m["s"]).alias("rank"), m["s"].alias("s"), m["e"].alias("e"))))
    return F.coalesce(F.substring(body, best["s"] + 1, best["e"] - best["s"] + 40), body)


def figures(body: Column, pattern: str) -> Column:
    """The mention of earnings in the best section, with the 40 characters behind it; other mentions only without one."""
    return _figures(body, matches(body, F.lit(pattern)), _heads(body, R.PREFERRED_SECTION), _heads(body, R.OTHER_SECTION))


def gate(rule: R.Rule, title: Column, body: Column) -> Column:
    """The headline gate: the pattern hits title and body, and neither exclusion hits."""
    test = title.rlike(rule.pattern) & body.rlike(rule.pattern)
    if rule.not_title:
        test = test & ~title.rlike(rule.not_title)
    return test


def _enough(rule: R.Rule, text: Column) -> Column:
    return reduce(lambda a, b: a & b, (text.rlike(p) for p in rule.needs), F.lit(True))


def _direction(rule: R.Rule, d: Column, text: Column, enough: Column) -> Column:
    """What a rule's own words make of the common direction."""
    if rule.makes_negative:
        d = F.when(text.rlike(rule.makes_negative) & ~text.rlike(rule.keeps), "negative").otherwise(d)
    if rule.positive:
        d = F.when((d == "neutral") & text.rlike(rule.positive), "positive").otherwise(d)
    if rule.makes_positive is not None:
        test = text.rlike(rule.makes_positive) & (~text.rlike(rule.unless) if rule.unless else F.lit(True)) & (enough if rule.needs else F.lit(True))
        d = F.when(test, "positive").otherwise(d)
    return d


def _weigh(rule: R.Rule, title: Column, body: Column, text: Column, periodic: Column, formal: Column) -> Column:
    # what doesn't depend on the rule is in columns of its own: see detect
    d, amount, kinds = F.col("d0"), F.col("amount0"), F.col("kinds0")
    ratio = F.col("ratio0")
    if rule.name == "earnings_upgrade":
        loss = periodic & (X.net_profit(body) < 0) & ~text.rlike(r"扭亏为盈|预盈")
        row = F.regexp_extract(body, r"((?:归母净利润|归属于上市公司股东的净利润|净利润|业绩|扭亏|预盈)[^\n]*)", 1)
        falls = F.when(ratio.isNotNull(), (ratio < 0) & ~body.rlike(r"扣非[^。；;\n]{0,30}" + rule.ratio)).otherwise(~F.contains(row, F.lit("扣非")) & (X.parse_percent(F.regexp_extract(row, r"[+-]?\d[\d,]*\.?\d*\s*%", 0)) < 0))
        d = F.when(F.coalesce(loss, F.lit(False)) | F.coalesce(falls, F.lit(False)), "negative").otherwise(d)
    enough = _enough(rule, text)
    d = _direction(rule, d, text, enough)
    by_text = F.coalesce(*(F.when(text.rlike(p), F.lit(level)) for p, level in rule.levels), F.when(amount.isNotNull(), F.lit(rule.level_with_amount).cast("int")), F.lit(rule.level))
    level = F.coalesce(F.col("level0"), by_text)
    if rule.qualitative:
        # the amount's own place is a second piece of evidence
        level = F.when((level > 2) & ~(formal & amount.isNotNull()), 2).otherwise(level)
    s = F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for p, v in rule.stages), F.col("stage0"))
    s = F.when(periodic, "executed").otherwise(s) if rule.name == "earnings_upgrade" else s
    more = [F.when(text.rlike(p), F.lit(k)) for p, k in rule.extra]
    if rule.framework_uncertain:
        more.append(F.when((s == "framework") & (F.size(kinds) == 0 if rule.needs else F.lit(True)), F.lit("high_uncertainty")))
    kinds = F.array_distinct(F.concat(kinds, F.filter(F.array(*more), lambda k: k.isNotNull()))) if more else kinds
    good = (d == "positive") & enough
    empty = F.array().cast("array<string>")
    return F.struct(
        F.lit(rule.name).alias("event_type"), d.alias("direction"), F.when(good, F.lit(rule.mechanism)).alias("mechanism"), s.alias("stage"),
        F.when(good, level).otherwise(0).cast("int").alias("level"), ratio.alias("ratio"), amount["yuan"].alias("amount"),
        F.when(enough, kinds).otherwise(empty).alias("counter"), F.regexp_extract(body, rule.pattern, 0).alias("hit"),
    )


def _by_rule(hits: DataFrame) -> DataFrame:
    """hits written with a folder for each rule, and read again: a rule's plan reads no other's."""
    path = f"{shared_dir(hits.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    hits.write.partitionBy("rule").parquet(path)
    return hits.sparkSession.read.schema(hits.schema).parquet(path)


def detect(documents: DataFrame, rules=R.RULES) -> DataFrame:
    """(event_id, stock_code, document_id, event_type, direction, mechanism, stage, certainty, level, ratio, amount, counter,
    evidence_id, excerpt, start, end) per event, stock and type, from rows of (event_id, stock_code, document_id,
    provider_key, title, body).

    Null titles and bodies count as empty; documents without a body report nothing.
    """
    title, body, text = F.col("title"), F.col("body"), F.col("text")
    rows = documents.withColumns({"title": _or_empty(F.col("title")), "body": _or_empty(F.col("body"))}).where(F.trim("body") != "").withColumn("text", F.concat(title, F.lit("\n"), body))
    # with -1 for no hit: a lambda in a filter would have all gates interpreted rather than compiled
    hits = F.array_remove(F.array(*(F.when(gate(r, title, body), F.lit(i)).otherwise(-1) for i, r in enumerate(rules))), -1)
    gated = rows.withColumn("rule", F.explode(hits))
    own = W.partitionBy("event_id", "stock_code", "rule").orderBy(provider_rank(F.col("provider_key"), title), "document_id")
    formal = F.max(F.col("provider_key").isin(*R.FORMAL)).over(W.partitionBy("event_id", "stock_code"))
    best = gated.withColumns({"__n": F.row_number().over(own), "formal": formal}).where("__n = 1")
    earnings = [i for i, r in enumerate(rules) if r.name == "earnings_upgrade"]
    is_earnings = F.col("rule").isin(*earnings or [-1])
    # columns of their own, one from the other: long expressions that are used many times aren't copied into each other
    best = best.withColumns({"places0": F.when(is_earnings, matches(body, F.lit(rules[earnings[0]].pattern))) if earnings else F.array().cast("array<struct<s: int, e: int, m: string>>"), "good0": F.when(is_earnings, _heads(body, R.PREFERRED_SECTION)), "other0": F.when(is_earnings, _heads(body, R.OTHER_SECTION))})
    best = best.withColumns({"d0": direction(text, title), "amount0": X.parse_amount(body), "stage0": stage(text), "kinds0": counter_evidence(title, body, title.rlike(R.PERIODIC) & is_earnings)})
    best = best.withColumn("source0", F.when(is_earnings, _figures(body, F.col("places0"), F.col("good0"), F.col("other0"))).otherwise(body) if earnings else body)
    ratios = [F.when(F.col("rule") == i, X.parse_percent(F.regexp_extract("source0", r.ratio, 0))) for i, r in enumerate(rules) if r.ratio]
    free, back = ([i for i, r in enumerate(rules) if test(r)] or [-1] for test in (lambda r: not r.ratio_needs_amount, lambda r: r.buyback))
    best = best.withColumn("ratio0", F.when(F.col("amount0").isNotNull() | F.col("rule").isin(free), F.coalesce(*ratios, F.lit(None).cast("double"))))
    best = best.withColumn("level0", F.when(F.col("rule").isin(back), materiality_level(F.col("ratio0"), True)).otherwise(materiality_level(F.col("ratio0"), False)))
    # one small plan a rule over its own folder of the stored hits, rather than one that holds the expressions of all
    best = _by_rule(best)
    found = None
    for i, rule in enumerate(rules):
        own = best.where(F.col("rule") == i)
        own = own.where(~text.rlike(rule.yields)) if rule.yields else own
        own = own.withColumn("d", _weigh(rule, title, body, text, title.rlike(R.PERIODIC), F.col("formal"))).select("event_id", "stock_code", "document_id", "title", "body", "rule", "d.*")
        own = own.where("direction = 'positive'") if rule.only_positive else own
        found = own if found is None else found.union(own)
    start = F.instr("body", F.col("hit")) - 1
    e = X.evidence_excerpt(body, start, start + F.length("hit"))
    certainty = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))[F.col("stage")]
    return found.withColumn("e", e).withColumn("certainty", certainty).select(
        "event_id", "stock_code", "document_id", "event_type", "direction", "mechanism", "stage", "certainty", "level", "ratio", "amount", "counter",
        F.substring(F.sha1(F.concat_ws(":", "document_id", "event_type", F.substring("e.excerpt", 1, 80))), 1, 16).alias("evidence_id"), "e.excerpt", "e.start", "e.end", "rule",
    )


def event_type_hint(documents: DataFrame, key: str, text: str, rules=R.RULES) -> DataFrame:
    """(key, hint): the first type in rule order that a text reports, with its first line as the title; null without one.

    A text is tested by itself, in the scan: neither shuffled nor weighed. Its direction is looked for only where a rule
    takes no other than positive events; only earnings that a rule takes so are weighed by detect.
    """
    if any(r.only_positive and r.name == "earnings_upgrade" for r in rules):  # whether earnings are positive depends on their figures
        rows = documents.select(F.col(key).cast("string").alias("event_id"), F.lit("").alias("stock_code"), F.col(key).cast("string").alias("document_id"), F.lit("cninfo").alias("provider_key"), F.substring(F.substring_index(F.col(text), "\n", 1), 1, TITLE).alias("title"), F.col(text).alias("body"))
        first = detect(rows, rules).groupBy("event_id").agg(F.min_by("event_type", "rule").alias("hint"))
        return documents.select(key).join(first, F.col(key).cast("string") == F.col("event_id"), "left").select(key, "hint")
    title, body, said = F.col("__title"), F.col("__body"), F.col("__said")
    rows = documents.select(key, _or_empty(F.col(text)).alias("__body")).withColumn("__title", F.substring(F.substring_index("__body", "\n", 1), 1, TITLE)).withColumn("__said", F.concat_ws("\n", "__title", "__body"))

    def reported(rule: R.Rule) -> Column:
        test = gate(rule, title, body)
        test = test & ~said.rlike(rule.yields) if rule.yields else test
        return test & (_direction(rule, direction(said, title), said, _enough(rule, said)) == "positive") if rule.only_positive else test

    return rows.select(key, F.when(F.trim("__body") != "", F.coalesce(*(F.when(reported(r), F.lit(r.name)) for r in rules))).alias("hint"))


def leading_facts(detections: DataFrame) -> DataFrame:
    """Each stock's strongest fact of an event: positive, then level, then certainty, then the first rule."""
    order = W.partitionBy("event_id", "stock_code").orderBy((F.col("direction") == "positive").desc(), F.desc("level"), F.desc("certainty"), F.asc("rule"))
    return detections.withColumn("__n", F.row_number().over(order)).withColumn("leads", F.col("__n") == 1).drop("__n")


def with_history(detections: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """detections with novelty and unexpectedness, from what their events and the older ones they resemble say.

    documents has (event_id, title, body), all of an event's and of those before it; links has (event_id,
    historical_event_id), at most one row for an event, null for none. An event's amounts are those of all its bodies.
    A resembled event whose documents are gone has no amounts. Texts are read once and leave an event's amounts and
    cues only; these are joined by event, so no event meets the history of its stock.
    """
    says = lambda pattern: F.concat_ws("\n", "title", "body").rlike(pattern)
    cues = {"beats": says(R.BEAT), "first": says(R.FIRST), "progress": says(R.PROGRESS)}
    read = documents.where("event_id is not null").select("event_id", X.amounts(_or_empty(F.col("body"))).alias("said"), *(v.alias(k) for k, v in cues.items()))
    events = cut(read.groupBy("event_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("said")))).alias("now"), *(F.bool_or(k).alias(k) for k in cues)))
    past = events.select(F.col("event_id").alias("historical_event_id"), F.col("now").alias("then"))
    known = events.join(links, "event_id", "left").join(past, "historical_event_id", "left")
    has, none = F.col("historical_event_id").isNotNull(), F.array().cast("array<string>")
    scored = known.select("event_id", "historical_event_id", novelty(has, F.col("now"), F.coalesce("then", none)).alias("novelty"), unexpectedness(F.col("beats"), F.col("first"), has, F.col("progress")).alias("unexpectedness"))
    return detections.join(scored, "event_id", "left")
