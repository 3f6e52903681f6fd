"""Answers of language models: a cache of them, strict checks, and the rules where an answer doesn't hold.

Nothing is asked here. Answers are rows of text, and a text is one JSON object or it counts for nothing; it is read as a
variant, so the type of each field is that of the text, and no field is bent into shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extraction_rules import RULES
from .scoring import STAGES
from .state import upsert

# Closed lists of an answer's fields.
DIRECTIONS = ("positive", "negative", "neutral")
COUNTER = ("none", "partial", "high_uncertainty", "title_body_conflict")
METRIC_FIELDS = ("name", "value", "unit", "comparison_basis", "comparison_ratio", "evidence_id")
UNSUPPORTED = "unsupported_event_type"
TYPES = (*(r.name for r in RULES), UNSUPPORTED)
MODEL, RULED = "llm", "rules_fallback"
KEY = ("document_id", "model", "prompt_version")


def parsed(content: Column) -> Column:
    """A text that is one JSON object and nothing around it, as a variant; else null."""
    text = F.trim(F.coalesce(content, F.lit("")))
    value = F.when(~text.startswith("```"), F.try_parse_json(text))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _at(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def _number(value: Column, low: float, high: float, whole: bool = False) -> Column:
    kinds = "^BIGINT" if whole else "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"
    return _kind(value).rlike(kinds) & F.coalesce(F.try_variant_get(value, "$", "double").between(low, high), F.lit(False))


def _each(value: Column, test) -> Column:
    """A list of which every item passes a test."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return _kind(value).startswith("ARRAY") & F.coalesce(F.forall(items, test), F.lit(False))


def _listed(value: Column, names: Sequence[str]) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "string").isin(*names) & (_kind(value) == "STRING"), F.lit(False))


def holds(answer: Column, documents: Column | None = None, types: Sequence[str] = TYPES) -> Column:
    """Whether an answer has all its fields, of the right type, within their lists and bounds.

    documents: ids of the documents that an answer's evidence may come from, as an array; evidence that a model made
    itself begins with llm:. Booleans are no numbers, and 2.0 is no whole number.
    """
    metric = lambda m: _kind(m).startswith("OBJECT") & F.forall(F.array(*(_at(m, f).isNotNull() for f in METRIC_FIELDS)), lambda x: x)
    counter = lambda c: _kind(c).startswith("OBJECT") & _listed(_at(c, "kind"), COUNTER)
    named = lambda e: (_kind(e) == "STRING") & (F.try_variant_get(e, "$", "string") != "")
    tests = [
        answer.isNotNull(), _listed(_at(answer, "event_type"), types), _listed(_at(answer, "direction"), DIRECTIONS), _number(_at(answer, "certainty"), 0, 1), _number(_at(answer, "materiality_level"), 0, 4, whole=True),
        _number(_at(answer, "unexpectedness"), 0, 100), _number(_at(answer, "novelty"), 0, 100), _each(_at(answer, "metrics"), metric), _each(_at(answer, "counter_evidence"), counter), _each(_at(answer, "evidence_ids"), named),
        _kind(_at(answer, "positive_mechanism")).isin("MISSING", "VOID", "STRING"),
    ]
    if documents is not None:
        ids = F.try_variant_get(answer, "$.evidence_ids", "array<string>")
        tests.append(F.coalesce(F.forall(ids, lambda e: e.startswith("llm:") | F.array_contains(documents, F.substring_index(e, ":", 1))), F.lit(False)))
    whole = tests[0]
    for test in tests[1:]:
        whole = whole & test
    return F.coalesce(whole, F.lit(False))


def fields(answer: Column) -> Column:
    """struct of an answer's fields; the stage it doesn't name is the nearest by certainty, the surer one if two are."""
    get = lambda name, kind: F.try_variant_get(answer, f"$.{name}", kind).alias(name)
    certainty = F.try_variant_get(answer, "$.certainty", "double")
    away = F.array(*(F.struct(F.abs(F.lit(v) - certainty).alias("away"), F.lit(i).alias("i"), F.lit(k).alias("stage")) for i, (k, v) in enumerate(STAGES.items())))
    said = F.nullif(F.try_variant_get(answer, "$.certainty_stage", "string"), F.lit(""))
    return F.struct(
        get("event_type", "string"), get("direction", "string"), get("positive_mechanism", "string"), F.coalesce(said, F.array_min(away)["stage"]).alias("certainty_stage"), get("certainty", "double"), get("materiality_level", "int"),
        get("novelty", "double"), get("unexpectedness", "double"), get("evidence_ids", "array<string>"), F.coalesce(F.try_variant_get(answer, "$.no_valid_signal", "boolean"), F.lit(False)).alias("no_valid_signal"),
    )


def from_cache(documents: DataFrame, cache: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """documents (document_id, content_hash and others) with the column response: the answer kept for the document, model
    and prompt, if it was given to the same content; else null, and the document is to be asked about again."""
    kept = cache.where((F.col("model") == model) & (F.col("prompt_version") == prompt_version)).select("document_id", F.col("content_hash").alias("__hash"), F.col("response").alias("__response"))
    joined = documents.join(kept, "document_id", "left")
    return joined.withColumn("response", F.when(F.col("__hash") == F.col("content_hash"), F.col("__response"))).drop("__hash", "__response")


def to_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new answers, the latest of each document, model and prompt; both have KEY, content_hash, response
    and answered_at."""
    return upsert(cache, answers, KEY, "answered_at")


def with_fallback(asked: DataFrame, answers: DataFrame, ruled: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, columns, extractor): for each row asked about the answer that holds, else what the rules found.

    answers has the key, holds and the columns, ruled the key and the columns. Rows with neither are left out.
    """
    mine = answers.where("holds").select(*key, F.struct(*columns).alias("__answer"))
    rules = ruled.select(*key, F.struct(*columns).alias("__ruled"))
    both = asked.select(*key).distinct().join(mine, list(key), "left").join(rules, list(key), "left")
    best = both.withColumns({"__best": F.coalesce("__answer", "__ruled"), "extractor": F.when(F.col("__answer").isNotNull(), MODEL).otherwise(RULED)})
    return best.where("__best is not null").select(*key, "__best.*", "extractor")
