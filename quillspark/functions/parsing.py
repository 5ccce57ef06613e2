"""Parsing of list literals, scores, JSON replies and packed vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import settings as S
from quillspark.functions.text import first_filled, or_empty, strip

# Intents, and the accepted alias.
INTENTS = (
    "LEGAL_LOOKUP", "COMPARE", "SUMMARIZE", "PROCEDURE", "DEFINITION", "MULTI_HOP", "CHITCHAT",
)
INTENT_ALIAS = ("LEGAL_QUERY", "LEGAL_LOOKUP")


def parse_ids(c: Column) -> Column:
    """``[1, 2]``, ``[1 2]`` or ``7`` to an array of LONG; empty when there is no digit."""
    digits = F.regexp_extract_all(or_empty(c), F.lit(r"(\d+)"), F.lit(1))
    return F.transform(digits, lambda d: d.cast("long"))


def parse_context(c: Column) -> Column:
    """A list literal of texts joined by blank lines; any other text unchanged."""
    raw = strip(or_empty(c))
    items = F.from_json(raw, "array<string>", {"allowSingleQuotes": "true"})
    kept = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.when(raw.startswith("[") & items.isNotNull(), F.array_join(kept, "\n\n")).otherwise(raw)


def sanitize_score(c: Column) -> Column:
    """Judge score clamped to 1..5; 0 for missing, invalid or non-positive values."""
    x = c.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x <= 0), F.lit(0.0)).otherwise(
        F.least(F.greatest(x, F.lit(1.0)), F.lit(5.0))
    )


def positive_mean(*cols: Column) -> Column:
    """Mean of the positive values of a row, 0 when there is none."""
    kept = F.filter(F.array(*cols), lambda x: x > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0))


def embedded_json(c: Column) -> Column:
    """The whole text when it is a JSON object, else its first braced part, else null."""
    whole = F.from_json(c, "map<string,string>")
    part = F.nullif(F.regexp_extract(c, r"(\{[\s\S]*?\})", 1), F.lit(""))
    return F.when(whole.isNotNull(), c).when(F.from_json(part, "map<string,string>").isNotNull(), part)


def unfence(c: Column) -> Column:
    body = strip(or_empty(c))
    opened = F.regexp_replace(body, r"^```(?:json)?\n?", "")
    return F.when(body.startswith("```"), F.regexp_replace(opened, r"\n?```$", "")).otherwise(body)


def _texts(obj: Column, key: str, cap: int) -> Column:
    """A JSON list field as texts; any other type counts as the empty list."""
    raw = F.try_element_at(obj, F.lit(key))
    items = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    return F.slice(F.coalesce(items, F.array().cast("array<string>")), F.lit(1), F.lit(cap))


def parse_reply(raw: Column, query: Column) -> Column:
    """Router reply to a struct; damaged JSON degrades to a lookup of the original question."""
    clean = unfence(raw)
    obj = F.when(clean.startswith("{"), F.from_json(clean, "map<string,string>"))
    name = F.upper(F.coalesce(F.try_element_at(obj, F.lit("intent")), F.lit("LEGAL_LOOKUP")))
    intent = F.when(name.isin(*INTENTS), name).otherwise(F.lit(INTENT_ALIAS[1]))
    refined = first_filled(strip(F.try_element_at(obj, F.lit("refined_query"))), query)
    confidence = F.coalesce(
        F.try_element_at(obj, F.lit("confidence")).try_cast("double"),
        F.lit(S.MODEL_DEFAULT_CONFIDENCE),
    )
    none = F.array().cast("array<string>")
    ok = obj.isNotNull()
    return F.struct(
        F.when(ok, intent).otherwise(F.lit("LEGAL_LOOKUP")).alias("intent"),
        F.when(ok, refined).otherwise(query).alias("refined_query"),
        F.when(ok, confidence).otherwise(F.lit(S.PARSE_ERROR_CONFIDENCE)).alias("confidence"),
        F.when(ok, F.lit("llm")).otherwise(F.lit("fallback")).alias("source"),
        F.when(ok, _texts(obj, "expanded_queries", S.EXPANSION_CAP)).otherwise(none).alias("expanded_queries"),
        F.when(ok, _texts(obj, "sub_entities", S.SUB_ENTITY_CAP)).otherwise(none).alias("sub_entities"),
    )


def parse_sparse(indices: Column, values: Column) -> Column:
    """Sparse vector struct from two JSON arrays; null when damaged, empty or uneven."""
    i = F.from_json(indices, "array<int>")
    v = F.from_json(values, "array<float>")
    return F.when(
        (F.size(i) > 0) & (F.size(i) == F.size(v)), F.struct(i.alias("indices"), v.alias("values"))
    )


def split_by_role(messages: Column) -> Column:
    """System messages first, then the other messages, each in their order."""
    return F.concat(
        F.filter(messages, lambda m: m["role"] == "system"),
        F.filter(messages, lambda m: m["role"] != "system"),
    )
