"""Nested and doubly encoded JSON: replies, canonical form."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from canvass.functions import let

FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"


def json_text(c: Column) -> Column:
    """A value that may be JSON within a JSON string, decoded up to twice, as JSON text; what does not decode stays."""
    inner = F.try_variant_get(F.try_parse_json(c), "$", "string")
    return F.when(strip_start(c) == '"', F.coalesce(inner, c)).otherwise(c)


def strip_start(c: Column) -> Column:
    return F.substring(F.ltrim(c), 1, 1)


def decoded(c: Column) -> Column:
    """A text that may hold JSON, decoded up to twice: what does not decode stays, blank is null; one JSON value of text, as JSON otherwise."""
    filled = lambda x: let(F.trim(x), lambda t: F.nullif(t, F.lit("")))

    def inner(x: Column) -> Column:
        return let(F.struct(x.alias("text"), F.try_parse_json(x).alias("v")), lambda s: F.when(F.schema_of_variant(s["v"]) == "STRING", F.try_variant_get(s["v"], "$", "string")).otherwise(s["text"]))

    return filled(let(filled(let(filled(c), inner)), inner))


def reply_object(raw: Column) -> Column:
    """(json, error) of a model reply: the first fenced body if any, else the text; if that is no JSON, from the first { to the last }."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    fenced = F.regexp_extract(text, FENCE, 1)
    body = F.when(text.rlike(FENCE), fenced).otherwise(text)
    cut = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    kind = lambda c: F.schema_of_variant(F.try_parse_json(c))
    whole, part = F.try_parse_json(body), F.try_parse_json(F.nullif(cut, F.lit("")))
    error = (
        F.when(text == "", "model reply is empty")
        .when(whole.isNotNull(), F.when(~kind(body).startswith("OBJECT"), "model reply JSON must be an object"))
        .when(cut == "", "model reply does not contain a JSON object")
        .when(part.isNull(), "model reply contains malformed JSON")
    )
    good = F.when(error.isNull(), F.when(whole.isNotNull(), body).otherwise(cut))
    return F.struct(good.alias("json"), error.alias("error"))


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces, for small driver documents."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the row as JSON with its keys in order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))).cast("binary"), 256)
