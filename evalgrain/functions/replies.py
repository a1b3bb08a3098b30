"""JSON objects in models' replies, and the rules that an action's payload keeps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before a string or a brace, with it. Strings know their escapes, so braces in them don't count.
_TOKEN = r'(?s)[^"{}]*(?:"(?:[^"\\]|\\.)*"|[{}])'


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _closed(text: Column) -> Column:
    """text, which begins with a brace, up to the brace that closes it; null if none does."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(state: Column, token: Column) -> Column:
        end = F.right(token, F.lit(1))
        depth = state["depth"] + F.when(end == "{", 1).when(end == "}", -1).otherwise(0)
        new = F.struct(depth.alias("depth"), (state["size"] + F.length(token)).alias("size"), (depth == 0).alias("done"))
        return F.when(state["done"], state).otherwise(new)

    found = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), 0), start, step)
    return _let(found, lambda s: F.when(s["done"], F.substring(text, F.lit(1), s["size"])))


def _object(text: Column) -> Column:
    """text if it is a JSON object, else null."""
    return F.when(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT")), text)


def first_json_object(text: Column) -> Column:
    """The first JSON object in a text (fences about it allowed), as it stands there; null if there is none.

    Each opening brace in turn is tried up to the brace that closes it, until what lies between is an object: words in braces before it,
    braces in strings, further objects and text behind it do no harm; one that isn't closed is none.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)\A\s*```(?:json)?\s*", ""), r"\s*```\s*\z", "")
    none = F.lit(None).cast("string")

    def first(pieces: Column) -> Column:
        rest = lambda k: F.concat(F.lit("{"), F.array_join(F.slice(pieces, k, F.size(pieces)), "{"))
        tried = lambda found, k: F.when(found.isNotNull(), found).otherwise(_let(rest(k), lambda t: _object(_closed(t))))
        places = F.when(F.size(pieces) > 1, F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, none, tried)

    return _let(F.split(bare, r"\{", -1), first)


def _kind(body: Column, field: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")), F.lit("VOID"))


def _said(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def _text(body: Column, field: str, blank: bool = False) -> Column:
    """Whether a field is a string, and not a blank one."""
    return (_kind(body, field) == "STRING") & (F.lit(True) if blank else _said(F.get_json_object(body, f"$.{field}")))


def _texts(body: Column, field: str) -> Column:
    """Whether a field is a list of strings, none of them blank, and not empty."""
    return (_kind(body, field) == "ARRAY<STRING>") & F.forall(F.from_json(F.get_json_object(body, f"$.{field}"), "array<string>"), _said)


def _asked(body: Column, field: str, expected: bool = False) -> Column:
    """Whether a field is a list of one to four objects, each with a query (and, if there is one, an expected distance of 0 to 500)."""
    items = F.from_json(F.get_json_object(body, f"$.{field}"), "array<string>")

    def good(item: Column) -> Column:
        fine = F.coalesce(F.startswith(item, F.lit("{")), F.lit(False)) & _text(item, "query")
        if expected:
            kind, miles = _kind(item, "expected_distance_miles"), F.get_json_object(item, "$.expected_distance_miles").try_cast("double")
            fine &= (kind == "VOID") | (kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & F.coalesce(miles.between(0, 500), F.lit(False)))
        return fine

    return F.startswith(_kind(body, field), F.lit("ARRAY")) & F.coalesce(F.size(items).between(1, 4) & F.forall(items, good), F.lit(False))


def payload_fault(action: Column, body: Column) -> Column:
    """Why a JSON object (body) is no good payload of an action; null if it is one, or the action isn't known here."""
    level = F.get_json_object(body, "$.confidence")
    number = F.coalesce(level.try_cast("double").between(0, 100), F.lit(False)) & ~_kind(body, "confidence").rlike("^(ARRAY|OBJECT)")
    rules = {
        "search": [("no query", _text(body, "query"))],
        "search_many": [("no query", _texts(body, "queries"))],
        "open": [("no url", _text(body, "url"))],
        "open_many": [("no url", _texts(body, "urls"))],
        "find": [("no url or pattern", _text(body, "url", blank=True) & _text(body, "pattern", blank=True))],
        "geo_search": [("no anchors", _asked(body, "anchors", expected=True))],
        "ask_external_model": [("no single request", _text(body, "query") != _asked(body, "requests"))],
        "note": [("no text", _text(body, "text"))],
        "final": [("no answer", _text(body, "exact_answer", blank=True)), ("no confidence", (_kind(body, "confidence") == "VOID") | number)],
    }
    out = F.lit(None).cast("string")
    for name, checks in rules.items():
        for fault, good in reversed(checks):
            out = F.when((action == name) & ~good, fault).otherwise(out)
    return out
