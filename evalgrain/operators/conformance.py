"""Logged tool calls, reviews and plans held against what they should be: repair of shapes, verdicts, step contracts, plan quality."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrain.functions.terms import words_array
from evalgrain.functions.texts import squeeze, truncate_middle

#: Tools that take one thing or several, with the names of both arguments.
PAIRED = (("search", "search_many", "query", "queries"), ("open", "open_many", "url", "urls"))


def canonical_calls(log: DataFrame, allowed: tuple[str, ...], name: str = "name", arguments: str = "arguments") -> DataFrame:
    """log with tool, canonical and repaired, or invalid: the reason why a row is no call.

    canonical: the arguments as JSON with sorted keys. A tool for one thing called with a list becomes the tool for several
    and the other way round; a single value under the list's name gets its own name. Null arguments are an empty object.
    """
    raw = F.coalesce(F.nullif(F.trim(arguments), F.lit("")), F.lit("{}"))
    rows = log.select("*", F.trim(F.coalesce(name, F.lit(""))).alias("_tool"), F.try_parse_json(raw).alias("_v"))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant")), F.lit("none"))
    tool, renamed = F.col("_tool"), F.lit(None).cast("string")
    for one, many, single, plural in PAIRED:
        lone = (F.col("_tool") == one) & (kind(single) == "none")
        tool = F.when(lone & kind(plural).startswith("ARRAY"), many).when((F.col("_tool") == many) & (kind(plural) == "none") & (kind(single) == "STRING"), one).otherwise(tool)
        renamed = F.when(lone & (kind(plural) == "STRING"), F.lit(plural)).otherwise(renamed)
    singles = F.create_map(*[F.lit(x) for _, _, single, plural in PAIRED for x in (plural, single)])
    fields = F.try_variant_get("_v", "$", "map<string,variant>")
    put = F.transform_keys(fields, lambda k, v: F.when(k == F.col("_renamed"), F.element_at(singles, k)).otherwise(k))
    canonical = F.when(F.col("_renamed").isNull(), F.to_json("_v")).otherwise(F.to_json(F.to_variant_object(put)))
    shaped = rows.withColumn("tool", tool).withColumn("_renamed", renamed)
    invalid = F.when(~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)), "no object").when(~F.col("tool").isin(*allowed), "unknown tool")
    repaired = (F.col("tool") != F.col("_tool")) | F.col("_renamed").isNotNull()
    return shaped.select(*log.columns, "tool", F.when(invalid.isNull(), canonical).alias("canonical"), repaired.alias("repaired"), invalid.alias("invalid"))


def _objects(text: str) -> list[dict]:
    """The JSON objects in a text in order of their beginnings, inner ones too."""
    found, read = [], json.JSONDecoder().raw_decode
    at = text.find("{")
    while at >= 0:
        try:
            found.append(read(text, at)[0])
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def embedded_objects(texts: pd.Series) -> pd.Series:
    """The JSON objects in texts, those within an object's explanation first; of a text with none, those after unescaping it."""

    def listed(text: str | None) -> list[str]:
        objects = _objects(text or "")
        if not objects and '\\"' in (text or ""):
            try:
                objects = _objects(json.loads(f'"{text[text.find("{") : text.rfind("}") + 1]}"'))
            except ValueError:
                objects = []
        inner = [y for x in objects if isinstance(x.get("explanation"), str) for y in _objects(x["explanation"])]
        return [json.dumps(x) for x in inner + objects]

    return pd.Series([listed(t) for t in texts], dtype=object)


#: Review verdicts, their other spellings, and how a verdict is said in plain text.
VERDICTS = ("PASS", "ON_TRACK", "CONTINUE", "BLOCK")
SAID_VERDICT = r"(?i)\bverdict\b[\s`*_\"']*[:=\-][\s`*_\"']*(PASS|ON[ _-]?TRACK|CONTINUE|BLOCK(?:ED)?)\b"


def _verdict(said: Column) -> Column:
    plain = F.regexp_replace(F.upper(F.trim(F.coalesce(said, F.lit("")))), "[ -]", "_")
    return F.when(plain == "BLOCKED", "BLOCK").otherwise(plain)


def review_verdicts(reviews: DataFrame, content: str = "content", ok: str = "ok", cut: int = 4_000) -> DataFrame:
    """reviews with verdict, stage, required (next actions), reason and usable.

    The verdict is that of the first JSON object with one, objects inside explanations first; else that said in the text; else
    BLOCK with stage 'review_failed'. Only texts with a brace go to Python, each distinct one once.
    """
    known = reviews.where(F.contains(content, F.lit("{"))).select(F.col(content).alias("_text")).distinct().withColumn("_objects", embedded_objects("_text"))
    rows = reviews.join(known, F.col(content) == F.col("_text"), "left")
    at = lambda x, k: F.get_json_object(x, f"$.{k}")
    first = F.try_element_at(F.filter("_objects", lambda x: _verdict(at(x, "verdict")).isin(*VERDICTS)), F.lit(1))
    said = F.nullif(F.regexp_extract(F.coalesce(content, F.lit("")), SAID_VERDICT, 1), F.lit(""))
    rows = rows.withColumn("_first", first).withColumn("_said", F.when(_verdict(said) == "ONTRACK", "ON_TRACK").when(said.isNotNull(), _verdict(said)))
    verdict = F.coalesce(F.when(F.col("_first").isNotNull(), _verdict(at("_first", "verdict"))), "_said", F.lit("BLOCK"))
    stage = F.when(F.col("_first").isNotNull(), F.coalesce(at("_first", "observed_stage"), F.lit(""))).when(F.col("_said").isNotNull(), "textual_review_fallback").otherwise("review_failed")
    listed = F.coalesce(F.from_json(at("_first", "required_next_actions"), "array<string>"), F.array().cast("array<string>"))
    required = F.when(F.col("_first").isNotNull(), F.filter(listed, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")).when(F.col("_said").isNull() | (F.col("_said") == "BLOCK"), F.array(F.lit("next unmet requirement"))).otherwise(F.array().cast("array<string>"))
    reason = F.when(F.col("_first").isNotNull(), F.coalesce(at("_first", "reason"), F.lit(""))).otherwise(truncate_middle(F.coalesce(content, F.lit("")), cut))
    usable = F.coalesce(F.col(ok), F.lit(False)) & (F.col("_first").isNotNull() | F.col("_said").isNotNull())
    return rows.select(*reviews.columns, verdict.alias("verdict"), stage.alias("stage"), required.alias("required"), reason.alias("reason"), usable.alias("usable"))


_REQUEST = "struct<query:string,system:string,context:string,task_mode:string>"
PAYLOAD = f"query string, queries array<string>, url string, urls array<string>, anchors array<string>, requests array<{_REQUEST}>"


def _given(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")


def step_conformance(actions: DataFrame, contracts: DataFrame, key: list[str]) -> DataFrame:
    """key, conforms and fault (the first rule broken) of logged actions (key, action, payload as JSON) by the contracts of their steps.

    contracts: key, allowed_actions, minimum_batch_size, maximum_batch_size, required_request_task_mode, required_request_tags,
    required_urls, required_queries; null or empty parts ask for nothing, but an action must be allowed. An equi-join on the
    key; each rule is a column.
    """
    rows = actions.join(contracts, key, "left").withColumn("p", F.from_json("payload", PAYLOAD))
    action, requests = F.col("action"), F.col("p.requests")
    several = F.when(action == "search_many", F.size("p.queries")).when(action == "open_many", F.size("p.urls")).when(action == "geo_search", F.size("p.anchors")).when(action == "ask_external_model", F.size(requests))
    bound = lambda c: F.when(F.col(c) > 0, F.col(c))
    low, high = bound("minimum_batch_size"), bound("maximum_batch_size")
    batch_ok = (low.isNull() & high.isNull()) | (F.coalesce(several >= 0, F.lit(False)) & (several >= F.coalesce(low, F.lit(0))) & (several <= F.coalesce(high, several)))
    asks = (action == "ask_external_model") & (F.size(requests) > 0)
    mode = F.lower(F.trim(F.coalesce("required_request_task_mode", F.lit(""))))
    of_mode = lambda r: F.lower(F.trim(F.coalesce(r["task_mode"], F.lit("research")))) == mode
    mode_ok = (mode == "") | F.coalesce(asks & F.forall(requests, of_mode), F.lit(False))
    tags = F.transform(_given(F.col("required_request_tags")), lambda t: F.lower(F.trim(t)))
    held = F.transform(requests, lambda r: F.filter(tags, lambda t: F.contains(F.lower(F.concat_ws("\n", r["query"], r["system"], r["context"])), t)))
    one_each = F.forall(held, lambda t: F.size(t) == 1) & (F.size(F.array_except(tags, F.flatten(held))) == 0) & (F.size(requests) == F.size(tags))
    tags_ok = (F.size(tags) == 0) | F.coalesce(asks & one_each, F.lit(False))
    url = lambda x: F.lower(F.rtrim(F.trim(x), F.lit("/")))
    query = lambda x: F.lower(squeeze(x))
    within = lambda needed, one, many, plain: F.size(F.array_except(F.transform(_given(needed), plain), F.transform(F.concat(_given(F.array(one)), _given(many)), plain))) == 0
    rules = [
        ("action", F.coalesce(F.array_contains(F.transform(_given(F.col("allowed_actions")), lambda a: F.trim(a)), action), F.lit(False))), ("batch", batch_ok), ("task_mode", mode_ok), ("tags", tags_ok),
        ("urls", within(F.col("required_urls"), F.col("p.url"), F.col("p.urls"), url)), ("queries", within(F.col("required_queries"), F.col("p.query"), F.col("p.queries"), query)),
    ]
    fault = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])
    return rows.select(*key, fault.isNull().alias("conforms"), fault.alias("fault"))


# Words that name no particular thing, and words that say nothing in a query.
GENERIC_ENTITY_WORDS = (
    "a an actor actress answer artist author book boulevard candidate city company country event european film first guide"
    " institution interview interviewee location organization paper participant person place planner project publication"
    " question road researcher scientist second song start stop street student students subject the this time tour tuesday"
    " university urban website"
).split()
QUERY_STOPWORDS = "a an and at by for from in of on or the to with".split()
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAN = "queries array<string>, source_classes array<string>, discriminators array<string>, hypotheses array<string>"


def _word_set(text: Column, pattern: str, *without: list[str]) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), F.lower))
    return F.array_except(found, words_array(sorted({w for x in without for w in x})))


def candidate_names(hypotheses: Column) -> Column:
    """Up to five names that hypotheses speak of: quoted ones, else short hypotheses with a capital after the first word."""
    words = lambda c: F.regexp_extract_all(c, F.lit(f"[{_LETTERS}0-9'’-]+"), 0)
    generic = words_array(GENERIC_ENTITY_WORDS)

    def of(hypothesis: Column) -> Column:
        quoted = F.regexp_extract_all(hypothesis, F.lit("""['"]([^'"]{2,100})['"]"""), 1)
        few = F.when(F.size(F.split(hypothesis, r"\s+")) <= 10, F.array(hypothesis)).otherwise(F.array().cast("array<string>"))
        named = lambda c: F.exists(F.slice(words(c), 2, 10_000), lambda w: w.rlike(r"^\p{Lu}") & ~F.array_contains(generic, F.lower(w)))
        plain = lambda c: F.btrim(c, F.lit(" .,:;()[]{}"))
        fits = lambda c: F.size(words(c)).between(1, 10) & F.exists(words(c), lambda w: ~F.array_contains(generic, F.lower(w))) & (F.regexp_count(c, F.lit("[0-9]")) * 3 <= F.char_length(c))
        return F.filter(F.when(F.size(quoted) > 0, F.transform(quoted, plain)).otherwise(F.filter(F.transform(few, plain), named)), fits)

    return F.slice(F.array_distinct(F.flatten(F.transform(hypotheses, of))), 1, 5)


def plan_quality(plans: DataFrame, text: str = "text", source: str | None = None) -> DataFrame:
    """plans with fault: the first reason why a logged plan (JSON) is too thin, or null.

    2 to 5 hypotheses, of which two are concrete and (if `source` names the column of the task's text) bring new terms; 3 to 7
    distinct queries of 14 words at most; two named candidates tested, if two are named; two pairs of queries that share at
    most half of their terms; two source classes and two discriminators. The pairs are of at most 7 queries of one row.
    """
    span = F.coalesce(F.get_json_object(text, "$"), F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    rows = plans.withColumn("_p", F.from_json(span, PLAN))
    said = lambda c: F.transform(_given(F.col(f"_p.{c}")), squeeze)
    rows = rows.select("*", said("queries").alias("_q"), said("hypotheses").alias("_h"), _given(F.col("_p.source_classes")).alias("_s"), _given(F.col("_p.discriminators")).alias("_d"))
    rows = rows.withColumn("_names", candidate_names(F.col("_h")))
    rows = rows.withColumn("_terms", F.transform("_h", lambda h: _word_set(h, f"[{_LETTERS}0-9'’-]+", GENERIC_ENTITY_WORDS, QUERY_STOPWORDS)))
    rows = rows.withColumn("_sets", F.transform("_q", lambda q: _word_set(q, f"[{_LETTERS}0-9]+", QUERY_STOPWORDS)))
    rows = rows.withColumn("_named", F.filter(F.transform("_names", lambda n: _word_set(n, f"[{_LETTERS}]+", GENERIC_ENTITY_WORDS)), lambda t: F.size(t) > 0))
    concrete = F.greatest(F.size(F.filter("_terms", lambda t: F.size(t) >= 2)), F.size("_names"))
    tested = F.size(F.filter("_named", lambda n: F.exists("_sets", lambda q: F.size(F.array_intersect(q, n)) >= F.when(F.size(n) <= 2, 1).otherwise(2))))
    apart = lambda a, b: F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) * 2 <= F.size(F.array_union(a, b))).otherwise(False)
    pairs = F.aggregate(F.transform("_sets", lambda a, i: F.size(F.filter(F.col("_sets"), lambda b, j: (j > i) & apart(a, b)))), F.lit(0), lambda s, x: s + x)
    low = lambda c: F.size(F.array_distinct(F.transform(c, F.lower)))
    rules = [("no plan", F.col("_p.queries").isNotNull()), ("hypotheses", F.size("_h").between(2, 5)), ("concrete hypotheses", concrete >= 2)]
    if source is not None:
        clues = _word_set(F.col(source), f"[{_LETTERS}]+")
        rules.append(("new terms", (F.size(clues) == 0) | (F.size(F.filter("_terms", lambda t: F.size(F.array_except(t, clues)) > 0)) >= 2)))
    rules += [
        ("queries", F.size("_q").between(3, 7)), ("repeated queries", low(F.col("_q")) == F.size("_q")), ("long query", F.forall("_q", lambda q: F.regexp_count(q, F.lit(r"(?U)\w+")) <= 14)),
        ("untested candidates", (F.size("_named") < 2) | (tested >= 2)), ("similar queries", pairs >= 2), ("source classes", low(F.col("_s")) >= 2), ("discriminators", low(F.col("_d")) >= 2),
    ]
    fault = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])
    return rows.select(*plans.columns, fault.alias("fault"))
