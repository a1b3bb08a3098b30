"""Actions of replies, matches of patterns and the places of anchors, case by case."""

import json
import random
import re

from pyspark.sql import functions as F

from evalgrain.functions import replies
from evalgrain.operators import geo, pages, trajectory

ALL = ("search", "search_many", "open", "open_many", "find", "geo_search", "ask_external_model", "note", "final")


def plain_object(text):
    """The first object that a JSON decoder finds."""
    bare = re.sub(r"\s*```\s*$", "", re.sub(r"(?i)^\s*```(?:json)?\s*", "", text or ""))
    for k, c in enumerate(bare):
        if c == "{":
            try:
                return json.JSONDecoder().raw_decode(bare[k:])[0]
            except json.JSONDecodeError:
                continue
    return None


def test_first_json_object(spark):
    texts = [
        'I do {"action":"search","query":"a"} then {"x":1}', 'use {braces} {"action":"search","query":"b"}', '{...} }{"action":"note","text":"}{"}', '{"action":"note","text":"quote \\" and } inside"} tail }',
        '{"action":"open","url":"cut', "no braces", "", None, "{}", "{", "}{", '```json\n{"a": {"b": [1, {"c": "}"}]}}\n```', '"{" {"a":1}', 'say "{ {"a":2}', '[{"a":1}]', "{'a':1}", '{"a":1,}{"b":2}', '{"é":"{日}"} x', '  {"a":1}  ',
    ]
    rng = random.Random(3)
    texts += ["".join(rng.choice(['{"a":', "}", "{", '"x"', ":1", '"', "\\\\", " ", '{"a":1}', ","]) for _ in range(12)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", replies.first_json_object(F.col("t")).alias("o"))
    got = {r.k: None if r.o is None else json.loads(r.o) for r in df.collect()}
    assert got == {k: plain_object(t) for k, t in enumerate(texts)}


def test_payload_rules(spark):
    good = [
        {"action": " Search ", "query": "a"}, {"action": "search_many", "queries": ["a", "b"]}, {"action": "open", "url": "ftp"}, {"action": "open_many", "urls": ["x"]}, {"action": "find", "url": "", "pattern": ""},
        {"action": "geo_search", "anchors": [{"query": "a", "expected_distance_miles": 500}, {"query": "b", "expected_distance_miles": None}]}, {"action": "note", "text": "n"}, {"action": "final", "exact_answer": ""},
        {"action": "final", "exact_answer": "x", "confidence": "50"}, {"action": "ask_external_model", "query": "q"}, {"action": "ask_external_model", "requests": [{"query": "q"}] * 4},
    ]
    bad = [
        {"action": "search", "query": " "}, {"action": "search", "query": 3}, {"action": "search", "queries": ["a"]}, {"action": "search_many", "queries": []}, {"action": "search_many", "queries": ["a", " "]},
        {"action": "search_many", "queries": ["a", 1]}, {"action": "search_many", "queries": "a"}, {"action": "open"}, {"action": "open_many", "urls": [None]}, {"action": "find", "url": "u"}, {"action": "geo_search", "anchors": []},
        {"action": "geo_search", "anchors": [{"query": "a"}] * 5}, {"action": "geo_search", "anchors": [{"query": "a", "expected_distance_miles": 501}]}, {"action": "geo_search", "anchors": ["a"]},
        {"action": "geo_search", "anchors": [{"query": "a", "expected_distance_miles": True}]}, {"action": "note"}, {"action": "final"}, {"action": "final", "exact_answer": "x", "confidence": 101},
        {"action": "final", "exact_answer": "x", "confidence": "much"}, {"action": "ask_external_model"}, {"action": "ask_external_model", "query": "q", "requests": [{"query": "q"}]}, {"action": "dance"}, {"query": "a"}, {},
    ]
    rows = [(k, json.dumps(x)) for k, x in enumerate(good + bad)]
    out = trajectory.parse_actions(spark.createDataFrame(rows, "k int, text string"), ALL).orderBy("k").collect()
    assert [r.invalid is None for r in out] == [True] * len(good) + [False] * len(bad)
    assert out[0].action == "search" and json.loads(out[0].payload) == good[0]


def test_find_places_empty_matches_and_plain_text(spark):
    texts = ["baacaa", "f(x) (y", "a\ue000a\ue001", "", None, "no", "aé" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pattern, plain in (("a*", "a*"), ("(", re.escape("(")), (r"(?<=a)a|(?=c)", r"(?<=a)a|(?=c)"), ("[", re.escape("[")), (r"x\E(", re.escape(r"x\E("))):
        out = sorted((int(r.key), r.place, r.offset, r.found, r.context) for r in pages.find_in_pages(df, pattern).collect())
        found = lambda t, p=plain: list(re.finditer(p, t, re.I))[:20]
        wanted = [(k, n, m.start(), m.group(), t[max(0, m.start() - 500) : m.end() + 500]) for k, t in enumerate(texts) if t is not None for n, m in enumerate(found(t), start=1)]
        assert out == wanted


def plain_routes(near, expected, most, pool, nearest):
    out = set()
    for a, e in expected.items():
        rows = sorted((d, p) for x, p, d in near if x == a)
        if e is None:
            kept = rows[:most]
        elif len(rows) <= pool:
            kept = rows
        else:
            kept = rows[:nearest] + sorted(rows[nearest:], key=lambda r: (abs(r[0] - e * 0.8), *r))[: pool - nearest]
        out |= {(a, p) for _, p in kept}
    return out


def test_route_candidates_equal_the_sorted_lists(spark):
    rng = random.Random(2)
    expected = {1: None, 2: 3.0, 3: 5.0, 4: 1.0}
    near = [(a, p, round(rng.random() * 9, 2)) for a, n in ((1, 50), (2, 20), (3, 60), (4, 21)) for p in range(n)]
    n = spark.createDataFrame(near, "anchor_id int, place_id int, straight_line_miles double").repartition(6)
    a = spark.createDataFrame(list(expected.items()), "anchor_id int, expected_distance_miles double")
    out = geo.route_candidates(n, a, 12, pool=20, nearest=6)
    assert {(r.anchor_id, r.place_id) for r in out.collect()} == plain_routes(near, expected, 12, 20, 6)
    assert out.count() == len(plain_routes(near, expected, 12, 20, 6))
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
