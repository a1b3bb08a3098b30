"""Logged calls, reviews, plans and guide tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalgrain.operators import conformance, guides
from evalgrain.plans.fixtures import rounded, table
from evalgrain.plans.registry import query
from evalgrain.sources.scratch import scratch_path

_K = "event_id % 8"


@query("txt_06_calls", f"""WITH e AS (SELECT event_id, {_K} AS k, 'q' || event_id AS q FROM events)
 SELECT event_id, CASE k WHEN 0 THEN 'search_many' WHEN 1 THEN 'search' WHEN 2 THEN 'search' WHEN 3 THEN 'open' WHEN 4 THEN 'open_many' WHEN 5 THEN 'open' WHEN 6 THEN 'dance' ELSE 'search' END AS tool,
  CASE k WHEN 0 THEN '{{"n":1,"queries":["' || q || '","b"]}}' WHEN 1 THEN '{{"query":"' || q || '"}}' WHEN 2 THEN '{{"query":"' || q || '","topic":"t"}}' WHEN 3 THEN '{{"url":"' || q || '"}}' WHEN 4 THEN '{{"urls":["' || q || '"]}}' WHEN 5 THEN '{{"a":null,"url":"' || q || '"}}' END AS canonical,
  k IN (0, 1, 3, 4) AS repaired, CASE k WHEN 6 THEN 'unknown tool' WHEN 7 THEN 'no object' END AS invalid FROM e""")  # fmt: skip
def calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k, q = F.col("event_id") % 8, F.concat(F.lit("q"), "event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("search", "search_many", " search ", "open", "open", "open", "dance", "search")]), (k + 1).cast("int"))
    shapes = ('{"queries": ["', '", "b"], "n": 1}'), ('{"query":"', '"}'), ('{ "topic":"t", "query":"', '"}'), ('{"urls":"', '"}'), ('{"urls":["', '"]}'), ('{"url":"', '","a":null}'), ('{"x":"', '"}'), ('["', '"]')
    arguments = F.element_at(F.array(*[F.concat(F.lit(a), q, F.lit(b)) for a, b in shapes]), (k + 1).cast("int"))
    log = e.select("event_id", name.alias("name"), arguments.alias("arguments"))
    return conformance.canonical_calls(log, ("search", "search_many", "open", "open_many")).select("event_id", "tool", "canonical", "repaired", "invalid")


@query("txt_15_reviews", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'PASS' WHEN 1 THEN 'ON_TRACK' WHEN 2 THEN 'BLOCK' WHEN 3 THEN 'CONTINUE' WHEN 4 THEN 'ON_TRACK' WHEN 5 THEN 'BLOCK' WHEN 6 THEN 'PASS' ELSE 'BLOCK' END AS verdict,
 CASE event_id % 8 WHEN 0 THEN 's' || event_id WHEN 4 THEN 'textual_review_fallback' WHEN 5 THEN 'textual_review_fallback' WHEN 7 THEN 'review_failed' ELSE '' END AS stage,
 CASE event_id % 8 WHEN 2 THEN 'do it,again' WHEN 5 THEN 'next unmet requirement' WHEN 7 THEN 'next unmet requirement' ELSE '' END AS required,
 CASE event_id % 8 WHEN 4 THEN '**Verdict**: on track ' || event_id WHEN 5 THEN 'verdict = Blocked' WHEN 7 THEN 'I {cannot} say' ELSE '' END AS reason, event_id % 8 <> 7 AND event_type <> 'error' AS usable FROM events""")  # fmt: skip
def reviews(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = (
        F.concat(F.lit('{"verdict":"pass","observed_stage":"s'), "event_id", F.lit('"}')), F.lit('Well: {"verdict": "on-track"} and {"verdict": "BLOCK"}'), F.lit('```json\n{"verdict":"Blocked","required_next_actions":["do it"," ","again"]}\n```'),
        F.lit('{"verdict":"PASS","explanation":"see {\\"verdict\\":\\"continue\\"}"}'), F.concat(F.lit("**Verdict**: on track "), "event_id"), F.lit("verdict = Blocked"), F.lit('reply: {\\"verdict\\": \\"PASS\\"}'), F.lit("I {cannot} say"),
    )
    rows = e.select("event_id", F.element_at(F.array(*said), (F.col("event_id") % 8 + 1).cast("int")).alias("content"), (F.col("event_type") != "error").alias("ok"))
    return conformance.review_verdicts(rows).select("event_id", "verdict", "stage", F.array_join("required", ",").alias("required"), "reason", "usable")


#: Actions with the contract of their step, and the rule that is broken (none: null); one for each branch.
_CONTRACTS = (
    ("search", '{"query":" Old  Bridge "}', {"allowed_actions": ["search"], "required_queries": ["old bridge"]}, None),
    ("open", "{}", {"allowed_actions": ["search", " "]}, "action"),
    ("search_many", '{"queries":["a","b"]}', {"allowed_actions": ["search_many"], "minimum_batch_size": 3}, "batch"),
    ("search_many", '{"queries":["a","b","c","d"]}', {"allowed_actions": ["search_many"], "maximum_batch_size": 3}, "batch"),
    ("search", '{"query":"a"}', {"allowed_actions": ["search"], "maximum_batch_size": 3}, "batch"),
    ("ask_external_model", '{"requests":[{"query":"x [one]"},{"query":"y","context":"[Two]"}]}', {"allowed_actions": ["ask_external_model"], "required_request_tags": ["[ONE]", "[two]"], "required_request_task_mode": "Research"}, None),
    ("ask_external_model", '{"requests":[{"query":"x","task_mode":"review"}]}', {"allowed_actions": ["ask_external_model"], "required_request_task_mode": "research"}, "task_mode"),
    ("ask_external_model", '{"requests":[{"query":"[one]"},{"query":"[one]"}]}', {"allowed_actions": ["ask_external_model"], "required_request_tags": ["[one]", "[two]"]}, "tags"),
    ("open_many", '{"urls":["https://A.org/x/","https://b.org"]}', {"allowed_actions": ["open_many"], "required_urls": ["https://a.org/x"]}, None),
    ("open", '{"url":"https://b.org"}', {"allowed_actions": ["open"], "required_urls": ["https://a.org/x"]}, "urls"),
    ("search", "{}", {"allowed_actions": ["search"], "required_queries": ["old bridge"]}, "queries"),
    ("geo_search", '{"anchors":["a","b"]}', {"allowed_actions": ["geo_search"], "minimum_batch_size": 2, "maximum_batch_size": 2}, None),
)
_CONTRACT = "step int, action string, payload string, contract struct<allowed_actions:array<string>,minimum_batch_size:int,maximum_batch_size:int,required_request_task_mode:string,required_request_tags:array<string>,required_urls:array<string>,required_queries:array<string>>"
_FAULTS = "[" + ", ".join("NULL" if f is None else f"'{f}'" for _, _, _, f in _CONTRACTS) + "]"


@query("txt_26_conformance", f"SELECT event_id, {_FAULTS}[event_id % {len(_CONTRACTS)} + 1] IS NULL AS conforms, {_FAULTS}[event_id % {len(_CONTRACTS)} + 1] AS fault FROM events")
def step_conformance(spark, sf_dir):
    cases = spark.createDataFrame([(k, a, p, c) for k, (a, p, c, _) in enumerate(_CONTRACTS)], _CONTRACT)
    log = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(_CONTRACTS)).alias("step")).join(cases, "step")
    return conformance.step_conformance(log.select("event_id", "action", "payload"), log.select("event_id", "contract.*"), ["event_id"])


_GOOD = ["Anna Berg designed bridges", "Carl Dahl wrote letters"], ["Anna Berg bridge archive", "Carl Dahl letters museum", "iron bridge 1890 opening"], ["news", "archive"], ["date", "place"]
#: Plans as (hypotheses, queries, source classes, discriminators) and the first fault of each.
_PLANS = (
    (_GOOD, None), ((_GOOD[0][:1], *_GOOD[1:]), "hypotheses"), ((["the film", "a song"], *_GOOD[1:]), "concrete hypotheses"), ((_GOOD[0], _GOOD[1][:2], *_GOOD[2:]), "queries"),
    ((_GOOD[0], [*_GOOD[1], "anna berg BRIDGE archive"], *_GOOD[2:]), "repeated queries"), ((_GOOD[0], [*_GOOD[1][:2], "w " * 15], *_GOOD[2:]), "long query"),
    ((_GOOD[0], ["Anna Berg bridge", "Anna Berg bridge old", "Anna Berg bridge new"], *_GOOD[2:]), "untested candidates"), ((["'Anna Berg' designed", "an 'Anna Berg' bridge"], ["Anna Berg bridge x", "Anna Berg bridge y", "Anna Berg bridge z"], *_GOOD[2:]), "similar queries"),
    ((*_GOOD[:2], ["news", "NEWS"], _GOOD[3]), "source classes"), ((*_GOOD[:3], ["date"]), "discriminators"),
)
_PLAN_FAULTS = "[" + ", ".join("NULL" if f is None else f"'{f}'" for _, f in _PLANS) + ", 'no plan']"


@query("txt_27_plans", f"SELECT event_id, {_PLAN_FAULTS}[event_id % {len(_PLANS) + 1} + 1] AS fault FROM events")
def plan_quality(spark, sf_dir):
    plan = spark.createDataFrame([(k, *p) for k, (p, _) in enumerate(_PLANS)], "k int, hypotheses array<string>, queries array<string>, source_classes array<string>, discriminators array<string>")
    said = plan.select("k", F.concat(F.lit("Plan: "), F.to_json(F.struct("hypotheses", "queries", "source_classes", "discriminators"))).alias("text"))
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % (len(_PLANS) + 1)).alias("k")).join(said, "k", "left").withColumn("text", F.coalesce("text", F.lit("none")))
    return conformance.plan_quality(rows).select("event_id", "fault")


_ASKS = ("Which award did the author of the study win?", "Which restaurant lies 3 miles from the monument?", "Who designed the cover?", "Which fire did the police report in an interview?")


def _asked(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    ask = F.element_at(F.array(*[F.lit(a) for a in _ASKS]), (F.col("item_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(a) for a in ("person", "place", "person", "number")]), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select("item_id", "text", ask.alias("question"), kind.alias("answer_type"), F.lit("Art").alias("topic"))


_TARGETS = (
    "official award databases and recipient archives|publisher and scholarly indexes|conference programs and professional biographies",
    "municipal heritage registers|maps, routing, and geospatial records|municipal and national geographic records|official venue histories and business profiles|local reporting and directories|war memorial and monument databases|local-history and event archives",
    "official or primary records|specialist databases|contemporary archives",
    "original publisher pages and PDFs|institutional publication archives|web archives and contemporary reporting|government incident records|local news archives|hospital and community records",
)
_TERMS = (
    "official award recipient archive|conference program proceedings presenter|study authors institutional profile",
    "official history founder|local business profile archive|heritage register monument restoration|war memorial inscription local history|map route distance municipal record",
    "art official archive record", "interview transcript inquiry guide archive|publication PDF credits archive|incident report local archive|hospital community record",
)
_pick = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "][item_id % 4 + 1]"


@query("txt_20_source_profile", f"SELECT item_id, {_pick(_TARGETS)} AS targets, {_pick(_TERMS)} AS terms FROM benchmark")
def source_profile(spark, sf_dir):
    out = guides.source_profile(_asked(spark, sf_dir))
    return out.select("item_id", F.array_join("source_targets", "|").alias("targets"), F.array_join("source_terms", "|").alias("terms"))


@query("txt_21_private_queries", """WITH b AS (SELECT item_id, item_id % 4 AS k FROM benchmark), f AS (SELECT item_id, unnest(['Ada Holm and Bo Lind', 'Ada Holm', 'Bo Lind', '10:30 am']) AS form, unnest([1, 2, 3, 4]) AS i FROM b),
 a AS (SELECT item_id, unnest(['old stone bridge', 'river town archive', 'north gate']) AS anchor, unnest([1, 2, 3]) AS j FROM b), q AS (SELECT item_id, '"' || form || '" ' || anchor AS query, 0 AS part, i, j FROM f JOIN a USING (item_id) UNION ALL SELECT item_id, 'old town register ' || item_id, 1, 0, 0 FROM b),
 p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY part, i, j) AS place FROM q) SELECT item_id, query, place FROM p WHERE place <= 12""")  # fmt: skip
def private_queries(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id")
    own = F.array(F.concat(F.lit("old town  register "), "item_id"), F.lit("the town"))
    records = b.select("item_id", F.array(F.lit(" Ada Holm and  Bo Lind"), F.lit("10:30 am"), F.lit("")).alias("aliases"), own.alias("queries"))
    anchors = b.select("item_id", F.posexplode(F.array(*[F.lit(x) for x in ("old stone bridge", "bridge", "river town archive", "north gate")])).alias("place", "anchor"))
    return guides.private_queries(records, anchors)


@query("txt_23_recovery", """WITH w AS (SELECT item_id, 'alpha' || item_id AS a FROM benchmark), q AS (SELECT item_id, 1 AS place, a || ' two three four five six seven eight 12-13 known as the keeper' AS query FROM w UNION ALL SELECT item_id, 2, '"known as the keeper"' FROM w
 UNION ALL SELECT item_id, 3, '"' || a || ' built the old mill"' FROM w WHERE item_id % 2 = 0) SELECT * FROM q""")  # fmt: skip
def recovery(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("alpha"), "item_id").alias("a"))
    hint = lambda text: F.concat("a", F.lit(text))
    last = F.when(F.col("item_id") % 2 == 0, hint(" built the old mill ${candidate}")).otherwise(hint(" built the Mill Street house ${candidate}"))
    texts = F.array(F.lit("no mark"), hint(" two three four five six seven eight ${candidate}, 12-13, known as the keeper"), last)
    hints = b.select("item_id", F.posexplode(texts).alias("pos", "hint"))
    return guides.recovery_queries(hints, b.select("item_id", F.array(F.lit("mill street"), F.lit("")).alias("names")))


@query("txt_24_templates", """WITH b AS (SELECT item_id FROM benchmark), q AS (SELECT item_id, unnest(['${candidate} bridge engineer', '"${candidate}" "iron gate of the old town wall near the river"', '"${candidate}" "north gate"']) AS query, unnest([1, 2, 3]) AS place FROM b), g AS (SELECT item_id, item_id % 2 = 0 AS geo FROM b)
 SELECT item_id, query, place, geo FROM q JOIN g USING (item_id)""")  # fmt: skip
def templates(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id")
    listed = lambda name, *values: b.select("item_id", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("pos", name))
    redacted = listed("query", "${candidate}  bridge engineer", "bridge engineer", "the ${candidate} name", "${CANDIDATE} x", "${candidate} Bridge Engineer")
    out = guides.verification_templates(redacted, listed("phrase", "iron gate of the old town wall near the river bend today", "gate", "north  gate", " "))
    constraints = b.select("item_id", F.when(F.col("item_id") % 2 == 0, "within 3 miles, walking").otherwise("a nearby town").alias("text"))
    return out.join(guides.needs_distances(constraints), "item_id")


@query("agg_21_preflight", """WITH s AS (SELECT o_orderkey AS item_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), f AS (SELECT count(*) FILTER (o_orderkey % 5 = 0) + count(*) FILTER (o_orderkey % 7 = 0) + count(*) FILTER (o_orderkey % 11 = 0) AS n FROM orders WHERE o_orderkey IN (SELECT item_id FROM s)),
 i AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 > 0) AS m FROM orders) SELECT i.n AS selected_items, i.m AS mapped_source_items, i.n - i.m AS route_only_items, (SELECT count(*) FROM s) AS attempt_variants, (SELECT min(n) FROM s) AS minimum_steps, (SELECT max(n) FROM s) AS maximum_steps, (SELECT round(avg(n), 3) FROM s) AS mean_steps, f.n AS faults, f.n = 0 AS passed FROM i, f""")  # fmt: skip
def preflight(spark, sf_dir):
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    items = o.select(F.col("o_orderkey").alias("item_id"), F.sequence(F.lit(0), F.col("o_orderkey") % 3).alias("sources")).withColumn("sources", F.slice("sources", 2, 5))
    last = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    key, is_last = F.col("l_orderkey"), F.col("l_linenumber") == last
    allowed = F.when(is_last & (key % 5 == 0), F.array(F.lit("search"))).when(is_last, F.array(F.lit("final"))).otherwise(F.array(F.lit("search")))
    steps = line.join(o.select("o_orderkey"), key == F.col("o_orderkey")).select(key.alias("item_id"), F.lit(1).alias("attempt"), F.col("l_linenumber").alias("pos"), F.lit("s").alias("step_id"), F.when(is_last & (key % 7 == 0), " ").otherwise("do").alias("instruction"), allowed.alias("allowed_actions"))
    return guides.guide_preflight(items, steps, guides.guide_faults(steps, items.where("item_id % 11 = 0")))


@query("agg_25_rates", """WITH r AS (SELECT user_id % 7 AS run_id, count(*) FILTER (event_type <> 'error') AS finished, count(*) FILTER (event_type = 'error') AS remaining, greatest(max(epoch(ts)) FILTER (event_type <> 'error') - min(epoch(ts)), 0.001) AS seconds FROM events GROUP BY 1)
 SELECT run_id, finished, remaining, round(finished / seconds * 3600, 4) AS items_per_hour, round(remaining / (finished / seconds), 2) AS eta_seconds FROM r""")  # fmt: skip
def rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("run_id"), F.col("ts").cast("timestamp").alias("started_at"), F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")).alias("finished_at"))
    return rounded(rounded(guides.finished_rates(e), "items_per_hour", digits=4), "eta_seconds", digits=2)


@query("snk_04_consolidated", "SELECT item_id || ':' || n AS value FROM benchmark, (SELECT unnest([1, 2]) AS n) WHERE item_id % 4 > 0")
def consolidated(spark, sf_dir):
    """Per-item files are written, read back and put together for the items that are listed."""
    b = table(spark, sf_dir, "benchmark")
    root = scratch_path(spark, "training")
    item = F.col("item_id").cast("string")
    b.select(item.alias("folder"), F.concat_ws("\n", F.concat(item, F.lit(":1")), F.lit(""), F.concat(item, F.lit(":2"))).alias("value")).write.partitionBy("folder").text(root)
    read = spark.read.text(root, wholetext=True).select(F.concat(F.lit("items/"), F.col("folder").cast("string"), F.lit(".jsonl")).alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return guides.consolidated(read, b.where("item_id % 4 > 0").select("item_id", F.col("item_id").alias("rank")))
