"""Queries of the smaller parts: wide candidate lists, checks, sinks, look-ups and answer rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrain.operators import consensus, discovery, evidence, fusion, leaks, ledger, planning, trajectory
from evalgrain.plans.fixtures import table, trials, with_trials
from evalgrain.plans.log_queries import _ANCHORS, _content, _NOVEL, _questions, _turns
from evalgrain.plans.registry import query
from evalgrain.plans.text_queries import _LINES, _log_lines
from evalgrain.sources import trial_logs
from evalgrain.sources.scratch import scratch_path
from evalgrain.streaming import live

_pick = lambda k, *values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (k + 1).cast("int"))


@query("win_02_wide", """WITH p AS (SELECT page_id, page_id // 20 AS query_id, page_id % 3 AS list, page_id % 4 AS part, url FROM pages),
 c AS (SELECT query_id, part, CASE WHEN part < 2 THEN row_number() OVER (PARTITION BY query_id, part, list ORDER BY page_id) WHEN part = 2 THEN page_id ELSE list END AS place, CASE WHEN part < 2 THEN list WHEN part = 2 THEN 0 ELSE 0 END AS o, split_part(url, '#', 1) AS url FROM p),
 k AS (SELECT query_id, regexp_replace(lower(url), '/+$', '') AS key, min((part, place, o)) AS first_at, arg_min(url, (part, place, o)) AS url FROM c GROUP BY ALL), u AS (SELECT query_id, key, min(first_at) AS first_at, arg_min(url, first_at) AS url FROM k GROUP BY query_id, key),
 r AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY first_at) AS choice FROM u) SELECT * FROM r WHERE choice <= 12""")  # fmt: skip
def wide_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") / 20).cast("long").alias("query_id"), (F.col("page_id") % 3).alias("list"), F.col("page_id").alias("rank"), "url", (F.col("page_id") % 4).alias("part"))
    said = p.where("part = 3").groupBy("query_id", "list", "rank").agg(F.concat(F.lit("see ("), F.max("url"), F.lit("), then")).alias("text")).drop("rank")
    return fusion.wide_candidates(p.where("part = 0"), p.where("part = 1"), p.where("part = 2"), said, 12)


@query("win_01_failed_lists", "SELECT page_id % 10 AS query_id, 'all lists failed' AS error FROM pages GROUP BY 1 HAVING NOT bool_or(page_id % 3 = 0 AND page_id % 10 < 6)")
def failed_lists(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    lists = p.select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("list"), ((F.col("page_id") % 3 == 0) & (F.col("page_id") % 10 < 6)).alias("ok"))
    return fusion.list_status(lists)


@query("win_05_redundant_streaks", f"""WITH RECURSIVE {_NOVEL}, a AS (SELECT r.conv_id, r.pos, redundant, role || '|' || text AS act FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n),
 l AS (SELECT *, last_value(CASE WHEN NOT redundant THEN act END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a), g AS (SELECT *, redundant OR coalesce(last = act, false) AS again FROM l),
 i AS (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS island FROM g) SELECT conv_id, pos AS step, CAST(sum(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, island ORDER BY pos) AS BIGINT) AS streak FROM i""")
def redundant_streaks(spark, sf_dir):
    """Turns are searches for what is said; a turn whose query repeats, or nearly repeats, an earlier one goes on with a streak."""
    t = _turns(spark, sf_dir).select("conv_id", F.col("pos").alias("step"), F.col("role").alias("action"), F.col("content").alias("payload"))
    return trajectory.redundant_streaks(t, t.select("conv_id", F.col("step").alias("pos"), "step", F.col("payload").alias("query")), "conv_id").select("conv_id", "step", "streak")


@query("win_07_clipped", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN least(event_id % 4, event_id % 6 + 1) END AS n FROM events")
def clipped(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.sequence(F.lit(0), F.col("event_id") % 6).alias("queries"))
    return trajectory.clip_batches(e, F.col("event_id") % 4).select("event_id", F.when(F.col("queries").isNotNull(), F.size("queries")).alias("n"))


@query("win_14_latest_search", "SELECT user_id AS trace_id, max(event_id) AS seq, 'r' || max(event_id) AS result FROM events WHERE event_type = 'click' GROUP BY user_id")
def latest_search(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "open").otherwise("search").alias("action"), (F.col("event_type") == "click").alias("ok"), F.concat(F.lit("r"), "event_id").alias("result"))
    return trajectory.latest_search(log)


@query("src_02_strict_lines", f"WITH {_LINES} SELECT event_id AS line_no, 'r' || event_id % 3 AS run_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status FROM l WHERE problem IS NULL")
def strict_lines(spark, sf_dir):
    good = trial_logs.parse_lines(_log_lines(spark, sf_dir)).where("problem IS NULL").select("source", "line_no")
    return trial_logs.strict_lines(_log_lines(spark, sf_dir).join(good, ["source", "line_no"], "left_semi")).select("line_no", "record.run_id", "record.status")


@query("src_03_csv_checks", """WITH n AS (SELECT row_number() OVER () - 1 AS i, trim(coalesce(text, '')) = '' OR trim(coalesce(lang, '')) = '' OR trim(coalesce(source, '')) = '' AS empty FROM documents), f AS (SELECT i FROM n WHERE empty ORDER BY i LIMIT 10), c AS (SELECT count(*) AS rows, count(*) FILTER (empty) AS bad FROM n)
 SELECT 'row_count' AS check, rows || ' rows, not 7' AS detail FROM c WHERE rows <> 7 UNION ALL SELECT 'empty_fields', bad || ' rows: ' || (SELECT string_agg(i, ', ' ORDER BY i) FROM f) FROM c WHERE bad > 0""")  # fmt: skip
def csv_checks(spark, sf_dir):
    return trial_logs.csv_checks(table(spark, sf_dir, "documents"), ("text", "lang", "source"), 7)


@query("src_08_manifest", "SELECT item_id, CASE WHEN item_id % 3 = 1 THEN 'changed' WHEN item_id % 3 = 2 THEN 'removed' END AS state FROM benchmark WHERE item_id % 3 > 0")
def manifest(spark, sf_dir):
    """Two trees of small files with one file for each item are written, read as manifests and compared."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("folder"), F.coalesce("text", F.lit("")).alias("value"))
    roots = [scratch_path(spark, "tree") for _ in range(2)]
    new = b.where("folder % 3 < 2").withColumn("value", F.when(F.col("folder") % 3 == 1, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    manifests = []
    for root, rows in zip(roots, (b, new), strict=True):
        rows.write.partitionBy("folder").text(root)
        found = leaks.file_manifest(spark, root, ("_SUCCESS",))
        manifests.append(found.select(F.regexp_extract("path", r"folder=(\d+)", 1).alias("path"), "sha256"))
    return leaks.manifest_changes(*manifests).select(F.col("path").cast("long").alias("item_id"), "state")


@query("snk_02_ledgers", with_trials(f""", p AS (SELECT count(DISTINCT subset_rank) AS n FROM trials), {_LINES.replace(" l AS", " l AS", 1)}
 SELECT 'ledgers' AS part, (SELECT n * 3 + 2 * (SELECT count(DISTINCT subset_rank) FROM trials WHERE status = 'completed' AND correct IS NOT NULL) FROM p) AS n UNION ALL SELECT 'unscored', count(*) FROM l WHERE NOT (problem IS NULL AND event_type <> 'error') UNION ALL SELECT 'quarantined', count(*) FROM l WHERE NOT (problem IS NULL AND event_id % 50 <> 7)
 UNION ALL SELECT 'summary', 5"""))  # fmt: skip
def ledger_files(spark, sf_dir):
    """All outputs of a campaign are written and counted as they are read back."""
    chosen, folder = ledger.ledgers(trials(spark, sf_dir)), scratch_path(spark, "campaign")
    trial_logs.write_ledgers(chosen, ledger.ledger_summary(chosen, 10_000), folder, trial_logs.parse_lines(_log_lines(spark, sf_dir)))
    parts = [spark.read.json(f"{folder}/{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k in ("ledgers", "unscored", "quarantined", "summary")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("snk_03_look_up", "SELECT event_id, event_type = 'view' AS hit, CASE WHEN event_type = 'view' THEN (SELECT max(CAST(e.event_id AS VARCHAR)) FROM events e WHERE e.event_type = 'view' AND e.event_id % 5 = events.event_id % 5) END AS response FROM events")
def look_up(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("namespace"), trial_logs.cache_key((F.col("event_id") % 5).cast("string")).alias("cache_key"))
    entries = trial_logs.latest_entries(e.where("namespace = 'view'").select("namespace", "cache_key", F.col("event_id").cast("string").alias("response"), F.lit("2024-01-01").alias("created_at")))
    return trial_logs.look_up(e, entries.drop("created_at")).select("event_id", "hit", "response")


@query("join_11_hints", "SELECT user_id AS item_id, 's' || user_id % 3 AS source_id, string_agg(hint, '|' ORDER BY n) AS hints FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS n FROM (SELECT user_id, event_type || left('xxxxxxxxxx', 3) AS hint, min(event_id) AS pos FROM events GROUP BY ALL)) WHERE n <= 3 GROUP BY user_id")
def hints(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("source_id"), F.col("event_id").alias("pos"), F.concat(F.lit(" "), "event_type", F.lit("xxx ")).alias("excerpt"))
    out = discovery.source_hints(e)
    return out.select("item_id", "source_id", F.array_join("hints", "|").alias("hints"))


@query("agg_18_opened", "WITH w AS (SELECT user_id AS item_id, max(event_id) AS r FROM events GROUP BY user_id) SELECT item_id, 'u' || r % 4 || ',u' || (r % 4 + 4) AS citations FROM w WHERE r % 4 > 0")
def opened_citations(spark, sf_dir):
    won = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item_id")).agg(F.max("event_id").alias("best_request"))
    e = table(spark, sf_dir, "events")
    url = lambda k: F.concat(F.lit("u"), F.col("event_id") % 4 + k)
    cited = e.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("request_id"), F.explode(F.array(url(0), url(4), url(100))).alias("url_key"))
    opened = e.select(F.col("user_id").alias("item_id"), F.explode(F.array(*[F.lit(f"u{k}") for k in (1, 2, 3, 5, 6, 7)])).alias("url_key"))
    return consensus.with_opened_citations(won, cited, opened).select("item_id", F.array_join("citations", ",").alias("citations"))


_ANSWERED = (
    ("Who wrote it?", "a famous author", True, ""), ("Who wrote it?", "the author who lived in the old town", True, ""), ("Who wrote it?", "Ada Holm, an author of books", False, ""),
    ("What year was it?", "the author", False, ""), ("Give a name that ends with the word “Bridge” please", "Old Bridge", False, ""), ("Give a name that ends with the word Bridge", "Old Tower", False, "ends with bridge"),
    ("It starts with the word “New” and ends with the word town", "Old town", False, "starts with new"), ("It begins with the word new", "", False, "starts with new"),
)


@query("txt_14_answer_rules", f"SELECT doc_id, [{', '.join(str(r).lower() for _, _, r, _ in _ANSWERED)}][doc_id % 8 + 1] AS restates, [{', '.join(repr(f) for *_, f in _ANSWERED)}][doc_id % 8 + 1] AS faults FROM documents")
def answer_rules(spark, sf_dir):
    k = F.col("doc_id") % len(_ANSWERED)
    asked, said = _pick(k, *[q for q, *_ in _ANSWERED]), _pick(k, *[a for _, a, *_ in _ANSWERED])
    return table(spark, sf_dir, "documents").select("doc_id", evidence.restates_category(asked, said).alias("restates"), F.array_join(evidence.surface_faults(asked, said), ",").alias("faults"))


_RUNGS = f"""{_ANCHORS}, n AS (SELECT *, CASE WHEN exact THEN '"' || anchor || '"' ELSE anchor END AS said FROM anchors),
 m AS (SELECT item_id, 1 AS rung, CASE WHEN exact THEN 0 ELSE 1 END AS a, place AS b, said AS query FROM n WHERE NOT exact OR len(regexp_extract_all(trim(regexp_replace(anchor, '\\s+', ' ', 'g')), '[A-Za-z0-9]+(?:[.''’-][A-Za-z0-9]+)*')) <= 7
  UNION ALL SELECT x.item_id, 2, x.place, y.place, x.said || ' ' || y.said FROM n x JOIN n y ON x.item_id = y.item_id AND x.place < y.place AND y.place <= 8 AND NOT list_has_any(x.low, y.low)
  UNION ALL SELECT item_id, 3, place, t.k, said || ' ' || t.term FROM n, (VALUES (0, 'official archive record'), (1, 'local directory')) t(k, term) WHERE place <= 5
  UNION ALL SELECT item_id, 1, 1048576, 0, 'site:example.org Northern Bridge Museum 1890' FROM q),
 v AS (SELECT item_id, rung, a, b, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS query FROM m), sets AS (SELECT *, list_sort(list_distinct(list_transform({_content("query")}, lambda w: lower(w)))) AS words FROM v),
 once AS (SELECT *, row_number() OVER (PARTITION BY item_id, rung, words ORDER BY a, b) AS nth FROM sets WHERE len(words) >= 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, rung ORDER BY a, b) AS place FROM once WHERE nth = 1)
 SELECT item_id, rung, left(query, 280) AS query, place FROM ranked WHERE place <= 7"""


@query("txt_19_rungs", f"WITH {_RUNGS}")
def query_rungs(spark, sf_dir):
    q = _questions(spark, sf_dir)
    terms = q.select("item_id", F.array(F.lit("official archive record"), F.lit("local directory")).alias("source_terms"))
    seeds = q.select("item_id", F.lit(1).alias("rung"), F.lit(0).alias("pos"), F.lit("site:example.org Northern Bridge Museum 1890").alias("query"))
    return planning.query_rungs(planning.anchors(q), terms, seeds)


@query("str_03_assigned", """WITH c AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'run_a' ELSE 'run_b' END AS run_id, count(*) AS finished, count(*) FILTER (event_type = 'purchase') AS correct, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS wrong FROM events GROUP BY 1)
 SELECT run_id, 5 AS pending, round(correct / finished, 6) AS accuracy_finished, round(correct / (correct + wrong), 6) AS accuracy_graded, round(correct / (finished + 5), 6) AS accuracy_assigned FROM c""")  # fmt: skip
def assigned(spark, sf_dir):
    t = trials(spark, sf_dir).select("run_id", "status", "correct")
    counts = live.counters(t)
    out = live.with_assigned(counts, counts.select("run_id", (F.col("finished") + 5).alias("assigned")))
    return out.select("run_id", "pending", *[F.round(c, 6).alias(c) for c in ("accuracy_finished", "accuracy_graded", "accuracy_assigned")])


@query("str_06_unified", """SELECT user_id AS run_id, CASE WHEN user_id % 2 = 0 THEN n ELSE n + 1 END AS done, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 0 END AS failed, CASE WHEN user_id % 2 = 0 THEN 7 ELSE 0 END AS remaining, CASE WHEN user_id % 2 = 0 THEN 'running' ELSE 'completed' END AS state FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""")
def unified(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n"))
    even = F.col("run_id") % 2 == 0
    rows = e.select("run_id", F.when(even, F.col("n")).alias("completed"), F.when(~even, F.col("n") + 1).alias("finished_items"), F.when(~even, F.col("n") + 1).alias("current_records"), F.lit(None).cast("array<int>").alias("done"), F.when(even, 2).alias("failed"),
                    F.when(even, 7).alias("remaining"), F.when(even, "running").alias("state"), F.lit("t").alias("updated_at"), F.when(~even, F.col("n") + 1).alias("target_total_questions"))
    return live.unify_status(rows).select("run_id", "done", "failed", "remaining", "state")


@query("str_02_append_new", "SELECT user_id FROM events WHERE user_id % 3 > 0 GROUP BY user_id")
def append_new(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id")
    return live.append_new(e, e.where("user_id % 3 = 0"), ("user_id",))


@query("top_02_page_score", "SELECT page_id, round(CASE WHEN page_id % 2 = 0 THEN 35.0 + 80.0 ELSE 0.0 END + 3.0 * least(page_id % 20, 12) + 2.0 * least(page_id % 25, 18) + least(page_id * 7, 30000) / 10000.0 - 0.35 * least(greatest(page_id % 30 - 1, 0), 20), 6) AS score FROM pages")
def page_score(spark, sf_dir):
    p, even = table(spark, sf_dir, "pages"), F.col("page_id") % 2 == 0
    base = fusion.hit_score(even, F.col("page_id") % 20, F.col("page_id") % 30, F.lit(0.0))
    return p.select("page_id", F.round(fusion.page_score(base, even, F.col("page_id") % 25, F.col("page_id") * 7), 6).alias("score"))
