"""Cases with known answers."""

import re

import pytest
from pyspark.sql import functions as F

from evalgrain.functions import stats
from evalgrain.functions import terms as T
from evalgrain.functions import texts as X
from evalgrain.functions import urls as U
from evalgrain.operators import compare, conformance, consensus, containment, evidence, fusion, geo, grading, guides, leaks, ledger, metrics, pages, planning, trajectory
from evalgrain.schemas import TRIALS
from evalgrain.sources import trial_logs
from evalgrain.streaming import live


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def trial(**given):
    base = {"run_id": "r", "item_id": "a", "attempt": 1, "status": "completed", "correct": None, "metrics": {}, "citations": []}
    return base | given


def trials(spark, *rows):
    return spark.createDataFrame([trial(**r) for r in rows], TRIALS)


def test_errors_count_as_wrong_and_missing_metrics_as_zero(spark):
    t = trials(spark, {"correct": True, "confidence": 80.0, "metrics": {"duration_seconds": 4.0, "search_calls": 2}}, {"item_id": "b", "status": "error"})
    out = metrics.summarize(t, [*metrics.accuracy_columns(), *metrics.error_columns(), *metrics.rate_columns(), *metrics.duration_columns(), *metrics.cost_columns()])
    out = metrics.with_duration_quantiles(out, t).first()
    assert (out.n_records, out.n_graded, out.n_correct, out.accuracy, out.n_errors) == (2, 1, 1, 0.5, 1)
    assert (out.duration_mean, out.duration_median, out.zero_search_rate, out.cost_per_correct_usd) == (2.0, 2.0, 0.5, 0.0)
    cal = metrics.calibration(t).first()
    assert (cal.n, round(cal.brier, 6), round(cal.ece, 6)) == (1, 0.04, 0.2)


def test_no_graded_trial_gives_null_scores(spark):
    out = metrics.calibration(trials(spark, {"status": "error"})).first()
    assert (out.n, out.brier, out.ece) == (0, None, None)


def test_pass_at_k(spark):
    t = trials(spark, {"correct": False}, {"attempt": 3, "correct": True}, {"item_id": "b", "attempt": 1})
    assert [(r.k, r.pass_at_k) for r in metrics.pass_at_k(t).orderBy("k").collect()] == [(1, 0.0), (2, 0.0), (3, 0.5)]


def test_wilson_bounds(spark):
    low, high = stats.wilson_bounds(F.lit(9), F.lit(10))
    empty = stats.wilson_bounds(F.lit(0), F.lit(0))
    r = one(spark, low.alias("a"), high.alias("b"), empty[0].alias("c"), empty[1].alias("d"))
    assert (round(r.a, 4), round(r.b, 4), r.c, r.d) == (0.5958, 0.9821, 0.0, 0.0)


@pytest.mark.parametrize(("a", "b", "p"), [(0, 0, 1.0), (1, 1, 1.0), (0, 5, 0.0625), (2, 8, 0.109375), (900_000, 902_000, 0.1363)])
def test_sign_test(spark, a, b, p):
    assert one(spark, stats.exact_sign_pvalue(F.lit(a), F.lit(b)).alias("p")).p == pytest.approx(p, rel=2e-3)


def test_bootstrap_does_not_depend_on_partitioning_and_covers(spark):
    t = trials(spark, *[{"attempt": k, "correct": k % 4 > 0} for k in range(400)])
    a = metrics.bootstrap_accuracy(t.repartition(1), 2000).first()
    b = metrics.bootstrap_accuracy(t.repartition(7), 2000).first()
    assert a == b and a.bootstrap_low < 0.75 < a.bootstrap_high and a.bootstrap_high - a.bootstrap_low < 0.1


def test_paired_runs(spark):
    left = trials(spark, *[{"source_index": k, "correct": k < 6} for k in range(10)])
    right = trials(spark, *[{"source_index": k, "correct": k < 4} for k in range(2, 12)])
    pairs = compare.pair_runs(left, right)
    assert tuple(compare.key_overlap(pairs).first()) == (8, 2, 2)
    c = compare.contingency(pairs).first()
    assert (c.both_correct, c.left_only_correct, c.right_only_correct, c.both_wrong, c.pvalue) == (2, 2, 0, 4, 0.5)
    b = compare.paired_bootstrap(pairs, 500).first()
    assert 0 <= b.difference_low <= 0.25 <= b.difference_high


def test_lock_mismatches(spark):
    locks = spark.createDataFrame([("a", {"config.agent": "1", "config.run.seed": "0"}), ("b", {"config.agent": "2", "config.run.seed": "0"})], "run_id string, fields map<string,string>")
    out = compare.lock_mismatches(locks, "a", "b").first()
    assert (out.mismatches, out.compatible) == (["config.agent"], False)


def test_ledgers(spark):
    t = trials(
        spark, {"subset_rank": 1, "finished_at": "2024-01-01", "correct": False}, {"subset_rank": 1, "finished_at": "2024-01-02", "correct": True},
        {"subset_rank": 1, "finished_at": "2024-01-03", "status": "error"}, {"subset_rank": 2, "finished_at": "2024-01-01", "status": "timeout"}, {"subset_rank": None, "finished_at": "x"},
    )
    out = {(r.subset_rank, r.policy): r.finished_at for r in ledger.ledgers(t).collect()}
    assert out[1, "strict_first_terminal"] == "2024-01-01" and out[1, "best_observed_after_repair"] == "2024-01-02" and out[1, "latest_terminal"] == "2024-01-03"
    assert out[2, "best_observed_after_repair"] == "2024-01-01" and (2, "graded_first_completion") not in out
    s = {r.policy: r for r in ledger.ledger_summary(ledger.ledgers(t), 3).collect()}
    assert (s["strict_first_terminal"].incorrect, s["strict_first_terminal"].questions_without_terminal_record, s["latest_terminal"].subset_ranks) == (2, 1, "1,2")


@pytest.mark.parametrize(
    ("predicted", "reference", "same"),
    [("The Beatles", "beatles", True), ("1,000", "1000", True), ("1988-96", "1988-1996", True), ("1998-02", "1998-2002", True), ("5 p.m.", "5 pm", True), ("3.14159", "3.1416", True), ("A & B", "a and b", True),
     ("Republic of Korea v Japan", "Korea vs. Japan", True), ("Japan v Korea", "Korea v Japan", False), ("12 or 13", "12", False), ("cat", "dog", False)],
)
def test_equal_answers(predicted, reference, same):
    assert grading.equal_answers(predicted, reference) is same


def test_regrade_and_final_text(spark):
    rows = [("Exact Answer: Oslo", "oslo"), ("one\ntwo", "two"), ("So \\boxed{42} then\nConfidence: 130\nhttps://a.b/c. https://a.b/c", "42"), ("", "x"), (None, "x")]
    df = spark.createDataFrame(rows, "response string, reference string")
    assert {(r.response, r.correct) for r in grading.regrade(df).collect()} == {(a, a == "Exact Answer: Oslo") for a, _ in rows}
    out = grading.plain_final(df, "response").collect()[2]
    assert (out.answer, out.confidence, out.citations) == ("42", 100.0, ["https://a.b/c"])


def test_grader_output(spark):
    df = spark.createDataFrame([("extracted_final_answer: None\nreasoning: a\nb\ncorrect: YES",), ("nothing",)], "text string")
    a, b = grading.parse_grader(df).collect()
    assert (a.correct, a.extracted_answer, a.reasoning, a.parse_error) == (True, None, "a\nb", None)
    assert (b.correct, b.parse_error) == (False, "no verdict")


@pytest.mark.parametrize(
    ("url", "merge", "evidence_key"),
    [("HTTPS://WWW.A.com/x/?q=1#f", "https://a.com/x?q=1", "https://a.com/x?q=1"), ("http://a.com:8080", "http://a.com:8080", "https://a.com:8080/"), ("http://u@a.com/%7Ex/", "http://u@a.com/%7Ex", "https://a.com/~x"), ("ftp://a/b", "ftp://a/b", "")],
)
def test_url_keys(spark, url, merge, evidence_key):
    assert tuple(one(spark, U.merge_key(F.lit(url)).alias("m"), U.evidence_key(F.lit(url)).alias("e"))) == (merge, evidence_key)


def test_url_safety(spark):
    urls = {"https://a.com/": None, "file:///x": "scheme", "http://u:p@a.com": "credentials", "http://localhost/": "local host", "http://x.local": "local host", "http://a.com:22/": "port", "http://10.1.2.3/": "address", "http://[::1]/": "address", "http://8.8.8.8/": None, "": "scheme", "http:///x": "host"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.rejection for r in pages.url_safety(df).collect()} == urls


def test_fusion_keeps_first_and_tolerates_one_failed_list(spark):
    hits = spark.createDataFrame([(1, 0, 1, "http://a.com/x"), (1, 0, 2, "http://b.com"), (1, 1, 1, "http://www.a.com/x/"), (1, 1, 2, "http://c.com")], "query_id int, list int, rank int, url string")
    assert [r.url for r in fusion.fuse(hits, 10).orderBy("fused_rank").collect()] == ["http://a.com/x", "http://b.com", "http://c.com"]
    lists = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, False)], "query_id int, list int, ok boolean")
    assert [r.query_id for r in fusion.list_status(lists).collect()] == [2]


def test_mirrors(spark):
    q = "which early composer wrote seven hidden letters about a lost northern lighthouse keeper"
    url = "https://seo.example/" + q.replace(" ", "-")
    r = one(spark, fusion.query_mirror(F.lit(q), F.lit(url)).alias("a"), fusion.query_mirror(F.lit(q), F.lit("https://x.org/paper")).alias("b"), fusion.query_mirror(F.lit("x"), F.lit("https://www.instagram.com/popular/cats")).alias("c"))
    assert tuple(r) == (True, False, True)


def test_page_reading():
    html = "<title> A  b </title><body><script>x()</script><nav><a href='/n'>Nav</a></nav><main><h2>Head</h2><p>One <a href='https://c.d/e'>two</a></p></main><p>tail</p></body>"
    title, text, links = pages.read_page(html)
    assert (title.split(), text.split()) == (["A", "b"], ["##", "Head", "One", "two"])
    assert links == [("/n", "Nav"), ("https://c.d/e", "two")]
    assert pages.read_page("") == ("", "", []) and pages.read_page("<p>a<b>c")[1].split() == ["ac"]


def test_texts_of_pages_resolve_whole_references_only():
    text = pages.read_page("<article>cut&amp</article>")[1], pages.read_page("<article>&amp;amp; &lt;b&gt; &#39;&eacute;&#x41; &ampx; &copy &foo; a&b & &#38</article>")[1]
    assert tuple(t.strip() for t in text) == ("cut&amp", "&amp; <b> 'éA &ampx; &copy &foo; a&b & &#38")
    assert pages.read_page("<a href='/x?a=1&copy=2&amp;b=3'>a&lt</a>")[2] == [("/x?a=1&copy=2&b=3", "a&lt")]


def test_titles_that_are_cut_within_a_reference(spark):
    df = spark.createDataFrame([(1, "u", "<title>a &amp;&amp  b&amp</title><article>x</article>"), (2, "u", "<title>&lt;c&gt; &am</title>")], "page_id long, url string, html string")
    assert [r.title for r in pages.extract(df).orderBy("page_id").collect()] == ["a &&amp b&amp", "<c> &am"]


def test_page_links_are_absolute_and_once(spark):
    html = "<a href='/x'>X</a><a href='y?z'></a><a href='https://h.com/x'>again</a><a href='mailto:a'>m</a><a href='//o.org/p'>o</a>"
    df = spark.createDataFrame([(1, "https://h.com/d/e.html", html)], "page_id long, url string, html string")
    assert [(r.link, r.text) for r in pages.links(pages.extract(df)).orderBy("place").collect()] == [("https://h.com/x", "X"), ("https://h.com/d/y?z", "https://h.com/d/y?z"), ("https://o.org/p", "o")]


def test_texts(spark):
    r = one(spark, X.clean_text(F.lit(" a \t b\r\n\r\n\r\n\r\nc ")).alias("a"), X.truncate_middle(F.lit("x" * 500), 100).alias("b"), X.truncate_middle(F.lit("x" * 500), 50).alias("c"))
    assert (r.a, r.b, r.c) == ("a b\n\nc", "x" * 20 + "\n...[460 chars omitted]...\n" + "x" * 20, "x" * 50)


def test_contained_by_pieces_equals_the_loop(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab\n") for _ in range(rng.randrange(60))) for _ in range(60)]
    patterns = [t[i : i + n] for t in texts[:30] for i, n in ((3, 5), (1, 9), (2, 25), (0, 8), (4, 19))]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    p = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    wanted = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(patterns) if y and y in x}
    assert {tuple(r) for r in containment.contained(t, p, by_words=False).collect()} == wanted == {tuple(r) for r in containment.contained(t, p).collect()}


def test_anchors_keep_the_best_nine_words_of_every_segment(spark):
    q = spark.createDataFrame([(1, "Harbor lights glow. Seven grey towers stand near old northern docks while quiet sailors mend torn canvas sails. Bells ring daily.")], "item_id int, question string")
    got = {r.anchor: r.place for r in planning.anchors(q).collect()}
    assert got == {"Seven grey towers stand near old northern sailors canvas": 1, "Harbor lights glow": 2, "Bells ring daily": 3}


def test_label_leaks_and_manifest(spark, tmp_path):
    c = spark.createDataFrame([(1, "look for Ada Lovelace at https://x/Byron"), (2, "Bob")], "item_id int, text string")
    a = spark.createDataFrame([(1, "ada lovelace"), (1, "Byron"), (1, "1843"), (2, "bob")], "item_id int, alias string")
    q = spark.createDataFrame([(1, "who?"), (2, "is it Bob?")], "item_id int, question string")
    assert [tuple(r) for r in leaks.label_leaks(c, a, q).collect()] == [(1, "ada lovelace")]
    (tmp_path / "a.txt").write_text("1")
    old = spark.createDataFrame(leaks.file_manifest(spark, str(tmp_path)).collect(), "path string, sha256 string")
    (tmp_path / "a.txt").write_text("2")
    (tmp_path / "b.txt").write_text("1")
    assert sorted(r.state for r in leaks.manifest_changes(old, leaks.file_manifest(spark, str(tmp_path))).collect()) == ["added", "changed"]


def test_evidence_verdicts(spark):
    question, page = "Which poet described the northern harbor bridge in letters", "Letters. The poet Ann Low described the northern harbor bridge twice."
    t = spark.createDataFrame([(1, question, "Ann Low", ["https://a.com/p"]), (2, question, "Ann Low", []), (3, question, "Ann Low", ["https://a.com/other"]), (4, question, "Ann Low", ["http://b.com"]), (5, question, "", ["https://a.com/p"])], "trial_id int, question string, answer string, citations array<string>")
    o = spark.createDataFrame([(1, 7, "http://www.a.com/p/", "x", page), (4, 8, "http://b.com", "x", "Ann Low never described the northern harbor bridge."), (5, 7, "https://a.com/p", "x", page)], "trial_id int, page_id int, requested_url string, final_url string, page string")
    assert {r.trial_id: r.verdict for r in evidence.verdicts(t, o).collect()} == {1: "ok", 2: "no valid citation", 3: "no cited page opened", 4: "contradicted", 5: "no searchable answer"}


def test_novelty_is_greedy_and_exact(spark):
    q = ["a b c d e f g h i", "a b c d e f g h i j", "i h g f e d c b a", "x y", "2001..2004", "x y z", "a b c d e f g h i j k"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(q)], "conv_id int, pos int, query string")
    accepted, wanted = [], []
    for t in q:
        s = set(t.split()) if ".." not in t else set()
        near = not s or any(s == p or (len(s | p) >= 5 and len(s & p) / len(s | p) >= 0.9) for p in accepted)
        wanted.append(near)
        if not near:
            accepted.append(s)
    assert [r.redundant for r in trajectory.novelty(df).orderBy("pos").collect()] == wanted


def test_consensus(spark):
    rows = [(1, 1, "Oslo", 50.0, True), (1, 2, "oslo ", 60.0, True), (1, 3, "Rome", 99.0, True), (1, 4, "unknown", 1.0, True), (2, 5, "x", 1.0, True), (2, 6, "x", 1.0, False)]
    out = consensus.consensus(spark.createDataFrame(rows, "item_id int, request_id int, answer string, confidence double, ok boolean")).collect()
    assert [(r.item_id, r.answer, r.votes, r.best_request) for r in out] == [(1, "oslo ", 2, 2)]


def test_questions(spark):
    df = spark.createDataFrame([(1, 'In 1987 "Blue Harbor" opened. Jane van Dorn of Oslo wrote it. What year was it?')], "item_id int, question string")
    r = planning.answer_contract(df).first()
    assert (r.terminal_ask, r.answer_type, r.maximum) == ("What year was it?", "year", 1)
    assert {"Blue Harbor", "Jane van Dorn of Oslo"} <= {x.anchor for x in planning.anchors(df).collect()}
    assert one(spark, T.term_set_key(F.lit("After:2001 b a 1999-2004 b")).alias("k")).k == "a b"
    checks = planning.subset_checks(spark.createDataFrame([(0, 4), (1, 4)], "subset_rank int, source_index int"), 2, 4)
    assert {r.check: r.ok for r in checks.collect()} == {"size": True, "repeats": False, "range": False}


def test_asks_told_apart_from_clues(spark):
    clues = ["It was thin what there was.", "no end of a clue"]
    df = spark.createDataFrame([(k, None if c is None else f"{c} List names and both people.", "List names and both people.") for k, c in enumerate([*clues, None])], "item_id int, question string, ask string")
    out = planning.answer_contract(df, ask="ask").orderBy("item_id").collect()
    assert [(r.terminal_ask, r.answer_type, r.minimum, r.maximum) for r in out] == [("List names and both people.", "other_short_string", 1, None)] * 3
    assert planning.answer_contract(df).orderBy("item_id").first().terminal_ask == clues[0]


def test_places_on_both_sides_of_the_date_line_and_near_a_pole(spark):
    import math
    import random

    rng = random.Random(3)
    spots = [(89.9, 10.0), (89.9, -170.0), (0.0, 179.99), (0.0, -179.99), (60.0, 0.0)] + [(rng.uniform(59.8, 60.2), rng.uniform(-0.4, 0.4)) for _ in range(40)]
    a = spark.createDataFrame([(k, x, y, 25_000, None) for k, (x, y) in enumerate(spots)], "anchor_id int, lat double, lon double, radius_m int, expected_distance_miles double")
    p = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(spots)], "place_id int, lat double, lon double")

    def far(u, v):
        h = math.sin(math.radians(v[0] - u[0]) / 2) ** 2 + math.cos(math.radians(u[0])) * math.cos(math.radians(v[0])) * math.sin(math.radians(v[1] - u[1]) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(min(1.0, h)))

    wanted = {(i, j) for i, u in enumerate(spots) for j, v in enumerate(spots) if far(u, v) <= 25_000}
    assert {(r.anchor_id, r.place_id) for r in geo.places_near(a, p).collect()} == wanted and (0, 1) in wanted and (2, 3) in wanted


def test_log_files_are_numbered_and_bad_lines_quarantined(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"subset_rank": 1, "finished_at": "x", "status": "completed", "correct": true}\n\n{"broken\n[1]\n{"subset_rank": true, "finished_at": "x"}\n')
    lines = trial_logs.read_lines(spark, str(tmp_path / "*.jsonl"))
    out = {r.line_no: r for r in trial_logs.parse_lines(lines).collect()}
    assert {k: (r.problem, r.terminal, r.unscored, r.quarantined) for k, r in out.items()} == {1: (None, True, False, False), 3: ("corrupt_record", False, True, True), 4: ("invalid_record", False, True, True), 5: (None, False, True, True)}
    assert out[3].raw_line_chars == 8 and out[1].record.correct is True
    with pytest.raises(Exception, match="corrupt_record at .*a.jsonl:3"):
        trial_logs.strict_lines(lines).collect()


def test_csv_checks(spark):
    df = spark.createDataFrame([("a", "b"), ("", "c")], "problem string, answer string")
    assert {r.check for r in trial_logs.csv_checks(df, ("problem", "answer"), 3).collect()} == {"row_count", "empty_fields"}
    assert trial_logs.csv_checks(df, ("canary",), 2).first().check == "missing_columns"


def test_rows_are_numbered_in_order_of_files_not_of_their_sizes(spark, tmp_path):
    for k, n in enumerate((3, 400, 4000)):
        rows = [("" if i == 1 else f"text {i * 7919 % 10007}", "c") for i in range(n)]
        spark.createDataFrame(rows, "problem string, answer string").coalesce(1).write.parquet(str(tmp_path / f"part={k}"))
    df = spark.read.parquet(str(tmp_path))
    detail = {r.check: r.detail for r in trial_logs.csv_checks(df, ("problem", "answer"), 4403).collect()}
    assert detail == {"empty_fields": "3 rows: 1, 4, 404"}
    # Sorted rows are no longer in the files' order.
    detail = {r.check: r.detail for r in trial_logs.csv_checks(df.orderBy("problem"), ("problem", "answer"), 4403).collect()}
    assert detail == {"empty_fields": "3 rows: 0, 1, 2"}


def test_stale_alerts_on_a_stream(spark, tmp_path):
    schema = "run_id string, ts timestamp, state string"
    batches = [[("a", "2024-01-01 00:00:00", "running"), ("b", "2024-01-01 00:00:00", "running")], [("b", "2024-01-01 02:00:00", "completed"), ("c", "2024-01-01 05:00:00", "running")], [("c", "2024-01-01 05:10:00", "running")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "run_id string, ts string, state string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*").withWatermark("ts", "1 minute")
    out = live.run_to_end(live.stale_alerts(stream, 3600), "append").collect()
    assert {(r.run_id, r.alert) for r in out} == {("a", "stale"), ("b", "cleared")}


def test_unified_status(spark):
    rows = [("a", 3, None, None, None, 1, 2, "running", "t", None), ("b", None, 5, 8, [1, 2], 0, None, None, "t", 8)]
    df = spark.createDataFrame(rows, "run_id string, completed int, finished_items int, current_records int, done array<int>, failed int, remaining int, state string, updated_at string, target_total_questions int")
    assert {(r.run_id, r.done, r.remaining, r.state) for r in live.unify_status(df).collect()} == {("a", 3, 2, "running"), ("b", 5, 0, "completed")}


def lists(df):
    """Inputs of the lists that a plan gathers."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "collect_list(" in line or "collect_set(" in line]


def test_retry_states_list_an_answer_once(spark):
    rows = [(1, 1, k, "b" if k % 2 else "a", False) for k in range(1, 40)] + [(1, 1, 40, "c", None), (1, 1, 0, None, None), (1, 2, 3, None, False), (1, 3, 2, "x", True), (1, 3, 1, "y", False)]
    t = spark.createDataFrame(rows, "run_id int, item_id int, attempt int, extracted_answer string, correct boolean")
    out = ledger.retry_states(t, 40)
    assert {r.item_id: (r.next_attempt, r.state, r.tried) for r in out.collect()} == {1: (41, "failed", "b|a|c"), 2: (4, "retry_pending", ""), 3: (3, "completed", "y|x")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # The list is made of rows that are grouped by answer.
    assert lists(out) and plan.count("Aggregate [") == 2


def test_passages_meet_queries_by_terms(spark):
    p = [(1, 1, ["a", "b", "c"]), (1, 2, ["c", "b", "a"]), (1, 3, ["z"]), (1, 4, []), (2, 5, ["a", "b"]), (3, 6, ["a"]), (None, 7, ["a"])]
    q = [(1, "b a q"), (1, "a c b b x"), (1, "z"), (1, "q z"), (1, ""), (1, None), (2, "a x"), (2, "b y"), (None, "a")]
    rows = spark.createDataFrame(p, "group int, k int, terms array<string>")
    out = pages.with_best_overlap(rows, spark.createDataFrame(q, "group int, query string"), "group")
    # "a" is no search term.
    assert {r.k: r.overlap for r in out.collect()} == {1: 2, 2: 2, 3: 1, 4: 0, 5: 1, 6: 0, 7: 0}
    docs = spark.createDataFrame([(1, 1, "x")], "group int, doc_id int, text string")
    assert not lists(pages.passages(docs, spark.createDataFrame(q, "group int, query string")))


def test_passages_exchange_no_text(spark, monkeypatch):
    import random

    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["reported", "history"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(d % 3, d, "\n\n".join(f"{say(rng.randrange(6, 40))} {'reported by Ann Lee' if rng.random() < 0.1 else ''}" for _ in range(4))) for d in range(40)] + [(7, 100, f"reported {say(12)}"), (8, 101, say(12))]
    docs += docs[:2]
    queries = [(g, say(rng.randrange(0, 30))) for g in (0, 1) for _ in range(40 if g else 5)] + [(0, None), (5, "w1 w2")]
    d, q = spark.createDataFrame(docs, "group int, doc_id int, text string"), spark.createDataFrame(queries, "group int, query string")
    wanted = set()
    stop = {*T.LINK_STOPWORDS}
    terms = lambda x: set(re.findall("[a-z0-9]+", (x or "").lower())) - stop
    for g in {x[0] for x in docs}:
        pages_of = []
        for _, k, text in {x for x in docs if x[0] == g}:
            found = []
            for n, p in enumerate(" ".join(x.split()) for x in text.split("\n\n")):
                t, overlap = terms(p), max([len(terms(p) & terms(y)) for x, y in queries if x == g], default=0)
                signal = len(t & {*T.SIGNAL_TERMS})
                if len(p) >= 40 and len(p.split()) >= 8 and (overlap >= 2 or signal):
                    found += [(-(overlap * 10 + signal * 24 + len(t & {*T.RESEARCH_TERMS}) * 2 + 80 * ("by Ann Lee" in p)), k, n, p)] * docs.count((g, k, text))
            pages_of += sorted(found, key=lambda x: (x[0], x[2]))[:2]
        best = sorted(pages_of)[:6]
        wanted |= {(g, k, n, -s, len(best) - i, p) for i, (s, k, n, p) in enumerate(best)}
    for limit in (pages.INDEXED, 40):
        monkeypatch.setattr(pages, "INDEXED", limit)
        out = pages.passages(d, q)
        assert {tuple(r) for r in out.collect()} == wanted and len(wanted) == out.count() > 12
    monkeypatch.setattr(pages, "INDEXED", 200_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = [pages.passages(d, q)._jdf.queryExecution().executedPlan()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for node in plan:
        plan += [node.children().apply(k) for k in range(node.children().size())]
    assert not [x for x in plan if x.nodeName() == "Exchange" and re.search("(passage|text|raw)#", x.output().mkString(","))]


def test_sign_test_in_one_form(spark):
    import math

    for a, b in ((0, 0), (0, 1), (1, 1), (3, 9), (40, 60), (15, 16), (500, 450), (0, 40)):
        n = a + b
        wanted = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n) if n else 1.0
        assert one(spark, stats.exact_sign_pvalue(F.lit(a), F.lit(b)).alias("p")).p == pytest.approx(wanted, rel=1e-9)
    a, b = 2_000_000, 2_004_000
    z = (b - a - 1) / math.sqrt(a + b)
    assert one(spark, stats.exact_sign_pvalue(F.lit(a), F.lit(b)).alias("p")).p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=30_001), "b": np.concatenate([np.full(9_000, 7.0), rng.integers(0, 20, 5_000)]), "c": np.array([3.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "run_id string, v double").repartition(5)
    out = {r.run_id: (r.p1, r.p50, r.p95) for r in metrics.exact_quantiles(df, "v", {"p1": 0.01, "p50": 0.5, "p95": 0.95}).collect()}
    assert set(out) == {"a", "b", "c"}
    for k, x in values.items():
        assert out[k] == pytest.approx(tuple(np.quantile(x, [0.01, 0.5, 0.95])), rel=1e-12)


def test_bootstrap_interval_is_that_of_the_binomial(spark):
    import math

    t = trials(spark, *[{"item_id": str(k), "correct": k % 10 < 7} for k in range(200)])
    r = metrics.bootstrap_accuracy(t, 10_000).first()
    below = lambda k: sum(math.comb(200, i) * 0.7**i * 0.3 ** (200 - i) for i in range(k + 1))
    low = next(k for k in range(201) if below(k) >= 0.025)
    high = next(k for k in range(201) if below(k) >= 0.975)
    assert abs(r.bootstrap_low * 200 - low) <= 1 and abs(r.bootstrap_high * 200 - high) <= 1


def test_find_in_pages_places_every_match(spark):
    import re

    texts = ["", "Token é token TOKEN", "no", "token", "x" * 600 + "password" + "y" * 600, " ".join(["token"] * 30), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sorted((int(r.key), r.place, r.offset, r.found, r.context) for r in pages.find_in_pages(df, "password|token").collect())
    wanted = [(k, n, m.start(), m.group(), t[max(0, m.start() - 500) : m.end() + 500]) for k, t in enumerate(texts) if t for n, m in enumerate(list(re.finditer("(?i)password|token", t))[:20], start=1)]
    assert out == wanted


def test_active_trials_are_not_revived_by_late_events(spark, tmp_path):
    batches = [[(1, 5, "view"), (2, 1, "view")], [(1, 9, "purchase")], [(1, 7, "view"), (2, 4, "click")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, event_id long, action string").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema("user_id long, event_id long, action string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    out = live.latest(live.run_to_end(live.active(stream), "update"), "user_id", ("event_id", "action", "active"))
    assert {r.user_id: (r.event_id, r.action, r.active) for r in out.collect()} == {1: (9, "purchase", False), 2: (4, "click", True)}


def test_alerts_wait_for_their_confirmations(spark, tmp_path):
    schema = "run_id string, ts timestamp, state string"
    batches = [[("a", "2024-01-01 00:00:00", "running"), ("b", "2024-01-01 00:00:00", "running")], [("c", "2024-01-01 02:00:00", "running")], [("b", "2024-01-01 02:30:00", "running")], [("c", "2024-01-01 02:40:00", "running")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "run_id string, ts string, state string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*").withWatermark("ts", "1 minute")
    once = live.run_to_end(live.stale_alerts(read(), 3600), "append").collect()
    twice = live.run_to_end(live.stale_alerts(read(), 3600, confirmations=2, check_seconds=1800), "append").collect()
    # b is heard again before its second check.
    assert {r.run_id for r in once} == {"a"} | ({"b"} & {r.run_id for r in once}) and {r.run_id for r in twice} == {"a"}


def test_calls_reviews_and_plans_of_odd_rows(spark):
    log = spark.createDataFrame([(None, None), ("search", ""), ("search", "{broken"), ("open", '{"urls":[]}')], "name string, arguments string")
    got = [(r.tool, r.canonical, r.invalid) for r in conformance.canonical_calls(log, ("search", "open", "open_many")).collect()]
    assert got == [("", None, "unknown tool"), ("search", "{}", None), ("search", None, "no object"), ("open_many", '{"urls":[]}', None)]
    said = spark.createDataFrame([(None, True), ("", None), ('{"verdict": 3}', True), ('{"a": {"verdict": "pass"}}', True)], "content string, ok boolean")
    assert [(r.verdict, r.usable) for r in conformance.review_verdicts(said).collect()] == [("BLOCK", False), ("BLOCK", False), ("BLOCK", False), ("PASS", True)]
    plans = spark.createDataFrame([(None,), ("",), ('{"queries": null}',)], "text string")
    assert {r.fault for r in conformance.plan_quality(plans).collect()} == {"no plan"}
    empty = spark.createDataFrame([], "item_id long, attempt int, pos int, step_id string, instruction string, allowed_actions array<string>")
    assert guides.guide_faults(empty).count() == 0
