"""Grading, search fusion, pages, evidence and leak scans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrain.functions import terms as T
from evalgrain.functions import texts as X
from evalgrain.functions import urls as U
from evalgrain.operators import containment, evidence, fusion, grading, leaks, pages
from evalgrain.plans.fixtures import rounded, table, trials, with_trials
from evalgrain.plans.registry import query
from evalgrain.sources import trial_logs


def _answers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    said = (
        F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).when(k == 2, F.concat(F.lit("The "), "p_name"))
        .when(k == 3, F.concat(F.lit("not "), "p_name")).otherwise(F.concat(F.lit("Some thoughts\nExact Answer: "), "p_name", F.lit(" \nConfidence: 80")))
    )
    return p.select("p_partkey", said.alias("response"), F.col("p_name").alias("reference"))


_ANSWERS = """answers AS (SELECT p_partkey, p_name AS reference, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN 'The ' || p_name
 WHEN 3 THEN 'not ' || p_name ELSE 'Some thoughts' || chr(10) || 'Exact Answer: ' || p_name || ' ' || chr(10) || 'Confidence: 80' END AS response FROM part)"""


@query("txt_01_02_regrade", f"""WITH {_ANSWERS}, x AS (SELECT *, CASE WHEN p_partkey % 5 = 4 THEN trim(regexp_extract(response, '(?i)Exact Answer: ([^\\n]+)', 1)) ELSE response END AS extracted_answer FROM answers),
 n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(extracted_answer), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(reference), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM x)
 SELECT p_partkey, extracted_answer, a = b AS correct FROM n""")  # fmt: skip
def regrade(spark, sf_dir):
    return grading.regrade(_answers(spark, sf_dir)).select("p_partkey", "extracted_answer", "correct")


def _grader_outputs(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    verdict = F.when(F.col("doc_id") % 7 == 0, "no decision").otherwise(F.concat(F.lit("correct: "), F.when(F.col("quality") == 1, "yes").otherwise("No")))
    text = F.concat(F.lit("extracted_final_answer: "), F.when(F.col("doc_id") % 3 == 0, "None").otherwise(F.concat(F.lit("a"), F.col("doc_id"))), F.lit("\nreasoning: because\n"), verdict)
    return lab.select("doc_id", text.alias("text"), (F.col("toxic") == 0).alias("deterministic"))


_GRADER = """g AS (SELECT doc_id, toxic = 0 AS deterministic, doc_id % 7 <> 0 AND quality = 1 AS correct, CASE WHEN doc_id % 7 = 0 THEN 'no verdict' END AS parse_error,
 CASE WHEN doc_id % 3 <> 0 THEN 'a' || doc_id END AS extracted_answer, CASE WHEN doc_id % 7 = 0 THEN 'because' || chr(10) || 'no decision' ELSE 'because' END AS reasoning FROM labels)"""


@query("txt_03_grader_outputs", f"WITH {_GRADER} SELECT doc_id, correct, parse_error, extracted_answer, reasoning FROM g")
def grader_outputs(spark, sf_dir):
    return grading.parse_grader(_grader_outputs(spark, sf_dir)).select("doc_id", "correct", "parse_error", "extracted_answer", "reasoning")


@query("txt_03_grader_agreement", f"WITH {_GRADER} SELECT count(*) AS n, count(*) FILTER (correct = deterministic) AS agree, count(*) FILTER (correct AND NOT deterministic) AS grader_only, count(*) FILTER (NOT correct AND deterministic) AS deterministic_only, count(parse_error) AS parse_errors FROM g")
def grader_agreement(spark, sf_dir):
    return grading.grader_agreement(grading.parse_grader(_grader_outputs(spark, sf_dir)))


@query("txt_04_plain_final", f"""WITH {_ANSWERS} SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN reference ELSE response END AS answer, CASE WHEN p_partkey % 5 = 4 THEN 80.0 ELSE 50.0 END::DOUBLE AS confidence, 0 AS n_citations FROM answers""")
def plain_final(spark, sf_dir):
    out = grading.plain_final(_answers(spark, sf_dir), "response")
    return out.select("p_partkey", "answer", "confidence", F.size("citations").alias("n_citations"))


@query("txt_28_audit_sample", with_trials(""", d AS (SELECT run_id, item_id, attempt, coalesce(correct, false) AS ok, confidence, parse_error, sha256('audit|' || run_id || '|' || item_id || '|' || attempt) AS deal FROM trials),
 s AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY deal, run_id, item_id, attempt) AS place FROM d)
 SELECT run_id, item_id, attempt, CASE WHEN ok THEN 'positive' ELSE 'negative' END AS reason FROM s WHERE place <= 20
 UNION ALL SELECT run_id, item_id, attempt, 'parse_error' FROM d WHERE parse_error UNION ALL SELECT run_id, item_id, attempt, 'low_confidence' FROM d WHERE ok AND confidence < 50"""))  # fmt: skip
def audit_sample(spark, sf_dir):
    return grading.audit_sample(trials(spark, sf_dir))


def _hits(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("query_id", (F.col("page_id") / 50).cast("long"))
    a = p.where("page_id % 2 = 0 OR page_id % 3 = 0").withColumn("list", F.lit(0))
    b = p.where("page_id % 2 = 1 OR page_id % 3 = 0").withColumn("list", F.lit(1))
    return a.unionByName(b).select("query_id", "list", F.col("page_id").alias("rank"), "url")


_HITS = """hits AS (SELECT page_id // 50 AS query_id, 0 AS list, page_id AS rank, url FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0
 UNION ALL SELECT page_id // 50, 1, page_id, url FROM pages WHERE page_id % 2 = 1 OR page_id % 3 = 0)"""
_KEY = "lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_extract(url, '(\\?[^#]*)', 1) ELSE '' END"


@query("win_01_fusion", f"""WITH {_HITS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY rank, url) AS place, {_KEY} AS key FROM hits),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY place, list) AS again FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, list) AS fused_rank FROM f WHERE again = 1)
 SELECT query_id, list, rank, url, fused_rank FROM r WHERE fused_rank <= 20""")  # fmt: skip
def fused(spark, sf_dir):
    return fusion.fuse(_hits(spark, sf_dir), 20).select("query_id", "list", "rank", "url", "fused_rank")


_CANDIDATES = f"""{_HITS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY rank) AS place FROM hits),
 u AS (SELECT query_id, url, min(place * 10 + list) AS first_at FROM p GROUP BY query_id, url), c AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY first_at) AS choice FROM u)"""


@query("win_02_candidates", f"WITH {_CANDIDATES} SELECT query_id, url, choice FROM c WHERE choice <= 15")
def candidates(spark, sf_dir):
    return fusion.candidates(_hits(spark, sf_dir), 15)


@query("win_03_unopened", f"""WITH {_CANDIDATES}, k AS (SELECT c.query_id, c.url, choice, o.url IS NOT NULL AS opened FROM c LEFT JOIN (SELECT DISTINCT page_id // 50 AS query_id, url FROM pages WHERE page_id % 4 = 0) o ON o.query_id = c.query_id AND o.url = c.url),
 w AS (SELECT *, bool_or(NOT opened) OVER (PARTITION BY query_id) AS any_new FROM k), r AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY choice) AS place, NOT any_new AS fallback FROM w WHERE NOT opened OR NOT any_new)
 SELECT * FROM r WHERE place <= 10""")  # fmt: skip
def unopened(spark, sf_dir):
    opened = table(spark, sf_dir, "pages").where("page_id % 4 = 0").select((F.col("page_id") / 50).cast("long").alias("query_id"), "url")
    return fusion.unopened(fusion.candidates(_hits(spark, sf_dir), 1_000_000), opened, 10)


@query("prj_11_url_keys", f"""SELECT page_id, {_KEY} AS merge_key, 'https://' || regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') || coalesce(nullif(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_extract(url, '(\\?[^#]*)', 1) ELSE '' END AS evidence_key,
 lower(split_part(url, '#', 1)) AS candidate_key FROM pages""")  # fmt: skip
def url_keys(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.merge_key(u).alias("merge_key"), U.evidence_key(u).alias("evidence_key"), U.candidate_key(u).alias("candidate_key"))


@query("prj_12_redirects", "SELECT page_id, url AS target FROM pages")
def redirects(spark, sf_dir):
    wrapped = F.concat(F.lit("https://r.example/RU="), F.url_encode("url"), F.lit("/RK=2/RS=x"))
    return table(spark, sf_dir, "pages").select("page_id", U.redirect_target(wrapped).alias("target"))


@query("prj_10_url_safety", """SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'scheme' WHEN 2 THEN 'credentials' WHEN 3 THEN 'port' WHEN 4 THEN 'address' WHEN 5 THEN 'local host' END AS rejection FROM pages""")
def url_safety(spark, sf_dir):
    host, rest = U.netloc(F.col("url")), F.concat(U.path(F.col("url")), U.query_string(F.col("url")))
    k = F.col("page_id") % 6
    url = (
        F.when(k == 1, F.concat(F.lit("ftp://"), host, rest)).when(k == 2, F.concat(F.lit("https://user:pw@"), host, rest)).when(k == 3, F.concat(F.lit("https://"), host, F.lit(":8080"), rest))
        .when(k == 4, F.concat(F.lit("http://10.0.0."), F.col("page_id") % 250, rest)).when(k == 5, F.concat(F.lit("http://printer.local"), rest)).otherwise(F.col("url"))
    )
    return pages.url_safety(table(spark, sf_dir, "pages").select("page_id", url.alias("url"))).select("page_id", "rejection")


@query("prj_16_unusable_hits", "SELECT page_id, contains(lower(url), 'spam-farm') AS unusable, page_id % 9 = 0 AS bad_snippet FROM pages")
def unusable_hits(spark, sf_dir):
    snippet = F.when(F.col("page_id") % 9 == 0, F.lit(" Loading... ")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", fusion.unusable_hit(F.lit("some query"), F.lit("title"), F.col("url"), "spam-farm").alias("unusable"), fusion.unusable_snippet(snippet).alias("bad_snippet"))


@query("prj_17_host_penalty", "SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '://([^/?#]*)', 1)), '(^|\\.)(cheap-pills\\.example\\.com|example\\.net)$') THEN 25.0 ELSE 0.0 END::DOUBLE AS penalty FROM pages")
def host_penalty(spark, sf_dir):
    return fusion.host_penalty(table(spark, sf_dir, "pages"), ["cheap-pills.example.com", "example.net"]).select("page_id", "penalty")


@query("agg_19_search_audit", f"""WITH {_HITS} SELECT 'list' || list AS provider, count(*) AS n_results, count(*) FILTER (rank % 4 = 1) AS filtered_mirrors, count(*) FILTER (rank % 9 = 0 AND rank % 4 <> 1) AS unusable_snippets,
 CAST(sum(CASE WHEN rank % 9 = 0 OR rank % 4 = 1 THEN 0 ELSE length(url) END) AS BIGINT) AS snippet_chars FROM hits GROUP BY list""")  # fmt: skip
def search_audit(spark, sf_dir):
    snippet = F.when(F.col("rank") % 9 == 0, F.lit("loading")).otherwise(F.col("url"))
    asked = "which engineer of the northern harbour town designed an iron bridge before the great flood destroyed its market"
    url = F.when(F.col("rank") % 4 == 1, F.lit(f"https://seo.example/{asked.replace(' ', '-')}")).otherwise(F.col("url"))
    h = _hits(spark, sf_dir).select(F.concat(F.lit("list"), "list").alias("provider"), url.alias("url"), snippet.alias("snippet"), F.lit(asked).alias("question"))
    return fusion.audit(h)


@query("win_10_host_diverse", """WITH s AS (SELECT page_id // 50 AS item_id, url, (page_id * 7919) % 1000 AS score, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages),
 o AS (SELECT *, row_number() OVER (PARTITION BY item_id, url ORDER BY score DESC) AS n FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, url) AS place, row_number() OVER (PARTITION BY item_id, host ORDER BY score DESC, url) AS of_host FROM o WHERE n = 1),
 c AS (SELECT item_id, url, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, url) AS choice FROM p WHERE place <= 2 OR of_host = 1) SELECT * FROM c WHERE choice <= 8""")  # fmt: skip
def host_diverse(spark, sf_dir):
    s = table(spark, sf_dir, "pages").select((F.col("page_id") / 50).cast("long").alias("item_id"), "url", ((F.col("page_id") * 7919) % 1000).alias("score"))
    return fusion.host_diverse(s, 8)


@query("prj_05_page_windows", """WITH w AS (SELECT doc_id, text, length(text) AS total, unnest(range(0, greatest(length(text), 1), 5000)) AS start FROM documents)
 SELECT doc_id, start, least(start + 5000, total) AS end_offset, total AS total_chars, least(start + 5000, total) < total AS has_more, sha256(substr(text, start + 1, 5000)) AS digest FROM w""")  # fmt: skip
def page_windows(spark, sf_dir):
    out = pages.page_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 5000)
    return out.select("doc_id", "start", "end_offset", "total_chars", "has_more", F.sha2("window", 256).alias("digest"))


@query("prj_06_truncate_middle", """SELECT doc_id, sha256(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 470) || chr(10) || '...[' || (length(text) - 940) || ' chars omitted]...' || chr(10) || right(text, 470) END) AS digest,
 least(length(text), 50) AS short_length FROM documents""")  # fmt: skip
def truncate(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.truncate_middle(t, 1000), 256).alias("digest"), F.char_length(X.truncate_middle(t, 50)).alias("short_length"))


@query("prj_07_clean_text", """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(html, '>', '> ' || chr(9) || chr(13) || chr(10)), '<', chr(10) || chr(10) || chr(10) || ' <'), '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g') AS t FROM pages),
 b AS (SELECT page_id, regexp_replace(t, ' ?\\n ?', chr(10), 'g') AS t FROM a) SELECT page_id, sha256(regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM b""")  # fmt: skip
def cleaned(spark, sf_dir):
    raw = F.replace(F.replace("html", F.lit(">"), F.lit("> \t\r\n")), F.lit("<"), F.lit("\n\n\n <"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.clean_text(raw), 256).alias("digest"))


@query("prj_08_pages", """SELECT page_id, sha256(html) AS sha256, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
 len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages""")  # fmt: skip
def extracted(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "sha256", "title", F.size("links").alias("n_links"))


_PLAIN = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
_ARTICLE = _PLAIN.format("regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g')")
_A = "'<a href=\"([^\"]*)\">([^<]*)</a>'"


@query("prj_08_page_text", rf"SELECT page_id, sha256(array_to_string(regexp_extract_all({_ARTICLE}, '[\p{{L}}\p{{N}}]+'), ' ')) AS words FROM pages")
def page_text(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0)
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", F.sha2(F.array_join(words, " "), 256).alias("words"))


@query("prj_08_page_links", f"""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS base, unnest(regexp_extract_all(html, {_A}, 1)) AS href, unnest(regexp_extract_all(html, {_A}, 2)) AS said, unnest(range(0, len(regexp_extract_all(html, {_A})))) AS i FROM pages),
 u AS (SELECT page_id, base || {_PLAIN.format('href')} AS link, {_PLAIN.format('said')} AS text, i FROM l), f AS (SELECT page_id, link, min(i) AS i, arg_min(text, i) AS text FROM u GROUP BY page_id, link), r AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place, link, text FROM f) SELECT * FROM r WHERE place <= 80""")  # fmt: skip
def page_links(spark, sf_dir):
    return pages.links(pages.extract(table(spark, sf_dir, "pages")))


@query("prj_09_markdown_links", """WITH m AS (SELECT page_id, [url, 'https://a.example/x', url] AS u, ['one', 'two', 'three'] AS l FROM pages) SELECT page_id, 1 AS place, 'one' AS label, u[1] AS link FROM m UNION ALL SELECT page_id, 2, 'two', u[2] FROM m""")
def markdown_links(spark, sf_dir):
    text = F.concat(F.lit("See [one]("), "url", F.lit(") and [two](https://a.example/x.), not [rel](/y), [three]("), "url", F.lit(")."))
    return pages.markdown_links(table(spark, sf_dir, "pages").select("page_id", text.alias("text")))


@query("txt_25_find", """WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), 'password|token|license') AS m FROM documents) SELECT CAST(doc_id AS VARCHAR) AS key, least(len(m), 20) AS n, m[1] AS first FROM d WHERE len(m) > 0""")
def find(spark, sf_dir):
    found = pages.find_in_pages(table(spark, sf_dir, "documents"), "password|token|license")
    return found.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.lower(F.min_by("found", "place")).alias("first"))


@query("prj_03_row_hashes", """SELECT item_id, sha256('{"item_id":' || item_id || ',"text":' || to_json(text) || '}') AS row_hash FROM benchmark""")
def row_hashes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.to_json(F.struct("item_id", "text"), {"ignoreNullFields": "false"}), 256).alias("row_hash"))


@query("prj_18_shards", """SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT % 11 AS BIGINT) AS shard, doc_id % 4 AS cohort, 4 * doc_id + 2 AS helper_slot FROM documents""")
def shards(spark, sf_dir):
    head = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return table(spark, sf_dir, "documents").select("doc_id", (head % 11).cast("long").alias("shard"), F.pmod("doc_id", F.lit(4)).alias("cohort"), (F.col("doc_id") * 4 + 2).alias("helper_slot"))


def _leak_items(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.col("text").alias("question"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("answer"))


_LEAKS = """WITH i AS (SELECT item_id, text AS question, array_to_string(string_split(text, ' ')[1:3], ' ') AS answer FROM benchmark)
 SELECT d.doc_id AS text_id, 'question' AS kind, CAST(i.item_id AS VARCHAR) AS item_id FROM documents d JOIN i ON length(question) >= 20 AND contains(d.text, i.question)
 UNION ALL SELECT d.doc_id, 'answer', CAST(i.item_id AS VARCHAR) FROM documents d JOIN i ON length(answer) >= 4 AND contains(d.text, i.answer)
 UNION ALL SELECT doc_id, 'canary', NULL FROM documents WHERE contains(text, 'AKIA')"""


@query("join_03_leak_scan", _LEAKS)
def leak_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return leaks.leak_findings(docs, _leak_items(spark, sf_dir), "AKIA")


@query("join_03_block_join", "SELECT d.doc_id AS text_id, b.item_id AS pattern_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def block_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    patterns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    return containment.contained(docs, patterns, by_words=False)


@query("agg_26_verification", "SELECT 'question' AS check, CAST(count(*) AS VARCHAR) AS detail FROM documents d JOIN benchmark b ON length(b.text) >= 20 AND contains(d.text, b.text) HAVING count(*) > 0")
def verification(spark, sf_dir):
    found = leak_scan(spark, sf_dir).where("kind = 'question'").groupBy("kind").agg(F.count("*").alias("n")).select(F.col("kind").alias("check"), F.col("n").alias("detail"))
    empty = table(spark, sf_dir, "benchmark").where("text IS NULL").select(F.lit("empty").alias("check"), F.col("item_id").alias("detail"))
    return leaks.verification([found, empty])


@query("prj_13_redaction", """SELECT page_id, '<redacted>' AS api_key, CASE WHEN page_id % 2 = 0 THEN '' ELSE '<redacted>' END AS db_password, url AS key_fingerprint, url FROM pages""")
def redaction(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    conf = p.select("page_id", F.struct(F.col("url").alias("api_key"), F.when(F.col("page_id") % 2 == 0, "").otherwise(F.col("url")).alias("DB-Password"), F.struct(F.col("url").alias("key_fingerprint"), "url").alias("more")).alias("c"))
    out = conf.select("page_id", leaks.redact(F.col("c"), conf.schema["c"].dataType).alias("c"))
    return out.select("page_id", F.col("c.api_key").alias("api_key"), F.col("c").getField("DB-Password").alias("db_password"), "c.more.key_fingerprint", "c.more.url")


@query("prj_14_answer_redaction", """SELECT item_id, sha256('<${candidate}>, ' || text || 's') AS digest FROM (SELECT item_id, regexp_extract(text, '[A-Za-z]+', 0) AS text FROM benchmark)""")
def answer_redaction(spark, sf_dir):
    word = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", "[A-Za-z]+", 0).alias("alias"))
    said = word.select("item_id", F.concat(F.lit("<"), "alias", F.lit(">, "), "alias", F.lit("s")).alias("text"))
    out = leaks.redact_answers(said, word.unionByName(word.select("item_id", F.left("alias", F.lit(1)).alias("alias")).where("char_length(alias) > 1")))
    return out.select("item_id", F.sha2("redacted", 256).alias("digest"))


_TERMS = "list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(text), '\\b(?:after|before):\\d{4}(?:-\\d{2}-\\d{2})?\\b|\\b(?:1[5-9]\\d{2}|20\\d{2})\\s*(?:\\.\\.|[-–—]|\\bto\\b)\\s*(?:1[5-9]\\d{2}|20\\d{2})\\b', ' ', 'g'), '[a-z0-9]+')))"


@query("txt_07_term_sets", f"SELECT conv_id, turn, array_to_string({_TERMS}, ' ') AS term_key FROM conversations")
def term_sets(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.term_set_key(F.col("text")).alias("term_key"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.LINK_STOPWORDS) + "]"


@query("txt_08_relevance", f"""WITH q AS (SELECT item_id, list_filter({_TERMS}, lambda x: NOT list_contains({_STOP}, x)) AS q FROM benchmark), p AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, {_TERMS} AS p FROM documents)
 SELECT doc_id, len(q) > 0 AND len(list_intersect(q, p)) >= least(len(q), 8, greatest(2, (len(q) + 5) // 6)) AS relevant FROM p JOIN q USING (item_id)""")  # fmt: skip
def relevance(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % b.count())
    return d.join(b.withColumnRenamed("text", "question"), "item_id").select("doc_id", evidence.page_matches_question(F.col("question"), F.col("text")).alias("relevant"))


def _mirror_sql(question: str, path: str) -> str:
    terms = lambda x: "list_filter(" + _TERMS.replace("text", x) + f", lambda w: NOT list_contains({_STOP}, w))"
    q, p, spaced = terms(question), terms(f"replace({path}, '-', ' ')"), f"replace({path}, '-', ' ')"
    both = f"len(list_intersect({q}, {p}))"
    jobs = f"((contains(lower({path}), '-jobs') OR contains(lower({path}), '/jobs/')) AND length({path}) >= 60 AND len({terms(path)}) >= 7)"
    solver = f"regexp_matches(lower({spaced}), 'crossword solver|crossword clue|question answer')"
    long = f"(len({q}) >= 7 AND length({spaced}) >= 80 AND len({p}) >= 8 AND {both} >= 8)"
    return f"({jobs} OR ({long} AND ({both} >= 0.5 * len({q}) OR {both} >= 0.65 * len({p}) OR ({solver} AND {both} >= 0.5 * len({p})))))"


_ASKED, _SLUG = _TERMS.replace("text", "question"), "list_distinct(regexp_extract_all(lower(slug), '[a-z0-9]+'))"
_SHORT = f"len({_ASKED}) >= 5 AND len({_SLUG}) >= 5 AND len(list_intersect({_ASKED}, {_SLUG})) >= greatest(5, 0.65 * len({_ASKED}))"


@query("txt_12_13_mirrors", f"""WITH s AS (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS question FROM pages), u AS (SELECT *, '/' || regexp_replace(lower(question), '[^a-z0-9]+', '-', 'g') AS slug, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM s)
 SELECT page_id, {_mirror_sql('question', 'slug')} AS mirror, {_mirror_sql('question', 'path')} AS own_url, {_SHORT} AS path_mirror FROM u""")  # fmt: skip
def mirrors(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("question"))
    slug = F.concat(F.lit("https://seo.example/"), F.regexp_replace(F.lower("question"), "[^a-z0-9]+", "-"))
    return p.select("page_id", fusion.query_mirror(F.col("question"), slug).alias("mirror"), fusion.query_mirror(F.col("question"), F.col("url")).alias("own_url"), fusion.path_mirror(F.col("question"), slug).alias("path_mirror"))


def _evidence(spark, sf_dir):
    """Each benchmark item is a trial; documents that hold an item's whole text are the pages it opened. Every fourth page denies something at each comma."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("trial_id"), F.col("text").alias("question"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("answer"))
    d = table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 4 == 1, F.replace("text", F.lit(", "), F.lit(" is not "))).otherwise(F.col("text"))
    hits = containment.contained(d.select(F.col("doc_id").alias("text_id"), "text"), b.select(F.col("trial_id").alias("pattern_id"), F.col("question").alias("pattern")))
    url = F.concat(F.lit("https://d/"), "doc_id")
    opened = hits.select(F.col("text_id").alias("doc_id"), F.col("pattern_id").alias("trial_id")).join(d.select("doc_id", said.alias("page")), "doc_id")
    opened = opened.select("trial_id", F.col("doc_id").alias("page_id"), url.alias("requested_url"), F.concat(F.lit("http://www.d/"), "doc_id", F.lit("/")).alias("final_url"), "page")
    cited = opened.groupBy("trial_id").agg(F.collect_set("final_url").alias("found"))
    trial = b.join(cited, "trial_id", "left").withColumn("citations", F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array(F.lit("https://d/none"))))
    return trial.drop("found"), opened


@query("join_05_cited_pages", "SELECT b.item_id AS trial_id, d.doc_id AS page_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def cited_pages(spark, sf_dir):
    return evidence.cited_pages(*_evidence(spark, sf_dir))


def _judged_sql() -> str:
    """Windows about answers by positions in lists, and what they say, for the pages of _evidence."""
    word, fold = "[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*", lambda x: f"lower(replace({x}, 'ß', 'ss'))"
    rest, stop = "[^\\p{L}\\p{N}]+$", "[" + ", ".join(f"'{w}'" for w in [*T.LINK_STOPWORDS, *T.QUESTION_WORDS]) + "]"
    terms = lambda x: _TERMS.replace("text", x)
    told = f"list_filter({terms('win')}, lambda t: NOT list_contains({stop}, t))"
    denied = "regexp_matches(regexp_replace(win, '(?i)\\bnot\\sonly\\b', 'only', 'g'), '(?i)\\b(?:did|does|do|is|are|was|were|has|have|had|can|could|would)\\s+not\\s+|\\bnever\\b|\\b(?:incorrectly|falsely)\\s+(?:attributed|credited|identified|reported)\\b|\\b(?:misattributed|disputed)\\b')"
    return f"""o AS (SELECT item_id AS trial_id, doc_id AS page_id, b.text AS question, array_to_string(string_split(b.text, ' ')[1:4], ' ') AS answer, CASE WHEN doc_id % 4 = 1 THEN replace(d.text, ', ', ' is not ') ELSE d.text END AS page
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
 x AS (SELECT *, regexp_extract_all(page, '{word}[^\\p{{L}}\\p{{N}}]*') AS pieces, list_transform(regexp_extract_all(answer, '{word}'), lambda t: {fold("t")}) AS a FROM o),
 y AS (SELECT *, list_transform(pieces, lambda t: {fold(f"regexp_replace(t, '{rest}', '')")}) AS w FROM x),
 z AS (SELECT trial_id, page_id, pieces, len(a) AS n, list_filter(list_filter({terms("question")}, lambda t: NOT list_contains({stop}, t)), lambda t: NOT list_contains({terms("answer")}, t)) AS relation, unnest(list_filter(range(1, len(w) - len(a) + 2), lambda i: w[i:i + len(a) - 1] = a)) AS i FROM y WHERE len(a) > 0),
 v AS (SELECT trial_id, page_id, relation, regexp_replace(array_to_string(pieces[greatest(1, i - 24):i + n + 23], ''), '{rest}', '') AS win FROM z),
 u AS (SELECT trial_id, page_id, {denied} AS denied, len(relation) AS n, len(list_intersect(relation, {told})) AS about FROM v),
 t AS (SELECT trial_id, page_id, count(*) AS n_windows, bool_or(denied AND (n = 0 OR about > 0)) AS contradicts, bool_or(NOT denied AND n > 0 AND about >= least(n, 2)) AS supports FROM u GROUP BY ALL),
 q AS (SELECT trial_id, page_id, list_filter({terms("question")}, lambda t: NOT list_contains({_STOP}, t)) AS q, {terms("page")} AS p, answer FROM o),
 judged AS (SELECT trial_id, page_id, answer, coalesce(n_windows, 0) AS n_windows, coalesce(contradicts, false) AS contradicts, coalesce(supports, false) AS supports,
  len(q) > 0 AND len(list_intersect(q, p)) >= least(len(q), 8, greatest(2, (len(q) + 5) // 6)) AS relevant FROM q LEFT JOIN t USING (trial_id, page_id))"""


@query("txt_09_11_windows", f"WITH {_judged_sql()} SELECT trial_id, page_id, n_windows, contradicts, supports, relevant FROM judged")
def judged_windows(spark, sf_dir):
    trial, opened = _evidence(spark, sf_dir)
    pairs = opened.select("trial_id", "page_id").join(trial.select("trial_id", "question", "answer"), "trial_id")
    return evidence.judged_pages(pairs, opened.select("page_id", "page").dropDuplicates(["page_id"]))


@query("agg_27_verdicts", f"""WITH {_judged_sql()}, s AS (SELECT trial_id, count(*) AS n_pages, bool_or(n_windows > 0) AS stated, bool_or(contradicts) AS contradicted, bool_or(supports) AS supported, count(*) FILTER (relevant) AS n_relevant FROM judged GROUP BY trial_id)
 SELECT b.item_id AS trial_id, CASE WHEN n_pages IS NULL THEN 'no cited page opened' WHEN NOT regexp_matches(array_to_string(string_split(text, ' ')[1:4], ' '), '[\\p{{L}}\\p{{N}}]') THEN 'no searchable answer'
  WHEN contradicted THEN 'contradicted' WHEN NOT stated THEN 'not supported' WHEN n_relevant < 2 AND NOT supported THEN 'too few relevant pages' ELSE 'ok' END AS verdict FROM benchmark b LEFT JOIN s ON s.trial_id = b.item_id""")  # fmt: skip
def verdicts(spark, sf_dir):
    return evidence.verdicts(*_evidence(spark, sf_dir))


@query("txt_14_abstentions", """SELECT doc_id, regexp_matches(trim(CASE doc_id % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'insufficient evidence to say' WHEN 2 THEN 'no answer' ELSE text END), '(?i)^(unknown|none|n/?a|inconclusive|undetermined|insufficient evidence|no answer)(\\b.*)?$') AS abstains FROM documents""")
def abstentions(spark, sf_dir):
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, "Unknown").when(k == 1, "insufficient evidence to say").when(k == 2, "no answer").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.is_abstention(answer).alias("abstains"))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_BUSY = lambda x: f"list_filter({_TERMS.replace('text', x)}, lambda w: NOT list_contains({_STOP}, w))"


@query("win_09_top_04_passages", f"""WITH d AS (SELECT doc_id % 20 AS g, doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n+') AS parts FROM documents),
 r AS (SELECT g, doc_id, unnest(parts) AS raw, unnest(range(0, len(parts))) AS passage_no FROM d), p AS (SELECT g, doc_id, passage_no, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS passage FROM r),
 f AS (SELECT *, {_BUSY('passage')} AS terms, regexp_extract(passage, '(?i)\\b(?:according to|attributed to|credited (?:to|with)|documented by|described by|reported by|written by)\\b(.{{0,120}})', 1) AS said FROM p
  WHERE length(passage) >= 40 AND len(regexp_extract_all(lower(regexp_replace(passage, '\\[[^\\]]+\\]\\([^)]+\\)', ' ', 'g')), '[a-z0-9]+')) >= 8 AND len(regexp_extract_all(lower(regexp_replace(passage, '\\[[^\\]]+\\]\\([^)]+\\)', ' ', 'g')), '[a-z0-9]+')) * 3 >= len(regexp_extract_all(lower(passage), '[a-z0-9]+'))),
 q AS (SELECT item_id % 20 AS g, {_BUSY('text')} AS asked FROM benchmark), o AS (SELECT f.g, doc_id, passage_no, max(len(list_intersect(terms, asked))) AS overlap FROM f JOIN q ON q.g = f.g GROUP BY ALL),
 s AS (SELECT f.*, coalesce(overlap, 0) AS overlap, len(list_intersect(terms, {_LIST(T.SIGNAL_TERMS)})) AS signal, len(list_intersect(terms, {_LIST(T.RESEARCH_TERMS)})) AS research, regexp_matches(said, '\\b[A-Z][A-Za-z''’-]+(?:\\s+[A-Z][A-Za-z''’-]+)+\\b') AS named FROM f LEFT JOIN o USING (g, doc_id, passage_no)),
 c AS (SELECT *, overlap * 10 + signal * 24 + research * 2 + CASE WHEN named THEN 80 ELSE 0 END AS score FROM s WHERE overlap >= 2 OR signal > 0), n AS (SELECT *, row_number() OVER (PARTITION BY g, doc_id ORDER BY score DESC, passage_no) AS nth FROM c),
 k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, doc_id, passage_no) AS strength FROM n WHERE nth <= 2)
 SELECT g AS "group", doc_id, passage_no, score, row_number() OVER (PARTITION BY g ORDER BY strength DESC) AS place, CASE WHEN length(passage) <= 1600 THEN passage ELSE left(passage, 770) || chr(10) || '...[' || (length(passage) - 1540) || ' chars omitted]...' || chr(10) || right(passage, 770) END AS passage FROM k WHERE strength <= 6""")  # fmt: skip
def passages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("group"), "doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    q = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 20).alias("group"), F.col("text").alias("query"))
    return pages.passages(d, q)


@query("top_03_related_links", f"""WITH l AS (SELECT page_id, url AS page_url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS base, unnest(regexp_extract_all(html, {_A}, 1)) AS href, unnest(regexp_extract_all(html, {_A}, 2)) AS said, unnest(range(0, len(regexp_extract_all(html, {_A})))) AS i FROM pages),
 u AS (SELECT page_id, page_url, base || {_PLAIN.format('href')} AS link, {_PLAIN.format('said')} AS text, i FROM l), f AS (SELECT page_id, page_url, link, min(i) AS i, arg_min(text, i) AS text FROM u GROUP BY page_id, page_url, link),
 r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place FROM f), e AS (SELECT page_id % 10 AS g, page_url, regexp_replace(link, '#.*$', '') AS link, text, page_id * 1000 + place AS o FROM r WHERE place <= 80),
 b AS (SELECT g, link, min(o) AS o, arg_min(page_url, o) AS page_url, arg_min(text, o) AS text FROM e GROUP BY g, link), a AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM pages WHERE page_id % 4 = 0 AND page_id % 10 = g AND url = link)),
 t AS (SELECT *, text || ' ' || replace(regexp_extract(link, '://[^/?#]*([^?#]*)', 1), '/', ' ') AS words FROM a), w AS (SELECT *, {_BUSY('words')} AS terms FROM t), q AS (SELECT item_id % 10 AS g, {_BUSY('text')} AS asked FROM benchmark),
 s AS (SELECT w.g, w.link, any_value(w.o) AS o, coalesce(max(len(list_intersect(w.terms, q.asked))), 0) AS shared, any_value(len(list_intersect(w.terms, {_LIST(T.RESEARCH_TERMS)}))) AS research FROM w LEFT JOIN q ON q.g = w.g GROUP BY w.g, w.link),
 k AS (SELECT *, shared * 10 + research * 3 + 2 AS score FROM s WHERE shared >= 2 OR research >= 2), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, o) AS place FROM k) SELECT g AS "group", link, score, place FROM n WHERE place <= 12""")  # fmt: skip
def related_links(spark, sf_dir):
    ex = pages.links(pages.extract(table(spark, sf_dir, "pages"))).join(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url")), "page_id")
    rows = ex.select((F.col("page_id") % 10).alias("group"), "page_url", "link", "text", (F.col("page_id") * 1000 + F.col("place")).alias("order"))
    q = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 10).alias("group"), F.col("text").alias("query"))
    opened = table(spark, sf_dir, "pages").where("page_id % 4 = 0").select((F.col("page_id") % 10).alias("group"), "url")
    return pages.related_links(rows, q, opened, 12)


def _log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    good = F.concat(F.lit('{"run_id":"r'), F.col("event_id") % 3, F.lit('","item_id":"i'), "user_id", F.lit('","subset_rank":'), F.when(F.col("event_id") % 50 == 7, F.lit('"x"')).otherwise(F.col("user_id").cast("string")),
                    F.lit(',"attempt":1,"status":"'), F.when(F.col("event_type") == "error", "error").otherwise("completed"), F.lit('","finished_at":"2024-01-01T00:00:00+00:00","correct":'),
                    F.when(F.col("event_type") == "purchase", "true").when(F.col("event_type") == "error", "null").otherwise("false"), F.lit("}"))
    value = F.when(F.col("event_id") % 97 == 0, F.left(good, F.lit(20))).when(F.col("event_id") % 101 == 0, F.concat(F.lit("["), good, F.lit("]"))).otherwise(good)
    return e.select(F.concat(F.lit("run-"), F.col("event_id") % 3).alias("source"), F.col("event_id").alias("line_no"), value.alias("value"))


_LINES = """g AS (SELECT event_id, event_type, '{"run_id":"r' || event_id % 3 || '","item_id":"i' || user_id || '","subset_rank":' || CASE WHEN event_id % 50 = 7 THEN '"x"' ELSE CAST(user_id AS VARCHAR) END || ',"attempt":1,"status":"' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'completed' END
 || '","finished_at":"2024-01-01T00:00:00+00:00","correct":' || CASE WHEN event_type = 'purchase' THEN 'true' WHEN event_type = 'error' THEN 'null' ELSE 'false' END || '}' AS good FROM events),
 l AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN left(good, 20) WHEN event_id % 101 = 0 THEN '[' || good || ']' ELSE good END AS value, CASE WHEN event_id % 97 = 0 THEN 'corrupt_record' WHEN event_id % 101 = 0 THEN 'invalid_record' END AS problem FROM g)"""


@query("src_01_trial_log", f"""WITH {_LINES} SELECT event_id AS line_no, problem, CASE WHEN problem IS NOT NULL THEN length(value) END AS raw_line_chars, CASE WHEN problem IS NOT NULL THEN sha256(value) END AS raw_line_sha256,
 problem IS NULL AND event_id % 50 <> 7 AS terminal, NOT (problem IS NULL AND event_type <> 'error') AS unscored, NOT (problem IS NULL AND event_id % 50 <> 7) AS quarantined FROM l""")  # fmt: skip
def trial_log(spark, sf_dir):
    return trial_logs.parse_lines(_log_lines(spark, sf_dir)).drop("source", "record")


@query("src_04_public_trials", with_trials("SELECT run_id, count(*) AS n, count(*) FILTER (coalesce(correct, false)) AS n_correct, round(sum(CASE WHEN attempt % 5 <> 0 THEN duration_seconds END), 4) AS seconds FROM trials GROUP BY run_id"))
def public_trials(spark, sf_dir):
    text = trials(spark, sf_dir).select("run_id", F.col("source_index").cast("string").alias("source_index"), F.col("attempt").cast("string").alias("attempt"), F.initcap(F.col("correct").cast("string")).alias("correct"),
                                        F.when(F.col("attempt") % 5 == 0, "None").otherwise(F.col("metrics.duration_seconds").cast("string")).alias("duration_seconds"), F.col("metrics.total_cost_usd").cast("string").alias("total_cost_usd"))
    runs = [trial_logs.parse_public(text.where(F.col("run_id") == r)).withColumn("run_id", F.lit(r)) for r in ("run_a", "run_b")]
    both = runs[0].unionByName(runs[1])
    return rounded(both.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.sum("duration_seconds").alias("seconds")), "seconds", digits=4)


@query("src_04_duplicate_keys", with_trials("SELECT source_index, attempt, count(*) AS n FROM trials GROUP BY source_index, attempt HAVING count(*) > 1"))
def duplicate_keys(spark, sf_dir):
    return trial_logs.duplicate_keys(trials(spark, sf_dir))


@query("snk_01_public_projection", with_trials("""SELECT run_id, item_id, source_index, subset_rank, attempt, status, correct, confidence, n_citations AS citation_count, duration_seconds, steps, search_calls, page_opens, input_tokens, output_tokens, total_cost AS total_cost_usd FROM trials"""))
def public_projection(spark, sf_dir):
    return trial_logs.public_projection(trials(spark, sf_dir))


@query("snk_03_cache_latest", """SELECT event_type AS namespace, sha256(props) AS cache_key, max_by(CAST(event_id AS VARCHAR), (ts, CAST(event_id AS VARCHAR))) AS response, max(ts) AS created_at FROM events GROUP BY event_type, props""")
def cache_latest(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("namespace"), trial_logs.cache_key(F.col("props")).alias("cache_key"), F.col("event_id").cast("string").alias("response"), F.col("ts").alias("created_at"))
    return trial_logs.latest_entries(log)


@query("src_05_payloads", """SELECT page_id // 50 AS query_id, CASE page_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'organic' ELSE 'results' END AS provider, 't' || page_id AS title, url, 's' AS snippet, CASE WHEN page_id % 3 = 1 THEN 4 ELSE 2 END AS rank FROM pages""")
def payloads(spark, sf_dir):
    hit = lambda u, s, more="": F.concat(F.lit('[{"title":"x","' + u + '":""},{"title":"t'), "page_id", F.lit('","' + u + '":"'), "url", F.lit('","' + s + '":"s"' + more + "}]"))
    k = F.col("page_id") % 3
    text = F.when(k == 0, F.concat(F.lit('{"web":{"results":'), hit("url", "description"), F.lit("}}"))).when(k == 1, F.concat(F.lit('{"organic":'), hit("link", "snippet", ',"position":4'), F.lit("}"))).otherwise(F.concat(F.lit('{"results":'), hit("url", "content"), F.lit("}")))
    p = table(spark, sf_dir, "pages").select((F.col("page_id") / 50).cast("long").alias("query_id"), F.when(k == 0, "web").when(k == 1, "organic").otherwise("results").alias("provider"), F.lit(0).alias("offset"), text.alias("payload"))
    return fusion.read_payloads(p, 10)


@query("src_07_usage", """SELECT 'm' || page_id % 3 AS model, sum(page_id + 1)::BIGINT AS input_tokens, sum(page_id * 2 + 1)::BIGINT AS output_tokens, sum(page_id % 5)::BIGINT AS cached_tokens, round(sum((page_id + 1) * 2.0 + (page_id * 2 + 1) * 8.0) / 1e6, 6) AS cost_usd FROM pages GROUP BY page_id % 3""")
def usage(spark, sf_dir):
    i, o, c = (F.col("page_id") + 1).cast("string"), (F.col("page_id") * 2 + 1).cast("string"), (F.col("page_id") % 5).cast("string")
    new = F.concat(F.lit('{"input_tokens":'), i, F.lit(',"output_tokens":'), o, F.lit(',"input_tokens_details":{"cached_tokens":'), c, F.lit("}}"))
    old = F.concat(F.lit('{"prompt_tokens":'), i, F.lit(',"completion_tokens":'), o, F.lit(',"prompt_tokens_details":{"cached_tokens":'), c, F.lit("}}"))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("m"), F.col("page_id") % 3).alias("model"), F.when(F.col("page_id") % 2 == 0, new).otherwise(old).alias("usage"))
    prices = p.select("model").distinct().select("model", F.lit(2.0).alias("input_price"), F.lit(8.0).alias("output_price"))
    out = trial_logs.usage(p, prices).groupBy("model").agg(*[F.sum(k).alias(k) for k in ("input_tokens", "output_tokens", "cached_tokens", "cost_usd")])
    return rounded(out, "cost_usd")
