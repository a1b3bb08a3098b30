"""Search results: reading payloads, fusing lists, choosing candidates, filtering mirrors, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.functions import terms as T
from evalgrain.functions import urls as U

# Snippets that show no page, and hosts whose pages are no evidence.
LOADING = ("loading", "loading...", "loading…")
ACCESS_GATES = (
    "this is an adult website", "age-restricted content", "tap anywhere to continue", "i am 18 or older enter", "18+ only",
    "confirm you are over 18 years old", "continue 18+ verified", "premium access portal", "unlock access tap to enter",
)

_PAYLOADS = {
    "web": "struct<web:struct<results:array<struct<title:string,url:string,description:string,extra_snippets:array<string>>>>>",
    "organic": "struct<organic:array<struct<title:string,link:string,snippet:string,position:int>>>",
    "results": "struct<results:array<struct<title:string,url:string,content:string>>>",
}


def fuse(hits: DataFrame, count: int, group: str = "query_id") -> DataFrame:
    """Round-robin fusion of ranked lists: by place in the list, then list; the first of a URL key stays; cut at count.

    hits: group, list (an order of the lists), rank, url. Two windows on the group; the second has the group limit.
    """
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy(group, "list").orderBy("rank", "url")))
    keyed = placed.withColumn("key", U.merge_key(F.col("url")))
    first = keyed.withColumn("again", F.row_number().over(Window.partitionBy(group, "key").orderBy("place", "list"))).where("again = 1")
    ranked = first.withColumn("fused_rank", F.row_number().over(Window.partitionBy(group).orderBy("place", "list")))
    return ranked.where(F.col("fused_rank") <= count).drop("again", "key", "place")


def list_status(lists: DataFrame, group: str = "query_id") -> DataFrame:
    """Groups of which every list failed (lists: group, list, ok): one failed list is tolerated, all failed is an error."""
    return lists.groupBy(group).agg(F.bool_or("ok").alias("usable")).where(~F.col("usable")).select(group, F.lit("all lists failed").alias("error"))


def candidates(hits: DataFrame, limit: int, group: str = "query_id") -> DataFrame:
    """Distinct URLs over a group's lists, a list's first hits before any list's second ones."""
    url = F.trim("url")
    placed = hits.withColumn("url", url).where("url <> ''").withColumn("place", F.row_number().over(Window.partitionBy(group, "list").orderBy("rank")))
    first = placed.groupBy(group, "url").agg(F.min(F.struct("place", "list")).alias("at"))
    return first.withColumn("choice", F.row_number().over(Window.partitionBy(group).orderBy("at"))).where(F.col("choice") <= limit).select(group, "url", "choice")


_LINK = r"https?://[^\s<>\]\[{}|\\^`\"]+"


def wide_candidates(citations: DataFrame, hits: DataFrame, highlights: DataFrame, said: DataFrame, limit: int, group: str = "query_id") -> DataFrame:
    """group, url, choice: what to open next, from all that helpers and searches gave.

    One citation of every helper before any second one (citations: group, list, rank, url), then hits in the same way (hits:
    alike), then passages (highlights: group, rank, url), then links in what helpers said (said: group, list, text). The
    first of a candidate key counts; fragments and punctuation at the end are cut. One union and two windows on the group.
    """
    part = lambda df, k, place, order, url: df.select(group, F.lit(k).alias("part"), place.cast("long").alias("place"), order.cast("long").alias("order"), url.alias("url"))
    none = F.lit(0)
    by_list = lambda df: F.row_number().over(Window.partitionBy(group, "list").orderBy("rank"))
    links = said.select(group, "list", F.posexplode(F.regexp_extract_all("text", F.lit(_LINK), 0)).alias("at", "url"))
    rows = part(citations, 0, by_list(citations), F.col("list"), F.col("url")).unionByName(part(hits, 1, by_list(hits), F.col("list"), F.col("url")))
    rows = rows.unionByName(part(highlights, 2, F.col("rank"), none, F.col("url"))).unionByName(part(links, 3, F.col("list"), F.col("at"), F.col("url")))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.trim("url"), _LINK, 0), "#.*$", ""), r"[.,;:!?)\"']+$", "")
    rows = rows.withColumn("url", clean).where("url <> ''").withColumn("key", F.rtrim(F.lower("url"), F.lit("/")))
    at = F.struct("part", "place", "order")
    first = rows.groupBy(group, "key").agg(F.min(at).alias("at"), F.min_by("url", at).alias("url"))
    return first.withColumn("choice", F.row_number().over(Window.partitionBy(group).orderBy("at"))).where(F.col("choice") <= limit).select(group, "url", "choice")


def unopened(chosen: DataFrame, opened: DataFrame, limit: int, group: str = "query_id") -> DataFrame:
    """Candidates that are not opened yet; groups in which all are opened fall back to the opened ones."""
    marked = chosen.join(opened.select(group, "url").distinct().withColumn("opened", F.lit(True)), [group, "url"], "left")
    is_new = F.col("opened").isNull()
    any_new = F.max(is_new).over(Window.partitionBy(group))
    kept = marked.withColumn("any_new", any_new).where(is_new | ~F.col("any_new"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("choice"))
    return kept.withColumn("place", place).where(F.col("place") <= limit).select(group, "url", "place", (~F.col("any_new")).alias("fallback"))


def read_payloads(payloads: DataFrame, count: int) -> DataFrame:
    """JSON payloads of search APIs to one hit schema: query_id, provider, title, url, snippet, rank.

    rank is offset * count + place, or the provider's own position; hits without URL go after they are numbered.
    """
    p = payloads.select("*", *[F.from_json("payload", s).alias(f"p_{k}") for k, s in _PAYLOADS.items()])
    same = lambda x, url, text, own: F.transform(x, lambda h: F.struct(h["title"].alias("title"), h[url].alias("url"), h[text].alias("snippet"), (h[own] if own else F.lit(None).cast("int")).alias("position")))
    hits = F.coalesce(
        same(F.col("p_web.web.results"), "url", "description", None),
        same(F.col("p_organic.organic"), "link", "snippet", "position"),
        same(F.col("p_results.results"), "url", "content", None),
    )
    rows = p.select("query_id", "provider", F.coalesce("offset", F.lit(0)).alias("offset"), F.posexplode(hits).alias("i", "hit"))
    rank = F.coalesce("hit.position", F.col("offset") * count + F.col("i") + 1)
    return rows.select("query_id", "provider", "hit.title", "hit.url", "hit.snippet", rank.alias("rank")).where("coalesce(url, '') <> ''")


def unusable_snippet(snippet: Column) -> Column:
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(snippet, F.lit("")), r"\s+", " ")))
    gated = F.lit(False)
    for phrase in ACCESS_GATES:
        gated = gated | text.contains(phrase)
    return text.isin(*LOADING) | gated


def unusable_hit(query: Column, title: Column, url: Column, benchmark: str) -> Column:
    """Social topic pages, and hits that name the benchmark though the query doesn't."""
    social = (U.bare_host(url) == "instagram.com") & F.lower(U.path(url)).startswith("/popular/")
    named = F.lower(F.concat_ws("\n", title, url)).contains(benchmark) & ~F.lower(query).contains(benchmark)
    return social | named


def host_penalty(hits: DataFrame, low_value_hosts: list[str], penalty: float = 25.0) -> DataFrame:
    """hits with penalty: a host counts if it or a parent domain is listed. The list is small and part of the plan."""
    h = U.bare_host(F.col("url"))
    listed = F.lit(False)
    for domain in low_value_hosts:
        listed = listed | (h == domain) | h.endswith("." + domain)
    return hits.withColumn("penalty", F.when(listed, penalty).otherwise(0.0))


def path_mirror(query: Column, url: Column) -> Column:
    """Short form: at least five terms on both sides, five shared, and 0.65 of the query's."""
    q, p = T.terms(query), F.array_distinct(F.regexp_extract_all(F.lower(U.unquoted(U.path(url))), F.lit("[a-z0-9]+"), 0))
    both = T.overlap(q, p)
    return (F.size(q) >= 5) & (F.size(p) >= 5) & (both >= 5) & (both >= 0.65 * F.size(q))


def query_mirror(question: Column, url: Column) -> Column:
    """Pages generated from queries: social topics, job-search slugs, and long paths that restate the question."""
    decoded = U.unquoted(U.path(url))
    lower = F.lower(decoded)
    slug_terms = T.terms(lower, T.LINK_STOPWORDS)
    jobs = (lower.contains("-jobs") | lower.contains("/jobs/")) & (F.char_length(lower) >= 60) & (F.size(slug_terms) >= 7)
    social = (U.bare_host(url) == "instagram.com") & lower.startswith("/popular/")
    spaced = F.regexp_replace(decoded, "-", " ")
    q, p = T.terms(question, T.LINK_STOPWORDS), T.terms(spaced, T.LINK_STOPWORDS)
    both = T.overlap(q, p)
    solver = F.lower(spaced).rlike("crossword solver|crossword clue|question answer")
    long = (F.size(q) >= 7) & (F.char_length(spaced) >= 80) & (F.size(p) >= 8) & (both >= 8)
    covers = (both >= 0.5 * F.size(q)) | (both >= 0.65 * F.size(p)) | (solver & (both >= 0.5 * F.size(p)))
    return social | jobs | F.coalesce(long & covers, F.lit(False))


def audit(hits: DataFrame, question: str = "question") -> DataFrame:
    """Counters by provider: hits, mirrors and unusable snippets filtered, characters of what is left."""
    mirror = query_mirror(F.col(question), F.col("url"))
    bad = unusable_snippet(F.col("snippet"))
    judged = hits.withColumn("mirror", mirror).withColumn("bad", bad & ~F.col("mirror"))
    kept = ~F.col("mirror") & ~F.col("bad")
    return judged.groupBy("provider").agg(
        F.count("*").alias("n_results"), F.count_if("mirror").alias("filtered_mirrors"), F.count_if("bad").alias("unusable_snippets"),
        F.sum(F.when(kept, F.char_length("snippet")).otherwise(0)).alias("snippet_chars"),
    )


def host_diverse(scored: DataFrame, max_sources: int, group: str = "item_id") -> DataFrame:
    """Best score first, one row per URL; once two rows are chosen a host that has one is passed over.

    The greedy rule has a closed form: after URL dedup a row stays if it is among the first two or the first of its host.
    """
    order = [F.desc("score"), F.asc("url")]
    once = scored.withColumn("n", F.row_number().over(Window.partitionBy(group, "url").orderBy(*order))).where("n = 1")
    once = once.withColumn("host", U.bare_host(F.col("url"))).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    once = once.withColumn("of_host", F.row_number().over(Window.partitionBy(group, "host").orderBy(*order))).where("place <= 2 OR of_host = 1")
    chosen = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return once.withColumn("choice", chosen).where(F.col("choice") <= max_sources).drop("n", "place", "of_host", "host")


def hit_score(has_alias: Column, shared_terms: Column, rank: Column, penalty: Column) -> Column:
    return F.when(has_alias, 35.0).otherwise(0.0) + 3.0 * F.least(shared_terms, F.lit(12)) - 0.35 * F.least(F.greatest(rank - 1, F.lit(0)), F.lit(20)) - penalty


def page_score(base: Column, alias_near: Column, shared_terms: Column, length: Column) -> Column:
    return base + F.when(alias_near, 80.0).otherwise(0.0) + 2.0 * F.least(shared_terms, F.lit(18)) + F.least(length, F.lit(30_000)) / 10_000.0
