"""Finding public sources of answers: scoring hits and pages, verifying them, joining cached and mapped evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.functions import terms as T
from evalgrain.functions import urls as U
from evalgrain.functions.texts import truncate_middle
from evalgrain.operators import fusion

_CITATIONS = "struct<choices:array<struct<message:struct<annotations:array<struct<url_citation:struct<url:string,title:string,content:string>>>>>>>"


def any_alias(text: Column, aliases: Column) -> Column:
    """Whether any of the aliases occurs in the text, in any case."""
    folded = F.lower(text)
    return F.exists(aliases, lambda a: (F.length(a) > 0) & F.contains(folded, F.lower(a)))


def scored_hits(hits: DataFrame, items: DataFrame, low_value_hosts: list[str], keep: int = 12) -> DataFrame:
    """The best-scoring hit of each (item, URL), `keep` an item.

    hits: item_id, rank, url, title, snippet; items: item_id, question, aliases. A hit scores for an alias in its text, for
    shared terms, for its rank, and against its host.
    """
    rows = fusion.host_penalty(hits, low_value_hosts).join(items.select("item_id", T.terms(F.col("question")).alias("asked"), "aliases"), "item_id")
    text = F.concat_ws(" ", "title", "snippet")
    score = fusion.hit_score(any_alias(text, F.col("aliases")), T.overlap(T.terms(text), F.col("asked")), F.col("rank"), F.col("penalty"))
    best = rows.withColumn("score", score).groupBy("item_id", "url").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "rank", "url"))
    return best.withColumn("place", place).where(F.col("place") <= keep)


def answer_window(text: Column, aliases: Column, radius: int = 1_200) -> Column:
    """The text within `radius` characters of the first place of any alias (its start if there is none)."""
    places = F.filter(F.transform(aliases, lambda a: F.when(F.length(a) > 0, F.instr(F.lower(text), F.lower(a))).otherwise(0)), lambda p: p > 0)
    center = F.coalesce(F.array_min(places) - 1, F.lit(0))
    start = F.greatest(center - radius, F.lit(0))
    return F.substring(text, start + 1, center + radius - start)


def verified_pages(pages: DataFrame, items: DataFrame, low_value_hosts: list[str]) -> DataFrame:
    """pages (item_id, page_id, url, text) with reason: null for a page that bears an answer out.

    A page must hold an alias, be on no low-value host, and have two of the question's terms (three if the answer is a
    plain number) near the first alias.
    """
    asked = F.array_except(T.terms(F.col("question"), T.LINK_STOPWORDS), F.flatten(F.transform("aliases", lambda a: T.terms(a))))
    plain = F.exists("aliases", lambda a: F.trim(a).rlike(r"^[0-9][0-9.,:%]*$"))
    rows = fusion.host_penalty(pages, low_value_hosts).join(items.select("item_id", "aliases", asked.alias("asked"), plain.alias("plain")), "item_id")
    shared = T.overlap(T.terms(answer_window(F.col("text"), F.col("aliases"))), F.col("asked"))
    reason = (
        F.when(F.col("penalty") > 0, "host").when(~any_alias(F.col("text"), F.col("aliases")), "no alias")
        .when(shared < F.when(F.col("plain"), 3).otherwise(2), "context")
    )
    return rows.select("item_id", "page_id", shared.alias("shared_terms"), reason.alias("reason"))


def discovery_metrics(verified: DataFrame, selected: DataFrame) -> DataFrame:
    """Per item: pages fetched, verified, rejected by reason, selected."""
    reason = lambda r: F.count_if(F.col("reason") == r)
    counts = verified.groupBy("item_id").agg(
        F.count("*").alias("fetched"), F.count_if(F.col("reason").isNull()).alias("verified"), reason("host").alias("rejected_host"),
        reason("no alias").alias("rejected_alias"), reason("context").alias("rejected_context"),
    )
    chosen = selected.groupBy("item_id").agg(F.count("*").alias("selected"))
    return counts.join(chosen, "item_id", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))


def with_cached_sources(records: DataFrame, cache: DataFrame) -> DataFrame:
    """records (item_id, sources) with cached sources where they have none; `applied` says where."""
    both = records.join(cache.select("item_id", F.col("sources").alias("cached")), "item_id", "left")
    none = F.coalesce(F.size("sources"), F.lit(0)) <= 0
    applied = none & (F.coalesce(F.size("cached"), F.lit(0)) > 0)
    return both.withColumn("applied", applied).withColumn("sources", F.when(F.col("applied"), F.col("cached")).otherwise(F.col("sources"))).drop("cached")


def pair_mismatches(routes: DataFrame, oracles: DataFrame) -> DataFrame:
    """Rows (row, route_item, oracle_item) of two tables read side by side whose items differ or are missing."""
    both = routes.select("row", F.col("item_id").alias("route_item")).join(oracles.select("row", F.col("item_id").alias("oracle_item")), "row", "full_outer")
    return both.where(~F.col("route_item").eqNullSafe(F.col("oracle_item")))


def source_constraints(matrix: DataFrame) -> DataFrame:
    """item_id, source_id and its constraints in order of first mention: matrix (item_id, cell, constraint_id, source_id)."""
    first = matrix.where("trim(source_id) <> '' AND trim(constraint_id) <> ''").groupBy("item_id", "source_id", "constraint_id").agg(F.min("cell").alias("cell"))
    listed = F.array_sort(F.collect_list(F.struct("cell", "constraint_id")))
    return first.groupBy("item_id", "source_id").agg(F.transform(listed, lambda x: x["constraint_id"]).alias("constraints"))


def source_hints(excerpts: DataFrame, limit: int = 3, chars: int = 2_000) -> DataFrame:
    """item_id, source_id and its first distinct excerpts (item_id, source_id, pos, excerpt): few, so they are collected."""
    cut = F.left(F.trim("excerpt"), F.lit(chars))
    first = excerpts.withColumn("hint", cut).where("hint <> ''").groupBy("item_id", "source_id", "hint").agg(F.min("pos").alias("pos"))
    few = first.withColumn("n", F.row_number().over(Window.partitionBy("item_id", "source_id").orderBy("pos", "hint"))).where(F.col("n") <= limit)
    return few.groupBy("item_id", "source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "hint"))), lambda x: x["hint"]).alias("hints"))


def title_mirror(query: Column, title: Column, url: Column, snippet: Column, stopwords=T.LINK_STOPWORDS) -> Column:
    """Pages that turn a long query into a result: most of it in title and path, and a snippet that repeats it or adds little."""
    words = lambda c: F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 1) & ~w.isin(stopwords))
    q, t = F.array_distinct(words(query)), F.array_distinct(words(title))
    p = F.array_distinct(words(F.regexp_replace(U.unquoted(U.path(url)), "-", " ")))
    said = words(snippet)
    n = F.size(q)
    in_title, in_path = T.overlap(q, t), T.overlap(q, p)
    repeated = F.size(F.filter(said, lambda w: F.array_contains(q, w)))
    unique = F.array_distinct(said)
    novel = F.size(F.array_except(unique, q))
    stuffed = (F.size(said) == 0) & (in_title >= 0.8 * n) & (in_path >= 0.8 * n) & (F.size(t) >= n + 3) & (F.size(p) >= n + 3)
    restated = (n >= 7) & (F.size(t) >= 7) & (F.size(p) >= 7) & (in_title >= 0.6 * n) & (in_path >= 0.6 * n) & ((repeated >= 2 * n) | (novel <= 0.55 * F.greatest(F.lit(1), F.size(unique))))
    return (n >= 3) & (stuffed | restated)


def citation_hits(payloads: DataFrame, count: int, max_chars: int) -> DataFrame:
    """URL citations of chat payloads as hits: payloads (query_id, query, payload); the first of a URL that is no mirror."""
    parsed = payloads.select("query_id", "query", F.from_json("payload", _CITATIONS).alias("p"))
    rows = parsed.select("query_id", "query", F.posexplode(F.element_at("p.choices", 1)["message"]["annotations"]).alias("pos", "a"))
    rows = rows.select("query_id", "query", "pos", F.rtrim(F.trim("a.url_citation.url"), F.lit("\\")).alias("url"), "a.url_citation.title", F.trim(F.coalesce("a.url_citation.content", F.lit(""))).alias("snippet")).where("url <> ''")
    rows = rows.withColumn("title", F.trim(F.coalesce("title", "url")))
    rows = rows.where(~title_mirror(F.col("query"), F.col("title"), F.col("url"), F.col("snippet")))
    first = rows.groupBy("query_id", "url").agg(F.min(F.struct("pos", "title", "snippet")).alias("h"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("h.pos"))
    return first.select("query_id", "url", "h.title", truncate_middle(F.col("h.snippet"), max_chars).alias("snippet"), rank.alias("rank")).where(F.col("rank") <= count)


def lock_digests(locks: DataFrame, fields: list[str]) -> DataFrame:
    """run_id and the SHA-256 of its lock's fields in a fixed order: locks (run_id, fields map)."""
    text = F.to_json(F.array(*[F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("null")) for f in sorted(fields)]))
    return locks.select("run_id", F.sha2(text, 256).alias("digest"))


def resume_check(stored: DataFrame, current: DataFrame) -> DataFrame:
    """run_id, compatible: equal resume hashes, else (where one is missing) equal replay hashes."""
    both = stored.select("run_id", F.col("resume_hash").alias("r1"), F.col("replay_hash").alias("p1")).join(current.select("run_id", F.col("resume_hash").alias("r2"), F.col("replay_hash").alias("p2")), "run_id")
    return both.select("run_id", F.coalesce(F.col("r1") == F.col("r2"), F.col("p1") == F.col("p2"), F.lit(False)).alias("compatible"))
