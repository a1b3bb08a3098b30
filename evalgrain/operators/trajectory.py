"""Action logs and message traces: streaks, budgets, novelty, curation and quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.functions import terms as T
from evalgrain.functions.replies import first_json_object, payload_fault
from evalgrain.functions.texts import truncate_middle
from evalgrain.sources.scratch import written

BUDGETS = ("searches", "opens", "finds", "chars")


def exact_repeats(queries: DataFrame, group: str = "conv_id") -> DataFrame:
    """queries (group, pos, query) with redundant: no terms at all, or the term set of an earlier query of the group."""
    keyed = queries.withColumn("term_key", T.term_set_key(F.col("query")))
    n = F.row_number().over(Window.partitionBy(group, "term_key").orderBy("pos"))
    return keyed.withColumn("redundant", (F.col("term_key") == "") | (n > 1)).drop("term_key")


def near_sets(sets: DataFrame, group: str, jaccard: float, least_union: int) -> DataFrame:
    """early, late: pairs of nodes of a group whose term sets are near. sets: group, node, place (what orders a group's nodes), terms (distinct).

    Two near sets share one of the first |Q| - ceil(jaccard |Q|) + 1 terms of either, whatever order all terms have; with
    the rarest first those keys meet few others. Sets too small to differ in a term and still be near have no partner.
    """
    able = sets.where(F.size("terms") * (1 - jaccard) >= jaccard - 1e-9) if jaccard < 1 else sets.limit(0)
    each = able.select("node", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    order = each.join(df, "term").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("by_rarity"))
    n = F.size("terms")
    keys = able.join(order, "node").withColumn("keys", F.slice("by_rarity", F.lit(1), n - F.ceil(jaccard * n - 1e-9).cast("int") + 1))
    rows = keys.select(F.col(group).alias("of"), "node", "place", "terms", F.explode(F.transform("keys", lambda k: k["term"])).alias("key"))
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in ("a", "b"))
    sizes = [F.size("terms_a"), F.size("terms_b")]
    met = F.col("of_a").eqNullSafe(F.col("of_b")) & (F.col("key_a") == F.col("key_b"))
    both = a.join(b, met).where(F.col("place_a") < F.col("place_b")).where(F.least(*sizes) >= jaccard * F.greatest(*sizes) - 1e-9)
    shared = F.size(F.array_intersect("terms_a", "terms_b"))
    union = sizes[0] + sizes[1] - shared
    return both.where((union >= least_union) & (shared >= jaccard * union)).select(F.col("node_a").alias("early"), F.col("node_b").alias("late")).distinct()


def first_come(near: DataFrame) -> DataFrame:
    """node of those that an earlier accepted node rules out: near (early, late), without cycles.

    In each round the nodes that nothing undecided is before are accepted, what is near them goes, and so do the pairs of what went. Rounds
    are as many as the longest chain of turns; each writes the pairs that are left, so no group is gathered and lineage stays short.
    """
    left, gone = written(near, "near"), []
    while not left.isEmpty():
        heads = left.select(F.col("early").alias("node")).join(left.select(F.col("late").alias("node")), "node", "left_anti").distinct()
        out = written(left.join(heads.withColumnRenamed("node", "early"), "early").select(F.col("late").alias("node")).distinct(), "gone")
        gone.append(out)
        for side in ("early", "late"):
            left = left.join(out.withColumnRenamed("node", side), side, "left_anti")
        left = written(left.select("early", "late"), "near")
    return reduce(DataFrame.unionByName, gone) if gone else left.select(F.col("early").alias("node"))


def novelty(queries: DataFrame, group: str = "conv_id", jaccard: float = 0.9, least_union: int = 5) -> DataFrame:
    """queries with redundant: no terms, the term set of an earlier query of the group, or near an earlier query that was itself accepted.

    Near sets are found by an equi-join on rare terms (near_sets()), then settled in order (first_come()): a group of any length
    is spread over the tasks. Of queries at one position the one whose terms come first in order is the earlier.
    """
    keyed = queries.withColumn("terms", F.array_sort(T.terms(F.col("query")))).withColumn("term_key", F.array_join("terms", " "))
    first = keyed.where("term_key <> ''").groupBy(group, "term_key").agg(F.min("pos").alias("first_pos"), F.any_value("terms").alias("terms"))
    first = written(first.withColumn("node", F.monotonically_increasing_id()), "first-queries")
    gone = first_come(near_sets(first.withColumn("place", F.struct("first_pos", "term_key")), group, jaccard, least_union))
    judged = first.join(gone.withColumn("near", F.lit(True)), "node", "left").select(group, "term_key", "first_pos", "near")
    out = keyed.join(judged.withColumnRenamed(group, "__group").withColumnRenamed("term_key", "__key"), F.col(group).eqNullSafe(F.col("__group")) & (F.col("term_key") == F.col("__key")), "left")
    redundant = (F.col("term_key") == "") | (F.col("pos") > F.col("first_pos")) | F.coalesce("near", F.lit(False))
    return out.withColumn("redundant", redundant).select(*queries.columns, "redundant")


def repeat_streaks(log: DataFrame, group: str = "user_id") -> DataFrame:
    """log (group, step, action, payload) with streak: how many times in a row the same action and payload has come."""
    w = Window.partitionBy(group).orderBy("step")
    same = F.lag("action").over(w).eqNullSafe(F.col("action")) & F.lag("payload").over(w).eqNullSafe(F.col("payload")) & (F.row_number().over(w) > 1)
    island = F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w)
    return log.withColumn("same", same).withColumn("island", island).withColumn("streak", F.row_number().over(Window.partitionBy(group, "island").orderBy("step"))).drop("same", "island")


def redundant_streaks(log: DataFrame, queries: DataFrame, group: str = "user_id") -> DataFrame:
    """repeat_streaks() in which an action of whose queries all are redundant repeats too: queries (group, pos, step, query).

    A repeat goes on with the streak; it doesn't become what the next action is compared with. streak is 0 for a fresh action.
    """
    judged = novelty(queries, group).groupBy(group, "step").agg(F.bool_and("redundant").alias("redundant"))
    w = Window.partitionBy(group).orderBy("step")
    rows = log.join(judged, [group, "step"], "left").withColumn("act", F.struct("action", "payload"))
    rows = rows.withColumn("last", F.last(F.when(~F.coalesce("redundant", F.lit(False)), F.col("act")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    again = F.coalesce("redundant", F.lit(False)) | F.coalesce(F.col("last") == F.col("act"), F.lit(False))
    rows = rows.withColumn("again", again).withColumn("island", F.sum(F.when(again, 0).otherwise(1)).over(w))
    return rows.withColumn("streak", F.sum(F.when(F.col("again"), 1).otherwise(0)).over(Window.partitionBy(group, "island").orderBy("step"))).select(*log.columns, "streak")


def search_streaks(log: DataFrame, threshold: int, searches=("search",), resets=("open",), group: str = "user_id") -> DataFrame:
    """log (group, step, action, ok) with search_streak (successful searches since the last successful reset) and inspect."""
    w = Window.partitionBy(group).orderBy("step")
    reset = F.col("action").isin(*resets) & F.col("ok")
    found = F.col("action").isin(*searches) & F.col("ok")
    island = log.withColumn("island", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    streak = F.sum(F.when(found, 1).otherwise(0)).over(Window.partitionBy(group, "island").orderBy("step"))
    return island.withColumn("search_streak", streak).withColumn("inspect", found & (streak >= threshold)).drop("island")


def budgets(steps: DataFrame, limits: dict[str, int], near: float = 0.8, group: str = "trial_id") -> DataFrame:
    """Running sums of the used amounts, the first budget over its limit, and whether any is near: steps (group, step, BUDGETS)."""
    w = Window.partitionBy(group).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = steps.select("*", *[F.sum(b).over(w).alias(f"total_{b}") for b in limits])
    over = F.coalesce(*[F.when(F.col(f"total_{b}") > limit, b) for b, limit in limits.items()])
    close = F.greatest(*[F.col(f"total_{b}") / limit for b, limit in limits.items()]) >= near
    return out.withColumn("over", over).withColumn("near", close)


def first_over(spent: DataFrame, group: str = "trial_id") -> DataFrame:
    """group, step and budget where a trial first went over a limit."""
    return spent.where("over IS NOT NULL").groupBy(group).agg(F.min("step").alias("step"), F.min_by("over", "step").alias("budget"))


def clip_batches(actions: DataFrame, left: Column, items: str = "queries") -> DataFrame:
    """Batches cut to what is left of a budget; an empty one is null."""
    cut = F.slice(items, F.lit(1), F.greatest(left, F.lit(0)).cast("int"))
    return actions.withColumn(items, F.when(F.size(cut) > 0, cut))


def trace_quality(messages: DataFrame, least_ratio: float = 0.75, trace: str = "trace_id") -> DataFrame:
    """Gate of traces: messages (trace, pos, role, reasoning, tool, ok). One pass by trace, no trace is gathered.

    actions: assistant messages with a tool; passed if enough of them have reasoning, the last has it and is 'final', and
    no tool result failed.
    """
    action = (F.col("role") == "assistant") & F.col("tool").isNotNull()
    reasoned = F.trim(F.coalesce("reasoning", F.lit(""))) != ""
    out = messages.groupBy(trace).agg(
        F.count_if(action).alias("actions"), F.count_if(action & reasoned).alias("reasoned"), F.count_if((F.col("role") == "tool") & (F.col("ok") == False)).alias("failed_results"),  # noqa: E712
        F.max(F.when(action, F.struct("pos", "tool", reasoned.alias("reasoned")))).alias("last"),
    )
    ratio = F.round(F.when(F.col("actions") > 0, F.col("reasoned") / F.col("actions")).otherwise(0.0), 6)
    passed = (ratio >= least_ratio) & F.coalesce(F.col("last.reasoned") & (F.col("last.tool") == "final"), F.lit(False)) & (F.col("failed_results") == 0)
    return out.select(trace, "actions", "reasoned", ratio.alias("reasoning_ratio"), F.col("last.tool").alias("last_tool"), "failed_results", passed.alias("passed"))


def system_audit(messages: DataFrame, allowed: DataFrame, trace: str = "conv_id") -> DataFrame:
    """Per trace: system messages, distinct ones, those outside `allowed` (content), and whether it passes."""
    system = messages.where("role = 'system'").select(trace, F.sha2("content", 256).alias("digest"))
    known = allowed.select(F.sha2("content", 256).alias("digest")).distinct().withColumn("known", F.lit(True))
    judged = system.join(known, "digest", "left")
    return judged.groupBy(trace).agg(F.count("*").alias("n_system"), F.count_distinct("digest").alias("n_distinct"), F.count_if(F.col("known").isNull()).alias("n_unknown"), (F.count_if(F.col("known").isNull()) == 0).alias("passed"))


def step_events(events: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Per (trace, step): its first 'started', last 'response' and last successful 'completed' event, in one pass."""
    row = F.struct("seq", "body")
    pick = lambda f, c: f(F.when(c, row))
    kind = F.col("event")
    out = events.groupBy(trace, "step").agg(
        pick(F.min, kind == "started").alias("started"), pick(F.max, kind == "response").alias("response"), pick(F.max, (kind == "completed") & F.coalesce("ok", F.lit(False))).alias("completed"),
    )
    return out.where("completed IS NOT NULL").select(trace, "step", *[F.col(f"{c}.body").alias(c) for c in ("started", "response", "completed")])


def curate(events: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Messages of accepted steps in order: teacher, assistant, tool result: trace, pos, role, content."""
    steps = step_events(events, trace)
    parts = [F.struct(F.lit(k).alias("slot"), F.lit(role).alias("role"), F.col(c).alias("content")) for k, (c, role) in enumerate((("started", "user"), ("response", "assistant"), ("completed", "tool")))]
    rows = steps.select(trace, "step", F.explode(F.array(*parts)).alias("m")).where("m.content IS NOT NULL")
    pos = F.row_number().over(Window.partitionBy(trace).orderBy("step", "m.slot"))
    return rows.select(trace, pos.alias("pos"), "m.role", "m.content")


def page_evidence(events: DataFrame, limit: int = 16_000, trace: str = "trace_id") -> DataFrame:
    """The last content of each URL that a trace opened, in order of first sight: events (trace, seq, url, text)."""
    last = events.where("url IS NOT NULL").groupBy(trace, "url").agg(F.min("seq").alias("first"), F.max_by("text", "seq").alias("text"))
    place = F.row_number().over(Window.partitionBy(trace).orderBy("first", "url"))
    return last.select(trace, "url", place.alias("place"), F.left("text", F.lit(limit)).alias("text"))


def latest_search(events: DataFrame, trace: str = "trace_id") -> DataFrame:
    """The result of each trace's last successful search: events (trace, seq, action, ok, result)."""
    found = events.where(F.col("action").isin("search", "search_many") & F.coalesce("ok", F.lit(False)))
    return found.groupBy(trace).agg(F.max("seq").alias("seq"), F.max_by("result", "seq").alias("result"))


def recovered_partials(events: DataFrame, queries: int = 12, urls: int = 12, trace: str = "trace_id") -> DataFrame:
    """Of timed-out helpers: the last reasoning, the last distinct queries and the first distinct URLs.

    Distinct values are ranked in windows by their places, so no more than the few kept are collected.
    """
    said = events.groupBy(trace).agg(F.max_by("reasoning", F.when(F.col("reasoning").isNotNull(), F.col("seq"))).alias("reasoning"))

    def kept(name: str, n: int, last: bool) -> DataFrame:
        first = events.where(F.col(name).isNotNull()).groupBy(trace, name).agg(F.min("seq").alias("at"))
        order = F.desc("at") if last else F.asc("at")
        few = first.withColumn("n", F.row_number().over(Window.partitionBy(trace).orderBy(order, name))).where(F.col("n") <= n)
        listed = F.array_sort(F.collect_list(F.struct("at", name)))
        return few.groupBy(trace).agg(F.transform(listed, lambda x: x[name]).alias(name + "s"))

    return said.join(kept("query", queries, True), trace, "left").join(kept("url", urls, False), trace, "left")


def compact(messages: DataFrame, limit: int, keep_last: int = 8, notes: int = 20, pages: int = 30, milestones: int = 4, conv: str = "conv_id") -> DataFrame:
    """Transcripts over `limit` characters keep their first message, the last messages, and of what lies between the last
    `notes` assistant messages, opened pages (kind 'page') and milestone tool results (kind 'milestone').

    messages (conv, pos, role, kind, content). A kept tail does not begin with a tool message. Each kept content is cut to an
    equal share of the limit. Transcripts within the limit stay whole. Ranks are counted within what lies between, so a late
    run of one kind doesn't push out another.
    """
    length = F.char_length(F.coalesce("content", F.lit("")))
    by = Window.partitionBy(conv)
    sized = messages.withColumns({"size": F.sum(length).over(by), "back": F.row_number().over(by.orderBy(F.desc("pos"))), "front": F.row_number().over(by.orderBy("pos"))})
    tail = F.col("back") <= keep_last
    marked = sized.withColumn("start", F.coalesce(F.max(F.when(tail & (F.col("role") != "tool"), F.col("back"))).over(by), F.lit(0)))
    between = (F.col("back") > F.col("start")) & (F.col("front") > 1)
    sort = F.when(~between, "").when(F.col("kind") == "page", "page").when(F.col("kind") == "milestone", "milestone").when(F.col("role") == "assistant", "note").otherwise("")
    marked = marked.withColumn("sort", sort).withColumn("nth", F.row_number().over(Window.partitionBy(conv, "sort").orderBy(F.desc("pos"))))
    most = F.when(F.col("sort") == "note", notes).when(F.col("sort") == "page", pages).when(F.col("sort") == "milestone", milestones).otherwise(0)
    part = F.when(F.col("size") <= limit, "whole").when(F.col("front") == 1, "head").when(F.col("back") <= F.col("start"), "tail").when(F.col("nth") <= most, F.col("sort"))
    share = limit // (1 + keep_last + notes + pages + milestones)
    text = F.when(part == "whole", F.col("content")).otherwise(truncate_middle(F.col("content"), share))
    return marked.select(conv, "pos", "role", part.alias("part"), text.alias("content")).where("part IS NOT NULL")


def parse_actions(log: DataFrame, allowed: tuple[str, ...], text: str = "text") -> DataFrame:
    """log with action (lower-cased), payload (the first JSON object of the text) and invalid: the reason why a row is no action, or null."""
    rows = log.withColumn("payload", first_json_object(F.col(text)))
    action = F.lower(F.btrim(F.get_json_object("payload", "$.action"), F.lit(" \t\r\n")))
    action = F.when(F.col("payload").isNotNull(), F.coalesce(action, F.lit("")))
    invalid = F.when(F.col("payload").isNull(), "no action").when(~action.isin(*allowed), "unknown action").otherwise(payload_fault(action, F.col("payload")))
    return rows.select(*log.columns, action.alias("action"), "payload", invalid.alias("invalid"))
