"""Guide tables: where a question's sources lie, private and redacted queries, checks before a training run, its export and rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.functions.terms import words_array
from evalgrain.functions.texts import squeeze

#: Kinds of questions by pattern, with the sources to look in and the words these sources use, in order.
SOURCE_RULES = (
    (
        r"\b(?:interview|inquiry guide|article|journalist|opinion piece|foreword|introduction|global report|published report|report (?:released|published|cover|credits))\b",
        ("original publisher pages and PDFs", "institutional publication archives", "web archives and contemporary reporting"),
        ("interview transcript inquiry guide archive", "publication PDF credits archive"),
    ),
    (r"\b(?:award|prize|medal|honou?r)\b", ("official award databases and recipient archives",), ("official award recipient archive",)),
    (
        r"\b(?:study|co-author|journal|conference|section meeting|education sessions|proceedings|doi)\b",
        ("publisher and scholarly indexes", "conference programs and professional biographies"),
        ("conference program proceedings presenter", "study authors institutional profile"),
    ),
    (
        r"\b(?:students?\b.{0,80}\btour(?:ed)?|tour(?:ed)?\b.{0,80}\bstudents?|first stop|itinerary)\b",
        ("university course and studio archives", "tour itineraries, event pages, and participant reports"),
        ("student tour itinerary first stop", "university course visit schedule"),
    ),
    (r"\b(?:university|college|degree|education|course)\b", ("university and institutional archives",), ("university institutional biography archive",)),
    (r"\b(?:restaurant|hotel|museum|store|business)\b", ("official venue histories and business profiles", "local reporting and directories"), ("official history founder", "local business profile archive")),
    (
        r"\b(?:monument|memorial|heritage|restored|ironworks|world war|political dynasty)\b",
        ("municipal heritage registers", "war memorial and monument databases", "local-history and event archives"),
        ("heritage register monument restoration", "war memorial inscription local history"),
    ),
    (
        r"\b(?:distance|miles?|kilomet(?:er|re)|meters?|metres?|route|bicycle|train station|body of water|street)\b",
        ("maps, routing, and geospatial records", "municipal and national geographic records"),
        ("map route distance municipal record",),
    ),
    (
        r"\b(?:fire|arson|police|hospital|heliport|preserved area)\b",
        ("government incident records", "local news archives", "hospital and community records"),
        ("incident report local archive", "hospital community record"),
    ),
    (
        r"\b(?:cover designer|graphic design|publishing|worked at|portfolio)\b",
        ("designer portfolios and professional biographies", "report colophons and publisher credits"),
        ("designer portfolio biography", "report cover credits PDF"),
    ),
)
#: What the sources come first of which an answer of a type is found in, and the sources of questions of no kind.
SOURCE_PRIORITIES = {
    "monument_name": ("heritage", "monument", "memorial", "local-history"),
    "place": ("maps", "geographic", "municipal", "incident", "local news"),
    "person": ("biograph", "award", "conference", "publisher", "portfolio"),
    "person_and_birth_year": ("biograph", "official venue", "local reporting"),
    "time": ("itinerar", "event", "publication", "archive"),
    "work_title": ("publisher", "publication", "catalog"),
}
ANY_SOURCES = ("official or primary records", "specialist databases", "contemporary archives")


def _folded_distinct(values: Column) -> Column:
    """Values without those that an earlier one equals in any case."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def source_profile(questions: DataFrame, text: str = "question", answer_type: str = "answer_type", topic: str = "topic", targets: str | None = None) -> DataFrame:
    """questions with source_targets (10 at most) and source_terms (6 at most): a rule table held against each question, in columns."""
    empty = F.array().cast("array<string>")
    asked = F.lower(text)
    hit = lambda k: F.concat(*[F.when(asked.rlike(rule[0]), words_array(rule[k])).otherwise(empty) for rule in SOURCE_RULES])
    rows = questions.withColumn("_t", hit(1)).withColumn("_n", hit(2))
    first = F.lit(False)
    for kind, parts in SOURCE_PRIORITIES.items():
        first = F.when(F.col(answer_type) == kind, F.lit("|".join(parts))).otherwise(first.cast("string"))
    wanted = lambda t: F.coalesce(F.regexp_like(F.lower(t), first), F.lit(False))
    ordered = F.concat(F.filter("_t", wanted), F.filter("_t", lambda t: ~wanted(t)))
    own = F.filter(F.coalesce(F.col(targets), empty), lambda t: F.trim(t) != "") if targets else empty
    found = F.when(F.size("_t") > 0, ordered).when(F.size(own) > 0, own).otherwise(words_array(ANY_SOURCES))
    terms = F.when(F.size("_n") > 0, F.col("_n")).otherwise(F.array(F.concat(F.lower(topic), F.lit(" official archive record"))))
    return rows.select(*questions.columns, F.slice(_folded_distinct(found), 1, 10).alias("source_targets"), F.slice(_folded_distinct(terms), 1, 6).alias("source_terms"))


#: Words of a query, words that don't count in it, parts of an answer, and answers that are a clock time or an amount.
WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
PRIVATE_STOPWORDS = (
    "a an and are as at be been between by did do for from had has have how in is it less more of on or that the their these they"
    " this to using was were what when where which who with"
).split()
SEPARATOR = r"(?i)\s*(?:[,;|]|\band\b)\s*"
CLOCK = r"(?i)^(?:\d{1,4}[:./-]?)+\s*(?:am|pm)?$"
AMOUNT = r"(?i)^(?:\d{1,4}(?::\d{2})?\s*(?:a\.?m\.?|p\.?m\.?)?|\d+(?:\.\d+)?\s*(?:percent|%|years?|miles?|km|meters?|metres?))$"
CANDIDATE = "${candidate}"


def query_terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(squeeze(text), F.lit(WORD), 0), F.lower)), lambda w: (F.length(w) > 1) & ~w.isin(PRIVATE_STOPWORDS))


def answer_forms(aliases: Column, limit: int = 8) -> Column:
    """The aliases, each followed by the parts of four characters or more of a composite one; clock times stay whole."""
    plain = F.array_distinct(F.filter(F.transform(aliases, squeeze), lambda a: a != ""))
    parts = lambda a: F.filter(F.split(a, SEPARATOR), lambda p: (F.length(p) >= 4) & (F.size(query_terms(p)) > 0))
    forms = F.flatten(F.transform(plain, lambda a: F.when(a.rlike(CLOCK), F.array(a)).otherwise(F.concat(F.array(a), parts(a)))))
    return F.slice(F.array_distinct(forms), 1, limit)


def match_aliases(aliases: Column) -> Column:
    """The aliases, then those of their parts that have two terms at least and are no amount."""
    plain = F.array_distinct(F.filter(F.transform(aliases, squeeze), lambda a: a != ""))
    return F.array_union(plain, F.filter(answer_forms(aliases), lambda f: (F.size(query_terms(f)) >= 2) & ~f.rlike(AMOUNT)))


def private_queries(records: DataFrame, anchors: DataFrame, key: str = "item_id", limit: int = 12) -> DataFrame:
    """key, query, place: each answer form with each of the first 8 anchors, then the record's own queries; distinct, `limit` at most.

    records: key, aliases, queries (arrays); anchors: key, anchor, place. All products of one item: 8 forms times 8 anchors at most.
    """
    few = anchors.where(F.size(query_terms(F.col("anchor"))) >= 2).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where("n <= 8")
    forms = records.select(key, F.posexplode(answer_forms(F.col("aliases"))).alias("form_at", "form"))
    cut = F.array_join(F.slice(F.split(squeeze(F.col("anchor")), " "), 1, 8), " ")
    made = forms.join(few, key).select(key, F.lit(0).alias("part"), "form_at", "n", F.concat(F.lit('"'), F.translate("form", '"', " "), F.lit('" '), cut).alias("query"))
    own = records.select(key, F.lit(1).alias("part"), F.lit(0).alias("form_at"), F.posexplode("queries").alias("n", "query")).where(F.size(query_terms(F.col("query"))) >= 3)
    rows = made.unionByName(own.withColumn("query", squeeze(F.col("query")))).groupBy(key, "query").agg(F.min(F.struct("part", "form_at", "n")).alias("at"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("place") <= limit).select(key, "query", "place")


_TOKEN = r"(?U)\w+(?:[-']\w+)*"


def recovery_queries(hints: DataFrame, aliases: DataFrame, key: str = "item_id", limit: int = 7) -> DataFrame:
    """key, query, place: what stands around the mark of a redacted answer in hints (key, pos, hint), without any alias (key, names).

    Of each hint the 8 words before the mark with the 14 after it (6 words at least), and the 12 words after it, else before it,
    as a quoted phrase (4 at least).
    """
    rows = hints.where(F.contains("hint", F.lit(CANDIDATE)))
    at = F.instr("hint", CANDIDATE)
    tokens = lambda c: F.regexp_extract_all(c, F.lit(_TOKEN), 0)
    rows = rows.withColumn("_b", tokens(F.left("hint", at - 1))).withColumn("_a", tokens(F.substring("hint", at + len(CANDIDATE), F.lit(2**31 - 1))))
    before = lambda n: F.slice("_b", F.greatest(F.size("_b") - n + 1, F.lit(1)), n)
    numbers = F.coalesce(F.array_position(F.transform("_a", lambda t: ~t.rlike(r"^\d+(?:-\d+)+$")), F.lit(True)), F.lit(0))
    after = F.when(numbers > 0, F.slice("_a", numbers.cast("int"), 12)).otherwise(F.array().cast("array<string>"))
    around = F.concat(before(8), F.slice("_a", 1, 14))
    phrase = F.when(F.size(after) >= 4, after).otherwise(before(12))
    quoted = F.concat(F.lit('"'), F.array_join(phrase, " "), F.lit('"'))
    made = F.array(F.when(F.size(around) >= 6, F.array_join(around, " ")), F.when(F.size(phrase) >= 4, quoted))
    found = rows.select(key, "pos", F.posexplode(made).alias("kind", "query")).where("query IS NOT NULL").join(aliases, key, "left")
    said = lambda a: F.regexp_like("query", F.concat(F.lit(r"(?iU)(?<!\w)\Q"), a, F.lit(r"\E(?!\w)")))
    clean = found.where(~F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda a: (F.length(a) > 0) & said(a)))
    first = clean.groupBy(key, "query").agg(F.min(F.struct("pos", "kind")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("place") <= limit).select(key, "query", "place")


#: Words that tell nothing in a template, and what speaks of distances.
WEAK_TEMPLATE_WORDS = "after and before candidate less more name other some than the there these this those tuesday using what when where which who".split()
DISTANCE = (
    r"(?i)\b(?:drive|driving|walk|walking|bicycle|route|distance|proximity|nearby|within\s+\d"
    r"|\d+(?:\.\d+)?\s*(?:miles?|mi|kilometers?|km|meters?|metres?|m)\b)"
)


def verification_templates(redacted: DataFrame, phrases: DataFrame, key: str = "item_id", limit: int = 7) -> DataFrame:
    """key, query, place: redacted queries (key, pos, query), then the mark with each phrase (key, pos, phrase; first 10 words).

    A template holds the mark and two telling words at least; the first of those equal in any case counts.
    """
    cut = F.array_join(F.slice(F.split(squeeze(F.col("phrase")), " "), 1, 10), " ")
    made = phrases.where(squeeze(F.col("phrase")) != "").select(key, F.lit(1).alias("part"), "pos", F.concat(F.lit(f'"{CANDIDATE}" "'), cut, F.lit('"')).alias("query"))
    rows = redacted.select(key, F.lit(0).alias("part"), "pos", squeeze(F.col("query")).alias("query")).unionByName(made)
    words = F.regexp_extract_all(F.replace("query", F.lit(CANDIDATE), F.lit(" ")), F.lit(WORD), 0)
    telling = F.filter(words, lambda w: ~F.lower(w).isin(WEAK_TEMPLATE_WORDS))
    able = rows.where(F.contains("query", F.lit(CANDIDATE)) & (F.size(telling) >= 2))
    at = F.struct("part", "pos")
    first = able.groupBy(key, F.lower("query").alias("folded")).agg(F.min_by("query", at).alias("query"), F.min(at).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("place") <= limit).select(key, "query", "place")


def needs_distances(constraints: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """key and geo: whether an item's constraints speak of distances twice or more."""
    return constraints.groupBy(key).agg((F.sum(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(DISTANCE))) >= 2).alias("geo"))


def guide_faults(steps: DataFrame, leaks: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """key, attempt, fault: what is wrong with compiled guides (key, attempt, pos, step_id, instruction, allowed_actions).

    leak: an answer in it (leaks: key); last: the last step is not for the final answer alone; atomic: a step with no or several
    actions; incomplete: a step without name or instruction. One pass by guide.
    """
    one = F.coalesce(F.size("allowed_actions") == 1, F.lit(False))
    whole = (F.trim(F.coalesce("step_id", F.lit(""))) != "") & (F.trim(F.coalesce("instruction", F.lit(""))) != "")
    last = F.max_by("allowed_actions", "pos")
    by_guide = steps.groupBy(key, "attempt").agg(F.coalesce(last == F.array(F.lit("final")), F.lit(False)).alias("last"), F.bool_and(one).alias("atomic"), F.bool_and(whole).alias("incomplete"))
    faults = F.array_compact(F.array(*[F.when(~F.col(c), c) for c in ("last", "atomic", "incomplete")]))
    found = by_guide.select(key, "attempt", F.explode(faults).alias("fault"))
    if leaks is None:
        return found
    return found.unionByName(by_guide.join(leaks.select(key).distinct(), key, "left_semi").select(key, "attempt", F.lit("leak").alias("fault")))


def guide_preflight(items: DataFrame, steps: DataFrame, faults: DataFrame, key: str = "item_id") -> DataFrame:
    """One row about compiled guides: items (key, sources: an array) with and without sources, variants, steps of a guide, faults, passed."""
    guides = steps.groupBy(key, "attempt").agg(F.count("*").alias("n"))
    counts = guides.agg(F.count("*").alias("attempt_variants"), F.min("n").alias("minimum_steps"), F.max("n").alias("maximum_steps"), F.round(F.avg("n"), 3).alias("mean_steps"))
    mapped = F.count_if(F.coalesce(F.size("sources"), F.lit(0)) > 0)
    about = items.agg(F.count("*").alias("selected_items"), mapped.alias("mapped_source_items"), (F.count("*") - mapped).alias("route_only_items"))
    wrong = faults.agg(F.count("*").alias("faults"), (F.count("*") == 0).alias("passed"))
    return about.join(counts).join(wrong)


def finished_rates(items: DataFrame, key: str = "run_id") -> DataFrame:
    """key, finished, items_per_hour, eta_seconds of runs whose items (key, started_at of the run, finished_at, null if open) are given."""
    done = F.count("finished_at")
    seconds = F.greatest(F.max("finished_at").cast("double") - F.min("started_at").cast("double"), F.lit(0.001))
    out = items.groupBy(key).agg(done.alias("finished"), (F.count("*") - done).alias("remaining"), (done / seconds * 3600).alias("items_per_hour"))
    return out.withColumn("eta_seconds", F.when(F.col("items_per_hour") > 0, F.col("remaining") / F.col("items_per_hour") * 3600))


def consolidated(lines: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """value of the non-empty lines of per-item files (path, line, value) in the order of the items (key, rank) and of their lines.

    A file belongs to the item that its name without ending is; files of no item are left out. The order is one range
    exchange, so it can be written as it is.
    """
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return lines.where("value <> ''").withColumn(key, name).join(items.select(F.col(key).cast("string").alias(key), "rank"), key).orderBy("rank", "line").select("value")
