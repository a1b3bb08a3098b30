"""Tables of questions: what they ask for, which phrases anchor a search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrain.functions.texts import squeeze

# Word lists and the ordered rules of answer types.
GENERIC_LEADS = (
    "a an and as at by during each for from give has have identify in is it less name of on once provide represents restored"
    " that the there these this to using was were what when where which who with"
).split()
STOPWORDS = GENERIC_LEADS + (
    "about after again against all also among are because been before being between both but can could did do does had"
    " having he her here hers him his how i if into its me more most my not only or other our ours she some such than their"
    " them then they those through under until we while whose would you your"
).split()
WEAK_WORDS = (
    "answer article city community country different first following found location month particular person place question"
    " report same somewhere time town year"
).split()
WORD = r"[A-Za-z0-9]+(?:[.'’-][A-Za-z0-9]+)*"
SCAFFOLD = (
    r"(?i)(?:^|[.!?]\s*)(?:what|which|who|where|when|how|give|identify|name|provide)\b|\b(?:what|which|who|where|when|how)\b"
    r"|\b(?:give|identify|provide)\s+(?:the\s+)?(?:name|title|date|time|number|percentage)\b|\bi wonder\b"
)
ANSWER_TYPES = (
    (r"\bname (?:and|&) surname\b.*\byear\b|\bname of .*\b(?:founder|person)\b.*\bborn\b", "person_and_birth_year"),
    (r"\b(?:12|24)[- ]hour clock\b|\bwhat time\b|\bwhich time\b", "time"),
    (r"\bwhat percentage\b|\bpercentage (?:of|was|is)\b|\bpercent\b", "percentage"),
    (r"\bhow many\b|\bnumber of\b|\bwhat number\b", "number"),
    (r"\bwhat year\b|\bwhich year\b|\byear (?:was|did|in which)\b", "year"),
    (r"\bwhat date\b|\bwhich date\b|\bwhat day\b|\bwhich day\b", "date"),
    (
        r"\bfirst and last name\b|\bfirst and surname\b|\bname and surname\b"
        r"|\bwho (?:was|is|were|are|wrote|won|founded|created|designed|presented)\b",
        "person",
    ),
    (
        r"\bname of (?:the )?(?:mystery )?(?:settlement|city|town|village|country|island|river|mountain|location|place)\b"
        r"|\bwhich (?:settlement|city|town|village|country|island|river|mountain|location|place)\b",
        "place",
    ),
    (r"\bname the monument\b|\bname of (?:the )?monument\b", "monument_name"),
    (
        r"\b(?:title|name) of (?:the )?(?:book|film|movie|song|album|episode|paper|study|article|report|painting|game|work)\b"
        r"|\bwhat (?:book|film|movie|song|album|episode)\b",
        "work_title",
    ),
    (r"\bwhere (?:was|is|were|are|did)\b", "place"),
    (r"\bwho\b", "person"),
)
LIST_ASK = r"\b(?:list|all|which) (?:names|people|countries|cities|works|items)\b"
PAIR_ASK = r"\b(?:both|pair|two names|two people)\b"


def terminal_ask(question: Column) -> Column:
    """The last sentence if it is a question, else the last with a question word, else the last."""
    parts = F.filter(F.split(squeeze(question), r"(?<=[.!?])\s+"), lambda s: s != "")
    last = F.try_element_at(parts, F.lit(-1))
    asking = F.try_element_at(F.filter(parts, lambda s: s.rlike(SCAFFOLD)), F.lit(-1))
    return F.when(last.endswith("?"), last).otherwise(F.coalesce(asking, last, squeeze(question)))


def answer_contract(questions: DataFrame, text: str = "question", fallback: str = "other_short_string", ask: str | None = None) -> DataFrame:
    """questions with terminal_ask, answer_type and the least and largest number of answers (null: any).

    ask names a column with the part of the question that asks, where it is told apart from the clues: question words among the
    clues are not taken for the ask then.
    """
    rows = questions.withColumn("terminal_ask", terminal_ask(F.col(ask or text)))
    ask = F.lower("terminal_ask")
    kinds = [F.when(ask.rlike(p), kind) for p, kind in ANSWER_TYPES]
    clock = F.when(F.lower(text).rlike("12-hour clock|24-hour clock"), "time")
    least = F.when(ask.rlike(LIST_ASK), 1).when(ask.rlike(PAIR_ASK), 2).otherwise(1)
    most = F.when(ask.rlike(LIST_ASK), F.lit(None).cast("int")).when(ask.rlike(PAIR_ASK), 2).otherwise(1)
    return rows.withColumns({"answer_type": F.coalesce(*kinds, clock, F.lit(fallback)), "minimum": least, "maximum": most})


def words(text: Column) -> Column:
    return F.regexp_extract_all(squeeze(text), F.lit(WORD), 0)


def content_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~F.lower(w).isin(STOPWORDS) & (F.length(w) > 1))


def word_score(w: Column) -> Column:
    """A word's part of a phrase score: digits, weak words, length, and a capital."""
    base = F.when(w.rlike("[0-9]"), 6.0).when(F.lower(w).isin(WEAK_WORDS), 0.6).when(F.length(w) >= 9, 3.2).when(F.length(w) >= 6, 2.3).otherwise(1.3)
    return base + F.when(w.rlike("^[A-Z]") & ~F.lower(w).isin(GENERIC_LEADS), 0.8).otherwise(0.0)


def phrase_score(text: Column) -> Column:
    """Sum over content words, more for several, less for a single word without digits; -100 without any."""
    found = content_words(text)
    total = F.aggregate(found, F.lit(0.0), lambda s, w: s + word_score(w))
    several = F.when(F.size(found) >= 2, F.least(F.size(found), F.lit(6)) * 0.8).when(~F.element_at(found, 1).rlike("[0-9]"), -4.0).otherwise(0.0)
    return F.when(F.size(found) == 0, -100.0).otherwise(total + several)


def is_informative(text: Column) -> Column:
    found = content_words(text)
    return (F.size(found) >= 2) & ~F.forall(found, lambda w: F.lower(w).isin(WEAK_WORDS))


def segments(text: Column) -> Column:
    """Sentences and listed clauses with two content words at least."""
    parts = F.split(squeeze(text), r"(?<=[.!?;])\s+|\s+-\s+(?=[A-Z])|\s+(?=\d+[.)]\s+)")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" -"))), lambda p: F.size(content_words(p)) >= 2)


def compressed(text: Column, n: int = 9) -> Column:
    """The n content words of highest score, in their order."""
    found = content_words(text)
    scored = F.transform(found, lambda w, i: F.struct((-phrase_score(w)).alias("s"), i.alias("i"), w.alias("w")))
    top = F.slice(F.array_sort(scored), 1, n)
    ordered = F.array_sort(F.transform(top, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"))))
    return F.array_join(F.transform(ordered, lambda x: x["w"]), " ")


def anchors(questions: DataFrame, key: str = "item_id", text: str = "question", limit: int = 14, route: str | None = None) -> DataFrame:
    """key, anchor, score, place, exact: quoted spans, names, route anchors and compressed segments of a question, the `limit` best.

    exact: said so in the question (all but compressed segments). route names an array column of anchors from elsewhere.
    Only phrases that tell something count; the first of those equal in any case.
    """
    quoted = F.regexp_extract_all(text, F.lit('["“]([^"”]{4,120})["”]'), 1)
    name = r"[A-Z][A-Za-z0-9'’&-]*"
    names = F.regexp_extract_all(text, F.lit(rf"\b{name}(?:\s+(?:(?:of|the|and|for|in|on|at|to|&|de|la|van|von)\s+)?{name}){{1,7}}\b"), 0)
    names = F.transform(names, lambda v: F.regexp_replace(v, rf"^(?i:{'|'.join(GENERIC_LEADS)})\s+", ""))
    given = F.coalesce(F.col(route), F.array().cast("array<string>")) if route else F.array().cast("array<string>")
    plain = lambda x: F.transform(x, lambda v: F.btrim(squeeze(v), F.lit(" ,;:.?\"'()[]")))
    said = F.filter(plain(F.concat(quoted, names, given)), lambda v: F.contains(F.lower(squeeze(F.col(text))), F.lower(v)))
    tagged = lambda x, exact: F.transform(x, lambda v: F.struct(v.alias("anchor"), F.lit(exact).alias("exact")))
    every = F.concat(tagged(said, True), tagged(plain(F.transform(segments(F.col(text)), lambda s: compressed(s))), False))
    rows = questions.select(key, F.posexplode(every).alias("pos", "a")).select(key, "pos", "a.*").where((F.col("anchor") != "") & is_informative(F.col("anchor")))
    first = rows.groupBy(key, F.lower("anchor").alias("folded")).agg(F.min_by("anchor", "pos").alias("anchor"), F.min("pos").alias("pos"), F.bool_or("exact").alias("exact"))
    first = first.withColumn("score", phrase_score(F.col("anchor")))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc(F.length("anchor")), "pos"))
    return first.withColumn("place", place).where(F.col("place") <= limit).select(key, "anchor", F.round("score", 6).alias("score"), "place", "exact")


def query_key(text: Column) -> Column:
    return F.lower(F.array_join(content_words(text), " "))


def query_pairs(anchors_df: DataFrame, key: str = "item_id", limit: int = 7, max_chars: int = 280) -> DataFrame:
    """Pairs of a question's anchors without a common word, best sum first: a self-join on the question, anchors being at most 14 each."""
    a = anchors_df.select(key, F.col("anchor").alias("a"), F.col("place").alias("i"), F.col("score").alias("s"))
    b = anchors_df.select(key, F.col("anchor").alias("b"), F.col("place").alias("j"), F.col("score").alias("t"))
    low = lambda c: F.transform(content_words(F.col(c)), F.lower)
    rows = a.join(b, key).where("i < j").where(~F.arrays_overlap(low("a"), low("b")))
    query = F.concat(F.lit('"'), "a", F.lit('" "'), "b", F.lit('"'))
    rows = rows.select(key, query.alias("query"), (F.col("s") + F.col("t")).alias("score"), "i", "j").where(F.char_length("query") <= max_chars)
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, query_key(F.col("query"))).orderBy("i", "j"))).where("n = 1")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "i", "j"))
    return once.withColumn("place", place).where(F.col("place") <= limit).select(key, "query", "place")


def query_rungs(anchors_df: DataFrame, source_terms: DataFrame, seeds: DataFrame | None = None, key: str = "item_id", limit: int = 7, max_chars: int = 280) -> DataFrame:
    """key, rung, query, place: three rungs of queries of a question, `limit` at most in each.

    1: exact anchors of 7 words at most, quoted, then the others; 2: pairs of the first 8 anchors without a common word; 3: the
    first 5 anchors with the first 4 source terms (key, source_terms). Exact anchors are quoted. seeds (key, rung, pos, query)
    come last in their rungs if they tell something and score 4 at least. Of queries with one set of words the first counts,
    and a query has two words at least. A question without anchors has no rows, unless its seeds do.
    """
    quoted = F.concat(F.lit('"'), "anchor", F.lit('"'))
    rows = anchors_df.withColumn("said", F.when(F.col("exact"), quoted).otherwise(F.col("anchor")))
    one = rows.where(~F.col("exact") | (F.size(words(F.col("anchor"))) <= 7)).select(key, F.lit(1).alias("rung"), F.when(F.col("exact"), 0).otherwise(1).alias("a"), F.col("place").alias("b"), F.lit(0).alias("c"), F.col("said").alias("query"))
    left = rows.where("place <= 8").select(key, F.col("place").alias("a"), F.col("said").alias("x"), F.transform(content_words(F.col("anchor")), F.lower).alias("xw"))
    right = left.select(key, F.col("a").alias("b"), F.col("x").alias("y"), F.col("xw").alias("yw"))
    two = left.join(right, key).where((F.col("a") < F.col("b")) & ~F.arrays_overlap("xw", "yw")).select(key, F.lit(2).alias("rung"), "a", "b", F.lit(0).alias("c"), F.concat_ws(" ", "x", "y").alias("query"))
    terms = source_terms.select(key, F.posexplode(F.slice("source_terms", 1, 4)).alias("b", "term"))
    three = rows.where("place <= 5").join(terms, key).select(key, F.lit(3).alias("rung"), F.col("place").alias("a"), "b", F.lit(0).alias("c"), F.concat_ws(" ", "said", "term").alias("query"))
    made = one.unionByName(two).unionByName(three)
    if seeds is not None:
        bare = F.regexp_replace("query", r"\bsite:\S+", "")
        able = seeds.where(is_informative(bare) & (phrase_score(bare) >= 4))
        made = made.unionByName(able.select(key, "rung", F.lit(1 << 20).alias("a"), F.col("pos").alias("b"), F.lit(0).alias("c"), "query"))
    made = made.withColumn("query", squeeze(F.col("query"))).withColumn("set", F.array_sort(F.array_distinct(F.transform(content_words(F.col("query")), F.lower)))).where(F.size("set") >= 2)
    first = made.withColumn("n", F.row_number().over(Window.partitionBy(key, "rung", "set").orderBy("a", "b"))).where("n = 1")
    place = F.row_number().over(Window.partitionBy(key, "rung").orderBy("a", "b"))
    return first.withColumn("place", place).where(F.col("place") <= limit).select(key, "rung", F.left("query", F.lit(max_chars)).alias("query"), "place")


def select_items(rows: DataFrame, ranks: DataFrame, prefix: str = "item") -> DataFrame:
    """Rows chosen by a rank list (subset_rank, source_index) with a stable item_id; the list is small and joined by index."""
    item = F.format_string(f"{prefix}-%03d-row-%04d", "subset_rank", "source_index")
    return rows.join(ranks, "source_index").withColumn("item_id", item)


#: Entries in one list of a digest.
CHUNK = 4096


def _joined_digest(parts: DataFrame) -> DataFrame:
    """One row, digest: sha256 over the comma-joined hashes `said` in order of `at`, that of a single one being itself. What one
    hash takes in is sequential, so the hashes stream through one task, a batch at a time; none of its rows holds them all."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, n, first = hashlib.sha256(), 0, None
        for batch in batches:
            for said in batch["said"]:
                whole.update(f"{',' if n else ''}{said}".encode())
                n, first = n + 1, said if first is None else first
        yield pd.DataFrame({"digest": [first if n == 1 else whole.hexdigest()]})

    return parts.repartition(1).sortWithinPartitions("at").select("said").mapInPandas(stream, "digest string")


def list_digest(ranks: DataFrame, chunk: int = CHUNK, flat: bool = False) -> DataFrame:
    """One row, digest: sha256 over the indices of a rank list (subset_rank, source_index) in order of (rank, index).

    Lists that span at most `chunk` ranks have the digest of their comma-joined indices. Longer ones are a tree: each range of
    `chunk` ranks is hashed so, then each `chunk` of these hashes in the same way, up to one. A list in a task is no longer than
    a range's entries. flat: the hashes of the ranges are joined as one list, however many they are, so a digest has two levels at
    most. An empty list has the digest of the empty string.
    """
    low, high = ranks.agg(F.min("subset_rank"), F.max("subset_rank")).first()
    rows = ranks.where("subset_rank IS NOT NULL").select((F.col("subset_rank").cast("long") - (low or 0)).alias("at"), F.col("source_index").cast("string").alias("said"), F.col("source_index").alias("index"))
    last = (high or 0) - (low or 0)
    while True:
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "index", "said"))), lambda x: x["said"]), ",")
        last //= chunk
        if last == 0:
            return rows.agg(F.sha2(listed, 256).alias("digest"))
        digest = F.sha2(listed, 256)
        rows = rows.groupBy(F.floor(F.col("at") / chunk).alias("range")).agg(digest.alias("said")).select(F.col("range").alias("at"), "said", F.lit(0).alias("index"))
        if flat:
            return _joined_digest(rows)


def subset_checks(ranks: DataFrame, expected_rows: int, source_rows: int, digest: str | None = None) -> DataFrame:
    """check, ok over a rank list: size, repeats, range and, if given, whether list_digest() is `digest`."""
    s = ranks.agg(F.count("*").alias("n"), F.count_distinct("source_index").alias("d"), F.min("source_index").alias("low"), F.max("source_index").alias("high"))
    checks = [("size", F.col("n") == expected_rows), ("repeats", F.col("n") == F.col("d")), ("range", (F.col("low") >= 0) & (F.col("high") < source_rows))]
    if digest is not None:
        # One row beside one row.
        s = s.withColumn("one", F.lit(1)).join(list_digest(ranks).withColumn("one", F.lit(1)), "one")
        checks.append(("digest", F.col("digest") == digest))
    return s.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks])))


def parse_ranges(specs: DataFrame, total: int, spec: str = "spec") -> DataFrame:
    """Distinct indices of range lists like '0-9,82' that lie in 0 to total - 1."""
    parts = specs.select(F.explode(F.split(F.regexp_replace(spec, r"\s", ""), ",")).alias("p")).where("p <> ''")
    low = F.split_part("p", F.lit("-"), F.lit(1)).cast("int")
    high = F.when(F.contains("p", F.lit("-")), F.split_part("p", F.lit("-"), F.lit(2)).cast("int")).otherwise(low)
    return parts.select(F.explode(F.sequence(low, high)).alias("index")).where(f"index BETWEEN 0 AND {total - 1}").distinct()


def same_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """(subset_rank, source_index, side) of entries in one rank list only; empty if the lists agree in order."""
    left = a.select("subset_rank", "source_index").exceptAll(b.select("subset_rank", "source_index")).withColumn("side", F.lit("left"))
    right = b.select("subset_rank", "source_index").exceptAll(a.select("subset_rank", "source_index")).withColumn("side", F.lit("right"))
    return left.unionByName(right)
