"""Whether answers are borne out by the pages that a trial opened and cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrain.functions import terms as T
from evalgrain.functions import urls as U
from evalgrain.operators import phrases

# Fixed value: answers that give none.
ABSTENTION = (
    r"(?i)^(?:unknown|none|n/?a|inconclusive|undetermined|"
    r"(?:not|cannot|can't|unable\s+to)\s+(?:be\s+)?(?:determine|determined|identify|identified|verify|verified|conclude|concluded)|"
    r"(?:not\s+)?(?:conclusively\s+)?(?:identifiable|verifiable|determinable)|"
    r"(?:insufficient|inadequate|not\s+enough)\s+(?:evidence|information|data)|"
    r"no\s+(?:conclusive\s+)?(?:answer|candidate|determination))(?:\b.*)?$"
)


def is_abstention(answer: Column) -> Column:
    return F.trim(F.coalesce(answer, F.lit(""))).rlike(ABSTENTION)


# Questions for somebody's identity, answers that name a category only, and words that mark a clue restated.
IDENTITY_QUESTION = (
    r"(?i)(?:^\s*who\b|\b(?:tell\s+me|determine|find\s+out)\s+who\b|\bwhat\s+(?:is|was)\s+(?:the\s+)?name\s+of|"
    r"what\s+(?:is|was)\s+(?:this|the)\s+(?:person|individual|celebrity|actor|actress|author|artist|scientist|researcher|politician|athlete)['’]s\s+name|"
    r"\bidentify\s+(?:this|the)\s+(?:person|individual|celebrity|actor|actress|author|artist|scientist|researcher|politician|athlete|professor|director)|"
    r"^\s*(?:what|which)\s+(?:person|individual|celebrity|actor|actress|author|artist|scientist|researcher|politician|athlete|professor|director))\b"
)
CATEGORY_ANSWER = (
    r"(?i)^(?:the|a|an)?\s*(?:(?:likely|possible|probable|specific|unnamed|implied|famous|notable|leading|well[- ]known)\s+)*"
    r"(?:person|individual|celebrity|woman|man|female|male|actor|actress|artist|playwright|figure|candidate|producer|author|scientist|researcher|politician|athlete|"
    r"professor|academic|director|filmmaker|musician|singer|footballer|player|model|personality|inventor|doctor|physician|engineer|architect|composer)\b"
)
CLUE_WORD = r"(?i)\b(?:who|that|which|likely|possibly|probably|specific|unnamed|implied|candidate)\b"
ENDS_WITH = r"(?i)\b(?:ends?|ending)\s+with\s+the\s+word\s+[\"'“”‘’]*\s*([a-z0-9][a-z0-9'’-]*)"
STARTS_WITH = r"(?i)\b(?:starts?|begins?|starting|beginning)\s+with\s+the\s+word\s+[\"'“”‘’]*\s*([a-z0-9][a-z0-9'’-]*)"
SURFACE_WORD = r"(?i)[a-z0-9]+(?:['’-][a-z0-9]+)*"


def restates_category(question: Column, answer: Column) -> Column:
    """Whether a question for an identity is answered by a category: of three words at most, or with a clue restated."""
    plain = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", " "))
    tail = F.regexp_replace(plain, CATEGORY_ANSWER, "")
    words = F.size(F.regexp_extract_all(plain, F.lit(r"(?U)[\w&&[^_]]+(?:['’-][\w&&[^_]]+)*"), 0))
    return F.coalesce(question, F.lit("")).rlike(IDENTITY_QUESTION) & plain.rlike(CATEGORY_ANSWER) & ((words <= 3) | tail.rlike(CLUE_WORD))


def surface_faults(question: Column, answer: Column) -> Column:
    """What a question says of the answer's first or last word and the answer breaks: an array of 'ends with x', 'starts with x'."""
    said = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(SURFACE_WORD), 0), F.lower)
    asked = lambda p: F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(p), 1), F.lower)
    broken = lambda p, at: F.filter(asked(p), lambda w: ~F.coalesce(F.try_element_at(said, F.lit(at)) == w, F.lit(False)))
    ends = F.transform(broken(ENDS_WITH, -1), lambda w: F.concat(F.lit("ends with "), w))
    return F.concat(ends, F.transform(broken(STARTS_WITH, 1), lambda w: F.concat(F.lit("starts with "), w)))


def cited_pages(trials: DataFrame, opened: DataFrame, key: str = "trial_id") -> DataFrame:
    """Citations of a trial that it opened: trials (key, citations), opened (key, requested_url, final_url, page_id).

    Joined on the evidence key of either URL, each page once. A trial with very many citations is spread over the
    join by the URL key, not gathered.
    """
    cites = trials.select(key, F.explode("citations").alias("citation")).select(key, U.evidence_key(F.col("citation")).alias("url_key")).where("url_key <> ''").distinct()
    both = F.explode(F.array_distinct(F.array(U.evidence_key(F.col("requested_url")), U.evidence_key(F.col("final_url")))))
    pages = opened.select(key, "page_id", both.alias("url_key")).where("url_key <> ''").distinct()
    return cites.join(pages, [key, "url_key"]).select(key, "page_id").distinct()


def _matches(q: Column, page_terms: Column) -> Column:
    need = F.least(F.size(q), F.lit(8), F.greatest(F.lit(2), F.floor((F.size(q) + 5) / 6).cast("int")))
    return (F.size(q) > 0) & (T.overlap(q, page_terms) >= need)


def page_matches_question(question: Column, page: Column) -> Column:
    """At least min(|Q|, 8, max(2, (|Q| + 5) div 6)) of the question's terms are on the page."""
    return _matches(T.terms(question, T.LINK_STOPWORDS), T.terms(page))


def answer_windows(pairs: DataFrame, pages: DataFrame, around: int = 24, key: str = "trial_id") -> DataFrame:
    """key, page_id, start, window: the text `around` words about each place of a trial's answer on a page, a row each.

    pairs: key, page_id, answer; pages: page_id, page, each page once. Words are compared without case. An answer without a word has no place.
    """
    asked = pairs.select(key, "page_id", phrases.phrase_words(F.col("answer")).alias("phrase"))
    places = phrases.word_places(pages)
    found = phrases.windows(places, phrases.phrase_places(places, asked), around)
    return asked.join(found, ["page_id", "phrase"]).select(key, "page_id", "start", "window")


def relation_terms(question: Column, answer: Column) -> Column:
    """What the question says about the answer: its terms without question words and the answer's own."""
    return F.array_except(T.terms(question, [*T.LINK_STOPWORDS, *T.QUESTION_WORDS]), T.terms(answer))


def judged_pages(pairs: DataFrame, pages: DataFrame, around: int = 24, key: str = "trial_id") -> DataFrame:
    """key, page_id, n_windows, contradicts, supports, relevant for each pair (key, page_id, question, answer); pages: page_id, page, each once.

    A window that denies something contradicts the answer if it names anything that the question says of it (or the question says nothing);
    one that doesn't supports it if it names two such things (all, if there is one).
    """
    stop = [*T.LINK_STOPWORDS, *T.QUESTION_WORDS]
    asked = pairs.select(key, "page_id", relation_terms(F.col("question"), F.col("answer")).alias("relation"))
    held = answer_windows(pairs, pages, around, key).join(asked, [key, "page_id"])
    denied, n = F.col("window").rlike(T.CONTRADICTION), F.size("relation")
    about = F.size(F.array_intersect(F.col("relation"), T.terms(F.col("window"), stop)))
    contradicts = denied & ((n == 0) | (about > 0))
    supports = ~denied & (n > 0) & (about >= F.when(n == 1, 1).otherwise(2))
    told = held.groupBy(key, "page_id").agg(F.count("*").alias("n_windows"), F.bool_or(contradicts).alias("contradicts"), F.bool_or(supports).alias("supports"))
    terms = pages.select("page_id", T.terms(F.col("page")).alias("page_terms"))
    rows = pairs.join(terms, "page_id").select(key, "page_id", _matches(T.terms(F.col("question"), T.LINK_STOPWORDS), F.col("page_terms")).alias("relevant"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.join(told, [key, "page_id"], "left").select(key, "page_id", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), flag("contradicts"), flag("supports"), "relevant")


def verdicts(trials: DataFrame, opened: DataFrame, key: str = "trial_id") -> DataFrame:
    """The first rule that a trial's evidence fails, or 'ok'.

    trials: key, question, answer, citations; opened: key, page_id, requested_url, final_url, page (of a page_id one text). Rules in order: no
    valid citation, a citation that mirrors the question, none of them opened, no searchable answer, contradicted,
    not supported, too few relevant pages (two, or one that states the relation directly).
    """
    from evalgrain.operators.fusion import query_mirror

    cites = trials.select(key, "question", F.explode_outer("citations").alias("citation"))
    flags = cites.groupBy(key).agg(
        F.bool_or(U.evidence_key(F.col("citation")) != "").alias("valid"),
        F.bool_or(query_mirror(F.col("question"), F.col("citation"))).alias("mirror"),
    )
    pairs = cited_pages(trials, opened, key).join(trials.select(key, "question", "answer"), key)
    pages = opened.select("page_id", "page").dropDuplicates(["page_id"])
    by_trial = judged_pages(pairs, pages, key=key).groupBy(key).agg(
        F.count("*").alias("n_pages"), F.bool_or(F.col("n_windows") > 0).alias("stated"), F.bool_or("contradicts").alias("contradicted"),
        F.bool_or("supports").alias("supported"), F.count_if("relevant").alias("n_relevant"),
    )
    searchable = F.regexp_extract_all("answer", F.lit(r"(?U)[\w&&[^_]]+"), 0)
    rows = trials.select(key, (F.size(searchable) > 0).alias("searchable")).join(flags, key, "left").join(by_trial, key, "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    verdict = (
        F.when(F.coalesce("mirror", F.lit(False)), "mirror citation").when(no("valid"), "no valid citation").when(F.col("n_pages").isNull(), "no cited page opened")
        .when(no("searchable"), "no searchable answer").when(F.col("contradicted"), "contradicted").when(no("stated"), "not supported")
        .when((F.col("n_relevant") < 2) & no("supported"), "too few relevant pages").otherwise("ok")
    )
    return rows.select(key, verdict.alias("verdict"))
