"""URL filter: allow and block rules, and for the rest gradient-boosted trees on lexical features. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrain.llm.base import without

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FOLDS = 5
FEATURES = ("length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "suffix_rows", "suffix_block_rate")


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; '' if there is no '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule, or null. rules: (verdict, 'host/path')."""
    whens = [F.lit(None).cast("string")]
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        whens.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*reversed(whens))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits: a run-length pass over the sorted characters."""
    n = F.char_length(text).cast("double")
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    log = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    step = lambda s, c: F.when(s["c"] == c, F.struct(c.alias("c"), (s["run"] + 1.0).alias("run"), s["sum"].alias("sum"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("run"), (s["sum"] + log(s["run"])).alias("sum")))
    total = F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda s: s["sum"] + log(s["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def _lexical(url: Column, host: Column, path: Column) -> list[Column]:
    n = F.char_length(url).cast("double")
    return [
        n.alias("length"),
        F.regexp_count(path, F.lit("/")).cast("double").alias("depth"),
        F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0).alias("digit_ratio"),
        entropy(url).alias("entropy"),
        F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double").alias("n_params"),
        F.regexp_count(host, F.lit("[^.]+")).cast("double").alias("n_labels"),
        F.regexp_count(host, F.lit("-")).cast("double").alias("n_hyphens"),
    ]


def _judged_by_rules(pages: DataFrame, rules: list[tuple[str, str]], url_col: str, keep: list[str]) -> DataFrame:
    """page (the columns kept), url, host, path, rule, ruled (the rule's verdict), suffix (the host's last label) and fold (of the host) of every row."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("page"), url.alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = {rule: verdict for verdict, rule in rules}
    ruled = reduce(lambda c, r: F.when(F.col("rule") == r, F.lit(verdicts[r])).otherwise(c), verdicts, F.lit(None).cast("string"))
    return base.withColumn("ruled", ruled).withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))


def _featured(df: DataFrame, *also: str) -> DataFrame:
    """df's url, host and path to features; it has those of the suffix already."""
    seen = df.select(*also, *_lexical(F.col("url"), F.col("host"), F.col("path")), "suffix_rows", "suffix_block_rate")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(seen)


def _fitted(labelled: DataFrame, rows: DataFrame, mean: float, max_labelled: int, trees: int, depth: int, strength: float = 10.0):
    """Trees fitted on at most max_labelled of the labelled URLs, and the table of suffixes that they are to be used with.

    A suffix has the rows of all pages and the share of its labelled URLs that are blocked, drawn to the mean by `strength`
    URLs. For a URL that the trees are fitted on its share is that of the other folds, so of other hosts.
    """
    rate = lambda total, blocked: ((blocked + F.lit(mean * strength)) / (total + F.lit(strength))).alias("suffix_block_rate")
    by_fold = labelled.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("b"))
    whole = by_fold.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    table = rows.groupBy("suffix").agg(F.log2(F.count("*") + 1.0).alias("suffix_rows")).join(whole, "suffix", "left").fillna({"all_n": 0, "all_b": 0.0})
    apart = labelled.withColumn("deal", F.xxhash64("url")).orderBy("deal", "url").limit(max_labelled).join(table, "suffix").join(by_fold, ["suffix", "fold"])
    apart = apart.select("url", "host", "path", "label", "suffix_rows", rate(F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b")))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label", predictionCol="blocked").fit(_featured(apart, "label"))
    return model, table.select("suffix", "suffix_rows", rate(F.col("all_n"), F.col("all_b")))


def _labelled(base: DataFrame) -> tuple[DataFrame, dict[float, int]]:
    """The distinct URLs that a rule labels (copies of one count once), and the number of each label."""
    labelled = base.where("ruled IS NOT NULL").select("url", "host", "path", "suffix", "fold", (F.col("ruled") == "block").cast("double").alias("label")).distinct()
    return labelled, {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", max_labelled: int = 20_000, trees: int = 20, depth: int = 4, out: str = "url_filter") -> DataFrame:
    """pages plus a struct column `out`: host, path, rule, verdict ('allow' or 'block').

    A URL to which a rule applies gets the verdict of its longest rule. The trees judge the others; they are trained
    on distinct URLs that a rule labels, at most max_labelled of them (those with the smallest hashes: a documented bound of
    the fit). With labels of one kind only, every other URL gets that kind; without labels 'allow'.

    Null URLs and URLs without '://' have empty host and path and are judged by the trees as an empty text. Repeated
    rows are judged alike; an empty table gives an empty result; other columns pass through and one named `out`, whatever
    its case, is replaced. Every suffix counts, over all pages; their table is joined, not broadcast by us.
    """
    keep = without(pages.columns, out)
    base = _judged_by_rules(pages, rules, url_col, keep)
    labelled, kinds = _labelled(base)
    if len(kinds) < 2:
        judged = base.withColumn("judged", F.lit("block" if 1.0 in kinds else "allow"))
    else:
        mean = kinds[1.0] / (kinds[0.0] + kinds[1.0])
        model, suffixes = _fitted(labelled, base, mean, max_labelled, trees, depth)
        scored = model.transform(_featured(base.join(suffixes, "suffix"), "page", "host", "path", "rule", "ruled"))
        judged = scored.withColumn("judged", F.when(F.col("blocked") > 0.5, "block").otherwise("allow"))
    verdict = F.struct("host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"))
    return judged.select(*[F.col("page").getField(c).alias(c) for c in keep], verdict.alias(out))


def held_out(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", max_labelled: int = 20_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """label and blocked (1: block) of the labelled URLs of one fold of hosts in five, judged by trees and suffixes of the other hosts."""
    base = _judged_by_rules(pages, rules, url_col, [])
    labelled, kinds = _labelled(base)
    if len(kinds) < 2:
        raise ValueError("labels of both kinds are needed")
    mean = kinds[1.0] / (kinds[0.0] + kinds[1.0])
    model, suffixes = _fitted(labelled.where("fold <> 0"), base, mean, max_labelled, trees, depth)
    return model.transform(_featured(labelled.where("fold = 0").join(suffixes, "suffix"), "label")).select("label", "blocked")
