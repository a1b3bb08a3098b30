"""Secret scan in DataFrame functions: base patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrain.llm.base import drop, materialize, recorded, without

#: The kinds in order, and what each finds; a match shorter than the third value (in group 2 or 0) is dropped.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
)
MODEL_KIND = "markov"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_PAIRS = r"(?=([A-Za-z0-9+/_=-]{2}))"
#: Folds of the texts, and letters of a piece on which the threshold is measured.
FOLDS, PIECE = 5, 24
#: Letters of a piece that are read as one number, 8 bits each, so that a pair of them is 16 of its bits.
AT_ONCE = 7
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _at_least(n: int):
    return lambda match: F.length(match) >= n


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratio of each pair of alphabet letters, random over ordinary, row by row; empty if untrained.

    A string whose mean ratio is over the threshold counts as random.
    """

    ratios: tuple[float, ...]
    threshold: float = 0.0


def train(samples: DataFrame, text_col: str = "text", random_col: str = "is_random", floor: float = 0.01) -> MarkovModel:
    """Transition counts of labelled samples (label true: a random string; false: ordinary text) to a model.

    A transition's probability is its share of its first letter's pairs, mixed with a share `floor` of the uniform one. Counts
    are summed by task and pair; the driver gets one row for each label and pair, at most 2 * 67 * 67. Pairs with
    a letter outside the alphabet are not counted; rows with null text or label are left out. Without samples of both
    labels the model is untrained and finds nothing.
    """
    return _model({(label, pair): n for (label, _, pair), n in _counts(samples, text_col, random_col, F.lit(0)).items()}, floor)


def _counts(samples: DataFrame, text_col: str, random_col: str, fold: Column) -> dict[tuple[bool, int, str], int]:
    """How often each pair occurs, by label, fold and pair."""
    pairs = samples.where(F.col(random_col).isNotNull()).select(F.col(random_col).alias("label"), fold.alias("fold"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(_PAIRS), 1)).alias("pair"))
    return {(r.label, r.fold, r.pair): r.n for r in pairs.groupBy("label", "fold", "pair").agg(F.count("*").alias("n")).collect()}


def _model(counts: dict[tuple[bool, str], int], floor: float) -> MarkovModel:
    if len({label for label, _ in counts}) < 2:
        return MarkovModel(())
    after = {(label, a): sum(counts.get((label, a + b), 0) for b in ALPHABET) for label in (True, False) for a in ALPHABET}
    log = lambda label, a, b: math.log((1 - floor) * counts.get((label, a + b), 0) / max(1, after[label, a]) + floor / len(ALPHABET))
    return MarkovModel(tuple(round(log(True, a, b) - log(False, a, b), 4) for a in ALPHABET for b in ALPHABET))


def random_strings(spark: SparkSession, n: int = 20_000, seed: int = 7) -> DataFrame:
    """text, fold: strings of random bytes from a seed, 16 to 64 characters long: hex, base64, base62, digits, UUID. Folds are 0 to FOLDS - 1."""
    row = spark.range(n).withColumn("hex", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    b64 = F.base64(F.unhex("hex"))
    groups = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    kinds = [F.col("hex"), b64, F.regexp_replace(b64, "[+/=]", ""), F.regexp_replace("hex", "[a-f]", ""), F.concat_ws("-", *[F.substring("hex", a, k) for a, k in groups])]
    kind = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    return row.select(F.left(kind, (F.conv(F.right("hex", F.lit(3)), 16, 10).cast("int") % 49 + 16)).alias("text"), (F.crc32(F.encode("hex", "UTF-8")) % FOLDS).cast("int").alias("fold"))


def ordinary_identifiers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """text, fold: what the base patterns leave of each text as one long identifier, its words joined as in names and paths
    (snake, kebab, path or camel case, by the text's checksum); numbers that stand alone are no part of it. Equal texts are in one fold of 0 to FOLDS - 1."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = text
    for kind, pattern, least in BASE:
        rest = F.regexp_replace(rest, pattern if kind != "hex" else f"[0-9a-f]{{{least},}}", " ")
    deal = F.crc32(F.encode(text, "UTF-8"))
    between = "[^A-Za-z0-9_]+(?:[0-9]+(?![A-Za-z0-9_])[^A-Za-z0-9_]*)*"
    made = F.regexp_replace(F.initcap("rest"), between, "")
    for k, sign in enumerate("_-/"):
        made = F.when(F.col("style") == k, F.regexp_replace("rest", between, sign)).otherwise(made)
    return docs.select(rest.alias("rest"), (deal % 4).alias("style"), (deal % FOLDS).cast("int").alias("fold")).select(made.alias("text"), "fold")


def fit(docs: DataFrame, text_col: str = "text", strings: int = 20_000, false_rate: float = 0.001, floor: float = 0.01) -> MarkovModel:
    """A model of random strings against the ordinary identifiers of all docs, and its threshold from all their pieces of 24 letters.

    The model counts every text. Its threshold is the ratio that a share of false_rate of all pieces is over, 0 at least; a
    piece is held against the counts of the other FOLDS - 1 folds, so none against a model that its own text has trained. `strings` random strings are
    made, which are no input; of docs nothing is left out. The identifiers are written to the shared folder, since both
    counts and pieces are taken from them, and removed again.
    """
    with recorded() as made:
        model = _fitted(random_strings(docs.sparkSession, strings), materialize(ordinary_identifiers(docs, text_col), "identifiers"), false_rate, floor)
    drop(docs.sparkSession, made)
    return model


def _fitted(random: DataFrame, ordinary: DataFrame, false_rate: float, floor: float) -> MarkovModel:
    """The model and threshold of fit(), from text and fold of random strings and of ordinary identifiers."""
    labelled = random.withColumn("is_random", F.lit(True)).unionByName(ordinary.withColumn("is_random", F.lit(False)))
    counts = _counts(labelled, "text", "is_random", F.col("fold"))

    def made(left_out: int | None) -> MarkovModel:
        some: dict[tuple[bool, str], int] = {}
        for (label, fold, pair), n in counts.items():
            if fold != left_out:
                some[label, pair] = some.get((label, pair), 0) + n
        return _model(some, floor)

    model = made(None)
    if not model.ratios:
        return model
    tables = [made(k).ratios or model.ratios for k in range(FOLDS)]  # with all texts in one fold there is no other model
    return replace(model, threshold=max(0.0, threshold(_piece_ratios(ordinary, tables), false_rate)))


def _piece_ratios(ordinary: DataFrame, tables: Sequence[Sequence[float]]) -> DataFrame:
    """ratio: the mean log-likelihood ratio of every piece of PIECE letters, by the table of its text's fold.

    What ratio() says, in plain expressions: each pair is looked up by its bits in a table of one fold, joined to the texts.
    """
    last = ord(max(ALPHABET))
    places = [(ord(a) << 8) + ord(b) for a in ALPHABET for b in ALPHABET]
    listed = []
    for ratios in tables:
        at = dict(zip(places, ratios, strict=True))
        listed.append(F.lit(",".join(str(at.get(k, 0.0)) for k in range((last << 8) + last + 1))))
    fold = F.col("id").cast("int")
    by_fold = ordinary.sparkSession.range(0, len(tables), 1, 1).select(fold.alias("fold"), F.split(F.get(F.array(*listed), fold), ",").cast("array<double>").alias("table"))
    pieces = ordinary.join(F.broadcast(by_fold), "fold").select("table", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z0-9+/_=-]{{{PIECE}}}"), 0)).alias("piece"))
    # A number begins with the last letter of the one before, so no pair falls between two.
    starts = range(0, PIECE - 1, AT_ONCE - 1)
    numbers = pieces.select("table", *[F.conv(F.hex(F.substring("piece", k + 1, AT_ONCE)), 16, 10).cast("long").alias(f"n{k}") for k in starts])
    pairs = [F.shiftright(f"n{k}", 8 * left).bitwiseAND(F.lit(0xFFFF)) for k in starts for left in reversed(range(min(AT_ONCE, PIECE - k) - 1))]
    total = reduce(lambda s, pair: s + F.get("table", pair.cast("int")), pairs, F.lit(0.0))
    return numbers.select((total / len(pairs)).alias("ratio"))


def threshold(ratios: DataFrame, false_rate: float) -> float:
    """The least thousandth that at most a share of false_rate of the ratios is over; 0 without ratios. Exact: the driver gets a count for each thousandth."""
    counts = sorted((r.at, r.n) for r in ratios.groupBy(F.ceil(F.col("ratio") * 1000).alias("at")).agg(F.count("*").alias("n")).collect())
    left = sum(n for _, n in counts)
    most = false_rate * left
    for at, n in counts:
        left -= n
        if left <= most:
            return at / 1000
    return 0.0


def ratio(text: Column, model: MarkovModel) -> Column:
    """Mean log-likelihood ratio over a string's pairs; 0 if it has none."""
    table = F.split(F.lit(",".join(map(str, model.ratios))), ",").cast("array<double>")
    at = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pairs = F.regexp_extract_all(text, F.lit(_PAIRS), 1)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.element_at(table, at(F.substring(p, 1, 1)) * len(ALPHABET) + at(F.substring(p, 2, 1)) + 1))
    return F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(0.0)


def _spans(text: Column, pattern: str, matches: Column, kept: Column, kind: int) -> Column:
    """Code-point spans of the matches that `kept` (array<boolean>) marks: the lengths of the pieces between matches, summed up."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), matches.alias("match"), kept.alias("keep"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["piece"])
        end = begin + F.coalesce(F.char_length(x["match"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["keep"], F.lit(False)), F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.when(F.exists(kept, lambda k: k), F.aggregate(both, start, step, lambda s: s["found"])).otherwise(F.array().cast(_SPAN))


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, _, _ in BASE], F.lit(MODEL_KIND))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: MarkovModel, text_col: str = "text", min_length: int = 16, out: str = "secrets") -> DataFrame:
    """docs plus a struct column `out`: n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Base matches are leftmost and do not overlap within a kind. The model adds runs of at least min_length alphabet
    letters whose mean log-likelihood ratio is over its threshold, where no base match lies. Spans are code points, end exclusive, listed by start, then kind.

    Null and empty texts have no spans; repeated rows are judged alike; other columns pass through and one named like
    `out` is replaced; an empty table gives an empty result. A map over the rows: no shuffle, no Python.
    """
    keep = without(docs.columns, out)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kinds = [(kind, pattern, least, 2 if kind == "assign" else 0) for kind, pattern, least in BASE]
    for k, (kind, pattern, least, group) in enumerate(kinds):
        used = pattern if kind != "hex" else f"[0-9a-f]{{{least},}}"
        df = df.withColumn(f"m{k}", F.regexp_extract_all("text", F.lit(used), 0))
        values = F.col(f"m{k}") if group == 0 else F.regexp_extract_all("text", F.lit(used), group)
        df = df.withColumn(f"k{k}", F.when(F.size(f"m{k}") > 0, F.transform(values, _at_least(least))).otherwise(F.array().cast("array<boolean>")))
        df = df.withColumn(f"s{k}", _spans(F.col("text"), used, F.col(f"m{k}"), F.col(f"k{k}"), k))
    if model.ratios:
        runs = f"[A-Za-z0-9+/_=-]{{{min_length},}}"
        df = df.withColumn("m3", F.regexp_extract_all("text", F.lit(runs), 0))
        df = df.withColumn("k3", F.transform("m3", lambda m: ratio(m, model) > model.threshold))
        added = _spans(F.col("text"), runs, F.col("m3"), F.col("k3"), 3)
        base = F.concat("s0", "s1", "s2")
        df = df.withColumn("s3", F.filter(added, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    else:
        df = df.withColumn("s3", F.array().cast(_SPAN))
    found = F.struct(
        *[F.size(f"s{k}").cast("long").alias(f"n_{kind}") for k, (kind, _, _) in enumerate(BASE)],
        F.sha2(_listed(F.concat("s0", "s1", "s2")), 256).alias("base_sha256"),
        _listed(F.concat("s0", "s1", "s2", "s3")).alias("spans"),
        F.size("s3").cast("long").alias("n_markov"),
    )
    return df.select(*[F.col("doc").getField(c).alias(c) for c in keep], found.alias(out))
