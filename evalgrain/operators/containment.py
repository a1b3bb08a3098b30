"""Which of many patterns occur in which of many texts: an equi-join on what is rarest in each pattern."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrain.sources.scratch import written

WORD = "[A-Za-z0-9]+"
#: Kinds of a pattern's words: whole words of a text, the end of one, its beginning, somewhere inside.
WHOLE, ENDS, BEGINS, INSIDE = range(4)
#: Lengths from which a pattern without any word is cut into pieces, and their width: 2w - 1 characters always hold a whole aligned piece of w.
CLASSES = ((20, 10), (7, 4), (5, 3), (3, 2), (1, 1))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def _parts(patterns: DataFrame) -> DataFrame:
    """pattern_id, words, open_left and open_right: whether a text's word may go on before the first or after the last of them."""
    edge = lambda p: F.regexp_like("pattern", F.lit(p))
    return patterns.select("pattern_id", _words(F.col("pattern")).alias("words"), edge(r"\A[A-Za-z0-9]").alias("open_left"), edge(r"[A-Za-z0-9]\z").alias("open_right"))


def _kind(at: Column) -> Column:
    left, right = F.col("open_left") & (at == 0), F.col("open_right") & (at == F.size("words") - 1)
    return F.when(left & right, INSIDE).when(left, ENDS).when(right, BEGINS).otherwise(WHOLE)


def _forms(vocabulary: DataFrame, kind: int, lengths: list[int]) -> DataFrame:
    """word, df and each end, beginning or inner piece (form) of it that is as long as one of lengths."""
    rows = vocabulary.select("word", "df", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.col("n") <= F.length("word"))
    if kind == INSIDE:
        rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1)).alias("at"))
        return rows.select("word", "df", F.substring("word", F.col("at"), F.col("n")).alias("form")).distinct()
    return rows.select("word", "df", (F.left if kind == BEGINS else F.right)("word", "n").alias("form"))


def _found(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """words (pattern_id, n, at, kind, form) with each word of the texts that it may be part of, and that one's document frequency."""
    out = [words.where(F.col("kind") == WHOLE).join(vocabulary.withColumn("form", F.col("word")), "form")]
    used = words.where(F.col("kind") != WHOLE).groupBy("kind").agg(F.sort_array(F.collect_set(F.length("form"))).alias("lengths")).collect()
    out += [words.where(F.col("kind") == r.kind).join(_forms(vocabulary, r.kind, r.lengths), "form") for r in used]
    return reduce(DataFrame.unionByName, [d.select("pattern_id", "n", "at", "word", "df") for d in out])


#: As many characters of a word that is cut in the pattern go into the key of a run: 3, or 1 of shorter ones.
_CUTS = (3, 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for a row: inside a function of an array's elements Spark would repeat it for each."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doubled(words: Column, length: int) -> Column:
    """Hashes of all runs of `length` (a power of two) words."""
    if length == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    half = length // 2
    both = lambda runs: lambda i: F.xxhash64(F.get(runs, i), F.get(runs, i + half))
    every = lambda runs: F.when(F.size(runs) > half, F.transform(F.sequence(F.lit(0), F.greatest(F.size(runs) - 1 - half, F.lit(0))), both(runs))).otherwise(F.array().cast("array<bigint>"))
    return _let(_doubled(words, half), every)


def _key(k: int | Column, left: Column, right: Column, before: Column, first: Column, last: Column, after: Column) -> Column:
    """Hash of k whole words (as their first and last runs of a power of two) and `left` and `right` characters of the words before and after them."""
    return F.xxhash64(k, left, right, F.when(left > 0, F.right(before, left)), first, last, F.when(right > 0, F.left(after, right)))


def _grams(texts: DataFrame, half: int, shapes: list) -> DataFrame:
    """text_id and hash of each place's run of each shape (k whole words, half <= k <= 2 * half or 0, and the cuts before and after them).

    Each place is a row (the word before, the first and last runs of k words, the word after), so that hashing is compiled code.
    """
    held = texts.where(F.col("text").rlike(WORD)).select("text_id", "text")
    out, rest = [], F.lit(1 << 30)
    for k in sorted({s.k for s in shapes}):
        runs = (lambda words: _doubled(words, half)) if k else (lambda words: F.transform(words, lambda w: F.lit(None).cast("bigint")))
        beside = lambda words, k=k: F.concat(F.array(F.lit(None).cast("string")), words)
        zipped = _let(_words(F.col("text")), _zipped(k, half, runs, beside, rest))
        rows = held.select("text_id", F.inline(zipped)).toDF("text_id", "before", "first", "last", "after")
        keys = [_key(F.lit(k), F.lit(s.left), F.lit(s.right), F.col("before"), F.col("first"), F.col("last"), F.col("after")) for s in shapes if s.k == k]
        out.append(rows.select("text_id", F.explode(F.array(*keys)).alias("gram")))
    return reduce(DataFrame.unionByName, out)


def _zipped(k: int, half: int, runs, beside, rest: Column) -> Callable[[Column], Column]:
    return lambda words: _let(runs(words), lambda r: F.arrays_zip(beside(words), r, F.slice(r, F.lit(max(0, k - half) + 1), rest), F.slice(words, F.lit(k + 1), rest)))


def _pattern_grams(hard: DataFrame, length: int) -> DataFrame:
    """pattern_id, shape, gram, last: of each pattern the runs of `length` whole words, or, where it has no more of those, all its words at once (last)."""
    half = length // 2
    size = lambda side, word: F.when(~F.col(side), 0).when(F.length(word) >= _CUTS[0], _CUTS[0]).otherwise(_CUTS[1])
    left, right = size("open_left", F.element_at("words", 1)), size("open_right", F.element_at("words", -1))
    whole = F.slice("words", F.when(F.col("open_left"), 2).otherwise(1), F.greatest(F.lit(0), F.size("words") - F.col("open_left").cast("int") - F.col("open_right").cast("int")))
    out = hard.select("*", whole.alias("whole"), left.alias("l"), right.alias("r")).withColumn("k", F.size("whole")).withColumn("runs", _doubled(F.col("whole"), half))
    shape = lambda k, a, b: F.struct(k.cast("int").alias("k"), a.cast("int").alias("left"), b.cast("int").alias("right"))
    nothing = F.lit(None).cast("string")
    inner = F.transform(F.sequence(F.lit(0), F.col("k") - length), lambda i: F.struct(shape(F.lit(length), F.lit(0), F.lit(0)).alias("shape"), _key(F.lit(length), F.lit(0), F.lit(0), nothing, F.get("runs", i), F.get("runs", i + half), nothing).alias("gram")))
    at_end = F.when(F.col("k") > 0, F.get("runs", F.col("k") - half))
    at_start = F.when(F.col("k") > 0, F.get("runs", F.lit(0)))
    all_ = F.array(F.struct(shape(F.col("k"), F.col("l"), F.col("r")).alias("shape"), _key(F.col("k"), F.col("l"), F.col("r"), F.element_at("words", 1), at_start, at_end, F.element_at("words", -1)).alias("gram")))
    return out.select("pattern_id", (F.col("k") < length).alias("last"), F.inline(F.when(F.col("k") >= length, inner).otherwise(all_)))


def word_candidates(texts: DataFrame, patterns: DataFrame, most: int = 256, per_text: int = 8) -> DataFrame:
    """(text_id, pattern_id) pairs that may match, for patterns with a word: of each pattern the rarest key decides.

    1. The texts' words are written by word, and counted. A pattern's inner words are whole words of a text that holds it; its first
       and last ones may be ends and beginnings of longer ones, which are looked up among the texts' distinct words. A pattern with a
       word that no text has matches none.
    2. A pattern whose rarest word is in at most `most` texts is joined to those by it: at most `most` pairs.
    3. All others go on with runs of 2, 4, 8, ... whole words, until the rarest run is in at most `most` texts or the run would be
       longer than the pattern; then all its words at once, the first and last cut near the pattern's, are the key. Where all others
       together make no more than `per_text` pairs for each text, their rarest words so far do.

    So there are at most `most` pairs a pattern, `per_text` a text, and those of texts that hold all of a pattern's words in a row.
    """
    posted = written(texts.select("text_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).repartition("word"), "postings")
    vocabulary = written(posted.groupBy("word").agg(F.count("*").alias("df")), "vocabulary")
    parts = _parts(patterns).where(F.size("words") > 0)
    each = parts.select("pattern_id", F.size("words").alias("n"), "words", "open_left", "open_right", F.posexplode("words").alias("at", "form"))
    found = written(_found(each.select("pattern_id", "n", "at", _kind(F.col("at")).alias("kind"), "form"), vocabulary), "found")
    by_part = found.groupBy("pattern_id", "n", "at").agg(F.sum("df").alias("df"))
    chosen = by_part.groupBy("pattern_id", "n").agg(F.min(F.struct("df", "at")).alias("best"), F.count("*").alias("met")).where("met = n")
    common, few = (F.col("best.df") > most) & (F.col("n") > 1), per_text * texts.count()
    going_on = (chosen.where(common).agg(F.sum("best.df")).first()[0] or 0) > few
    easy = (chosen.where(~common) if going_on else chosen).select("pattern_id", "best.at")
    out = [posted.join(easy.join(found, ["pattern_id", "at"]).select("pattern_id", "word"), "word").select("text_id", "pattern_id")]
    if not going_on:
        return out[0].distinct()
    hard = chosen.where(common).select("pattern_id")
    left, length = written(parts.join(hard, "pattern_id", "left_semi"), "common"), 2
    while not left.isEmpty():
        grams = written(_pattern_grams(left, length), "pattern-grams")
        shapes = [r["shape"] for r in grams.select("shape").distinct().collect()]
        held = written(_grams(texts, length // 2, shapes).join(grams.select("gram").distinct(), "gram", "left_semi").distinct(), "grams")
        df = held.groupBy("gram").agg(F.count("*").alias("df"))
        best = written(grams.join(df, "gram", "left").groupBy("pattern_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("best"), F.bool_or("last").alias("last")), "gram-best")
        common = (F.col("best.df") > most) & ~F.col("last")
        rare = best.where(~common) if (best.where(common).agg(F.sum("best.df")).first()[0] or 0) > few else best
        out.append(held.join(rare.select("pattern_id", F.col("best.gram").alias("gram")), "gram").select("text_id", "pattern_id"))
        left, length = written(left.join(rare, "pattern_id", "left_anti"), "common"), 2 * length
    return reduce(DataFrame.unionByName, out).distinct()


def _pieces(width: int) -> Column:
    """(offset, piece) of each piece of a pattern, wherever it begins."""
    piece = lambda at: F.struct(F.pmod(at, F.lit(width)).alias("offset"), F.substring("pattern", at + 1, F.lit(width)).alias("piece"))
    return F.transform(F.sequence(F.lit(0), F.char_length("pattern") - width), piece)


def piece_candidates(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern_id) pairs that may match, for any pattern: texts are cut into aligned pieces of w characters.

    An occurrence holds a whole aligned piece, at one of w offsets of the pattern; of each offset the piece that is in the
    fewest texts is the key, and an offset of which a piece is in no text has none.
    """
    out, most = [], None
    for least, width in CLASSES:
        some = patterns.where(F.char_length("pattern") >= least)
        some = some if most is None else some.where(F.char_length("pattern") < most)
        most = least
        if some.isEmpty():
            continue
        pieces = some.select("pattern_id", F.inline(_pieces(width)))
        blocks = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s).{{{width}}}"), 0))).alias("piece"))
        held = written(blocks.join(pieces.select("piece").distinct(), "piece", "left_semi"), "pieces")
        df = held.groupBy("piece").agg(F.count("*").alias("df"))
        rarest = pieces.join(df, "piece", "left").groupBy("pattern_id", "offset").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "piece")).alias("best"))
        keys = rarest.where("best.df > 0").select("pattern_id", F.col("best.piece").alias("piece")).distinct()
        out.append(held.join(keys, "piece").select("text_id", "pattern_id"))
    return reduce(DataFrame.unionByName, out).distinct() if out else texts.select("text_id").crossJoin(patterns.select("pattern_id")).where("false")


def contained(texts: DataFrame, patterns: DataFrame, by_words: bool = True, most: int = 256, per_text: int = 8) -> DataFrame:
    """(text_id, pattern_id) for patterns that occur in texts: texts (text_id, text), patterns (pattern_id, pattern).

    Candidates come from equi-joins on rare keys, at any number of patterns (word_candidates(), and piece_candidates() for
    patterns without ASCII letters or digits or, with by_words false, for all); the candidates' texts are fetched once, and `contains`
    confirms. Empty and null patterns match nothing, null texts hold none; repeated ids are told apart by nothing.
    """
    some = patterns.where("char_length(pattern) > 0").select("pattern_id", "pattern")
    worded = F.col("pattern").rlike(WORD)
    pairs = [word_candidates(texts, some.where(worded), most, per_text)] if by_words else []
    rest = some.where(~worded) if by_words else some
    if not by_words or not rest.isEmpty():
        pairs.append(piece_candidates(texts, rest))
    found = reduce(DataFrame.unionByName, pairs)
    held = found.join(some, "pattern_id").join(texts.select("text_id", "text"), "text_id")
    return held.where(F.contains("text", "pattern")).select("text_id", "pattern_id").distinct()
